"""Forms, selections and replacements that have to be exact, against Python, NumPy and DuckDB."""

import datetime as dt
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import sources
from framelake.functions import names, numbers
from framelake.operators import order, vectors
from framelake.plans import catalogue
from framelake.sources import sinks


def test_seconds_in_names_are_pythons(spark):
    rng = random.Random(3)
    times = [k / 20 for k in range(4_000)] + [k / 100 for k in range(2_000)] + [rng.random() * 10 ** rng.randint(-3, 8) for _ in range(2_000)] + [123456789.25, 0.05, 0.25, 1e-9]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i long, t double")
    for r in made.select("i", "t", names.frame_name(F.col("i"), F.col("t")).alias("n")).collect():
        assert r.n == f"frame_{r.i:06d}_t{r.t:08.1f}s.jpg"


def test_frame_names_equal_their_sql_beyond_a_million(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (0, 9, 999_999, 1_000_000, 1_000_009, 7_654_321)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = con.sql(catalogue.SQL["frame_names"])
    found = catalogue.QUERIES["frame_names"](spark, str(tmp_path)).select(*sql.columns).collect()
    assert sorted(map(tuple, found)) == sorted(sql.fetchall())


def by_strptime(text, forms):
    for form in forms:
        try:
            return dt.datetime.strptime(text.strip(), form)
        except ValueError:
            pass
    return None


def test_dates_and_times(spark):
    dates = [" 2024-01-05 ", "2024-1-5", "01/05/2024", "\t1/5/2024\n", "2024-13-01", "2024-02-30", "24-01-05", "1/5/24", "2024-01-05x", "", "2024/01/05", "05-01-2024"]
    found = spark.createDataFrame([(x,) for x in dates], "x string").select("x", names.parse_date(F.col("x")).alias("d")).collect()
    for r in found:
        want = by_strptime(r.x, ("%Y-%m-%d", "%m/%d/%Y"))
        assert r.d == (want and want.date()), r.x
    times = [" 10:11:12 ", "1:2:3", "3:04:05 pm", "12:00:00 AM", "03:04:05  Pm", "10:11", "10:11:12.5", "3:04 PM", "25:00:00", "13:00:00 pm", "0:10:10 am", "10:11:60", "", "3:04:05pm"]
    found = spark.createDataFrame([(x,) for x in times], "x string").select("x", names.parse_time(F.col("x")).alias("t")).collect()
    for r in found:
        want = by_strptime(r.x.upper(), ("%H:%M:%S", "%I:%M:%S %p"))
        assert r.t == (want and f"{want:%H:%M:%S}"), r.x


def test_cosines_that_are_no_numbers(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([math.nan, 1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([math.inf, 1.0], [1.0, 1.0]), ([3.0, 4.0], [-3.0, -4.0])]
    made = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.c for r in made.select(numbers.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([1, 0, 0, 0, -1])


def test_records_whose_keys_are_no_text(spark, tmp_path):
    good = {"status": "failed", "hive": "h", "day": "d", "time": "t", "reason": "none"}
    lines = [good, good | {"hive": 5}, good | {"time": ["x"]}, good | {"day": None}, good | {"status": "gone"}, [good], 7, {k: v for k, v in good.items() if k != "time"}, good | {"hive": "5", "path": 3}]
    (tmp_path / "m.jsonl").write_text("\n".join([*map(json.dumps, lines), "{bad", "", " " + json.dumps(good | {"hive": "é"})]))
    found = sources.manifest(spark, str(tmp_path / "m.jsonl")).orderBy("seq").collect()
    assert [(r.hive, r.path, r.reason) for r in found] == [("h", None, "none"), ("5", "3", "none"), ("é", None, "none")]


def test_state_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    """A writer that breaks off before the rename leaves the old state; no moment is without one."""
    at = str(tmp_path / "state.json")
    sinks.save_state(spark, at, "s", 3)
    sinks.save_state(spark, at, "s", 4)
    assert sources.next_day_index(spark, at, "s") == 4
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = jvm_path(at + ".broken.part")
    out = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(part, True)
    out.write(bytearray(b'{"next_day'))
    out.close()
    assert sources.next_day_index(spark, at, "s") == 4
    monkeypatch.setattr(sinks.json, "dumps", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        sinks.save_state(spark, at, "s", 5)
    assert sources.next_day_index(spark, at, "s") == 4


def test_groups_of_a_root_are_not_those_of_a_longer_name(spark):
    index = spark.createDataFrame([("file:/x/mydata/frame_1.jpg", 1), ("file:/x/data/frame_2.jpg", 2)], "frame_path string, frame_idx long")
    assert [r.frame_idx for r in sources.frame_groups(index, "data").collect()] == [2]
    assert [r.frame_idx for r in sources.frame_groups(index, "/x/data/").collect()] == [2]


@pytest.mark.parametrize("cells", [2, 1024])
def test_quantiles(spark, monkeypatch, cells):
    monkeypatch.setattr(order, "CELLS", cells)
    rng = random.Random(1)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(801)], "ties": [1.5] * 40 + [2.5] * 41, "one": [7.0], "wide": [1e308, -1e308, 0.0, 1e-300, 5e-324, 1.0], "heavy": [math.exp(rng.random() * 500) for _ in range(60)],
        "ends": [-math.inf, 1.0, 2.0, math.inf, math.inf], None: [3.0, None, math.nan, 4.0], "none": [None, math.nan],
    }
    made = spark.createDataFrame([(k, v, i) for k, vs in values.items() for i, v in enumerate(vs)], "g string, v double, i int")
    ps = [0.0, 0.25, 0.5, 0.99, 1.0]
    found = {r.g: r for r in order.quantiles(made, {"v": F.col("v"), "i": F.col("i")}, ps, by=["g"]).collect()}
    for k, vs in values.items():
        own = [v for v in vs if v is not None and not math.isnan(v)]
        for j, p in enumerate(ps):
            if own and (k != "ends" or p in (0.0, 0.25, 0.5, 1.0)):
                want = sorted(own)[int((len(own) - 1) * p)] if k == "ends" else np.quantile(own, p)
                assert found[k][f"v_{j}"] == pytest.approx(want, rel=1e-12, abs=1e-300), (k, p)
            assert found[k][f"i_{j}"] == pytest.approx(np.quantile(range(len(vs)), p))
        assert own or found[k].v_0 is None
    assert order.quantiles(made.where("i < 0"), {"v": F.col("v")}, [0.5], by=["g"]).collect() == []


def plans_of(df):
    return df._jdf.queryExecution().toString()


def test_no_plan_sorts_or_gathers_values_for_a_quantile(spark):
    made = spark.range(1000).selectExpr("id % 3 as g", "id * 1.5 as v")
    plan = plans_of(order.quantiles(made, {"v": F.col("v")}, [0.5], by=["g"]))
    assert "percentile" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_frames_of_any_size_against_a_decomposition(spark):
    rng = np.random.default_rng(5)
    groups = {None: rng.normal(size=(40, 6)) * [5, 3, 2, 1, 1, 1], 1: rng.normal(size=(3, 6)), 2: np.outer(rng.normal(size=20), [1, 2, 3, 4, 5, 6])}
    rows = [(g, f"k{i}", [float(x) for x in v]) for g, x in groups.items() for i, v in enumerate(x)]
    made = spark.createDataFrame([*rows, (1, "null", None)], "g int, k string, v array<double>").repartition(5)
    found = {(r.g, r.k): (r.r, r.g_) for r in vectors.frame_rgb(made, by="g", key="k", vector="v").toDF("g", "k", "r", "g_", "b").collect()}
    axes = {r.g: r for r in vectors.group_axes(vectors.group_moments(made, by="g", vector="v"), by="g").collect()}
    assert len(found) == 63
    for g, x in groups.items():
        c = x - x.mean(0)
        _, s, vt = np.linalg.svd(c, full_matrices=False)
        own = np.array(axes[g].axes)
        assert np.allclose(own @ own.T, np.eye(3), atol=1e-8) and np.allclose(axes[g].shares, (s**2 / (s**2).sum())[:3], atol=1e-8)
        for k in range(1 if g == 2 else 2):  # what the group has
            assert own[k][np.abs(own[k]).round(12).argmax()] > 0 and abs(abs(own[k] @ vt[k]) - 1) < 1e-8
            p = c @ own[k]
            want = (p - p.min()) / (p.max() - p.min() + 1e-6)
            assert np.allclose([found[g, f"k{i}"][k] for i in range(len(x))], want, atol=1e-7)
    with pytest.raises(Exception, match="fewer than 3"):
        vectors.frame_rgb(made.where("g = 1 and k < 'k2'"), by="g", key="k", vector="v").collect()
