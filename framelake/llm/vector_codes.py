"""Vector code compression: product quantisation with codebooks that are the same on every run.

A component x becomes the integer floor(`SCALE` * x). Vectors are cut into `PARTS`
parts, each with a codebook of `ENTRIES` integer entries, which start as the parts
of the first vectors and move to the floored means of their members for `ROUNDS`
rounds. Nearest entries are exact, though most of the work is a float32 matrix
product: every product comes with a bound on its rounding error, and where the
interval of another entry overlaps that of the best, distances are taken again in
64-bit integers; ties go to the lower index.

A round is one pass over the quantised rows, which are written once (4 bytes a
component). A task sends sums and counts of its members, `PARTS` x `ENTRIES` rows
of each component; all sums are integers, so the order in which tasks end doesn't
matter. The driver holds one codebook table, whatever the number of rows.

Defined results: rows whose vector is null, or holds a null or a number that isn't
finite, are dropped. Integers beyond +-`LIMIT` (components beyond 16,384) become
that limit, so that no sum overflows. Vectors that are shorter than the longest,
or whose length isn't a multiple of `PARTS`, are filled with zeros. First vectors
are ordered by vec_id, nulls last, then by the bytes of their integers; rows that repeat a
vec_id are rows of their own. With fewer than `ENTRIES` vectors the codebooks have
as many entries as there are vectors. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LIMIT = 1 << 26
#: Rows whose distances are screened together.
BLOCK = 8192


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and cells (int32, little-endian, as binary) of the rows of vectors (vec_id, embedding, label) that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("embedding")
            lists = given.filter(given.is_valid())
            cells, ends = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
            x = cells.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            good = bad[ends[1:]] == bad[ends[:-1]]
            with np.errstate(over="ignore", invalid="ignore"):
                raw = np.clip(np.nan_to_num(np.floor(SCALE * x)), -LIMIT, LIMIT).astype("<i4").tobytes()
            out = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1][good].tolist(), ends[1:][good].tolist())]
            at = pa.array(np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))[good])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(out, pa.binary())], names=["vec_id", "label", "cells"])

    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, label int, cells binary")


def matrix(cells: pa.Array, width: int) -> np.ndarray:
    """A row of `width` integers for each packed vector; missing ones are zero."""
    raw = [c.as_py() for c in cells]
    if any(len(r) != 4 * width for r in raw):
        raw = [r.ljust(4 * width, b"\0") for r in raw]
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of book (int64) that is nearest to each row of x (int32); the lower index on ties.

    A distance is |x|^2 + |c|^2 - 2 x.c, of which |x|^2 is the same for all entries.
    In float32 a product of d terms, conversions and any order of summation
    included, is off by at most g |x| |c| with g = (d + 2) u / (1 - (d + 2) u).
    """
    d = book.shape[1]
    u = 2.0**-24
    g = (d + 2) * u / (1 - (d + 2) * u)
    wide = book.astype(np.float64)
    sizes = (wide**2).sum(1)
    norms = np.sqrt(sizes) * (1 + 1e-12)
    own = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
    dots = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    value = sizes - 2 * dots
    # The last term covers what is rounded in float64 here.
    radius = (2 * g * (1 + 1e-9)) * own[:, None] * norms + 1e-14 * (sizes + 2 * np.abs(dots)) + 1e-9
    best = (value + radius).min(1)
    near = value - radius <= best[:, None]
    code = near.argmax(1)
    exact = lambda rows, entries: ((x[rows].astype(np.int64) - book[entries]) ** 2).sum(1)
    error = exact(slice(None), code)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    if len(open_rows):
        row, entry = np.nonzero(near[open_rows])
        again = np.full((len(open_rows), len(book)), np.iinfo(np.int64).max)
        again[row, entry] = exact(open_rows[row], entry)
        code[open_rows] = again.argmin(1)
        error[open_rows] = again.min(1)
    return code, error


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts by part and entry, sums by part, entry and component) of the rows' parts by nearest entry; objects are Python's integers."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in blocks(batches):
            x = matrix(batch.column("cells"), parts * d)
            for p in range(parts):
                own = x[:, p * d : (p + 1) * d]
                code, _ = nearest(own, books[p])
                n[p] += np.bincount(code, minlength=entries)
                for k in range(d):
                    total[p, :, k] += np.bincount(code, own[:, k], entries).astype(np.int64)  # exact: below 2 ** 53
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n.ravel()[used]), pa.array(list(total.reshape(-1, d)[used]), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    found = rows.select("cells").mapInArrow(run, "slot long, n long, total array<long>")
    cells = found.select("slot", "n", F.posexplode("total").alias("k", "v"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    counts, total = np.zeros(parts * entries, object), np.zeros((parts * entries, d), object)
    for r in cells.groupBy("slot", "k").agg(whole("n").alias("n"), whole("v").alias("v")).collect():  # parts x entries x components, at most
        counts[r.slot], total[r.slot, r.k] = int(r.n), int(r.v)
    return counts.reshape(parts, entries), total.reshape(parts, entries, d)


def learnt(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of quantised rows; of no entries if there are no rows."""
    width = (rows.agg(F.max(F.octet_length("cells"))).first()[0] or 0) // 4
    width = -(-width // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.hex("cells")).limit(entries).select("cells").collect()
    x = matrix(pa.array([r.cells for r in first], pa.binary()), width).astype(np.int64)
    books = np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))
    if not books.size:
        return books
    for _ in range(rounds):
        n, total = sums(rows, books)
        used = n > 0
        books = books.copy()
        books[used] = (total[used] // n[used][:, None]).astype(np.int64)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (a byte for each part) and error of quantised rows."""
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            code, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            if d:
                x = matrix(batch.column("cells"), parts * d)
                for p in range(parts):
                    code[:, p], off = nearest(x[:, p * d : (p + 1) * d], books[p])
                    error += off
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label int, code binary, error long")


def compress(vectors: DataFrame, **options: int) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept row of vectors (vec_id, embedding, label); the codebooks)."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = scratch.save(quantised(vectors))
    books = learnt(rows, **options)
    found = scratch.save(coded(rows, books))
    scratch.drop(rows)
    return found, books


def restored(code: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for: its entries over `SCALE`, one after the other."""
    return np.concatenate([books[p, c] for p, c in enumerate(code)]) / SCALE


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12(spark, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by = found.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    rows = found.join(checked(by, 16), F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    """CTEs of DuckDB SQL: a<k>, the nearest entry of each part under the codebooks b<k>."""
    return f"""
a{k} AS MATERIALIZED (SELECT vec_id, label, part, cells, min(struct_pack(d := list_sum(list_transform(list_zip(cells, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best
      FROM p JOIN b{k} USING (part) GROUP BY ALL)"""


def _moved(k: int) -> str:
    """CTEs of DuckDB SQL: b<k + 1>, the codebooks after a<k>."""
    return f"""
m{k} AS (SELECT part, best.e AS e, i, sum(cells[i])::HUGEINT AS s, count(*) AS n FROM a{k}, range(1, {{d}} + 1) AS r(i) GROUP BY ALL),
f{k} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS moved FROM m{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(moved, entry) AS entry FROM b{k} LEFT JOIN f{k} USING (part, e))"""


def sql(width: int = 64) -> str:
    d = width // PARTS
    steps = ",".join(_assigned(k) + "," + _moved(k).format(d=d) for k in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
                        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * {d} + 1 : part * {d} + {d}] AS cells FROM v, range({PARTS}) AS r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, cells AS entry FROM p
                    JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),{steps},{_assigned(ROUNDS)},
r AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM r GROUP BY label),
c AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY part, e)) AS sha FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, sha AS codebooks_sha256 FROM r JOIN l ON r.label IS NOT DISTINCT FROM l.label, c
"""


OP12_SQL = sql()
