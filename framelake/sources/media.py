"""Media behind functions that the caller gives: decoders, probes, fetchers, models.

No decoder, network client or model comes with the library. Each operator takes
one as a function, runs it where the rows are, and turns what it raises into a
row with `error`; a worker holds one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "video string, idx long, seconds double, h int, w int, c int, pixels binary, error string"
#: Fixed value: frames a second where a recording doesn't say.
DEFAULT_FPS = 30.0


def probed(videos: DataFrame, probe: Callable[[str], dict]) -> DataFrame:
    """SRC-06, SRC-18: path, fps (30 by default), frames, w, h, duration and error of each video; probe(path) gives fps, frames, w, h."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    p = probe(path)
                    rows.append((path, p.get("fps"), p.get("frames"), p.get("w"), p.get("h"), None))
                except Exception as e:  # noqa: BLE001  one bad video must not end the others
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "fps", "frames", "w", "h", "error"])

    raw = videos.select("path").mapInPandas(run, "path string, fps double, frames long, w int, h int, error string")
    return properties(raw)


def properties(raw: DataFrame) -> DataFrame:
    """SRC-18: fps 30 where it is missing or not above 0; duration is frames / fps; a video without frames has an error."""
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(DEFAULT_FPS)
    named = raw.withColumn("fps", fps).withColumn("duration", F.col("frames") / F.col("fps"))
    return named.withColumn("error", F.coalesce("error", F.when(F.coalesce("frames", F.lit(0)) <= 0, "no frames")))


def decoded(videos: DataFrame, decode: Callable[[str], Iterable[tuple[int, float, np.ndarray]]], *, rows_back: int = 64) -> DataFrame:
    """SRC-06, IMG-12: the frames that decode(path) gives as (idx, seconds, pixels of bytes), in order; its error ends that video with a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FRAMES.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                rows = []
                try:
                    for idx, seconds, image in decode(path):
                        h, w = image.shape[:2]
                        rows.append((path, idx, seconds, h, w, image.shape[2] if image.ndim == 3 else 1, image.astype(np.uint8).tobytes(), None))
                        if len(rows) >= rows_back:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=names)

    return videos.select("path").mapInPandas(run, FRAMES)


def tokens_split(features: Column, prefix: int = 1) -> tuple[Column, Column]:
    """ML-01: the reference token and the patch tokens of a model's output, an array of tokens of which the first `prefix` are no patches."""
    return F.get(features, F.lit(0)), F.slice(features, prefix + 1, F.greatest(F.size(features) - prefix, F.lit(0)))


def batched(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, *, size: int = 32) -> DataFrame:
    """ML-02, ML-10, UDF-04, STM-08: rows through a model, `size` at a time and the last few of a task together.

    load() gives the model once a task; the model takes rows and gives rows of
    `schema`. Which backbone it is, is the caller's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = load(), None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= size:
                yield model(held.iloc[:size].reset_index(drop=True))
                held = held.iloc[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield model(held)

    return rows.mapInPandas(run, schema)


@dataclass
class Catalogue:
    """SRC-13/14, UDF-06: a remote catalogue behind fetch(url), which gives decoded JSON. A context manager: close() is called at its end."""

    spark: SparkSession
    fetch: Callable[[str], object]
    base: str
    video_base: str | None = None
    close: Callable[[], None] = field(default=lambda: None)

    def __enter__(self) -> Catalogue:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _listed(self, rows: DataFrame, url: Callable[[tuple], str], keys: list[str], name: str) -> DataFrame:
        """A row for each entry of the list that fetch gives for each row's url; what is no list is an error row."""
        fetch = self.fetch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for key in batch[keys].itertuples(index=False, name=None):
                    try:
                        found = fetch(url(key))
                        if not isinstance(found, list):
                            raise ValueError("the catalogue must give a list")
                        out += [(*key, str(x), None) for x in found]
                    except Exception as e:  # noqa: BLE001
                        out.append((*key, None, str(e)))
                yield pd.DataFrame(out, columns=[*keys, name, "error"])

        return rows.select(*keys).mapInPandas(run, ", ".join(f"{k} string" for k in [*keys, name, "error"]))

    def hives(self) -> DataFrame:
        base = self.base
        one = self.spark.createDataFrame([("",)], "_k string")
        return self._listed(one, lambda _: f"{base}/hives", ["_k"], "hive").drop("_k")

    def days(self, hives: DataFrame) -> DataFrame:
        from framelake.functions.names import parse_date

        base = self.base
        found = self._listed(hives.where("hive is not null"), lambda k: f"{base}/hives/{k[0]}/days", ["hive"], "day")
        return found.withColumn("day", F.date_format(parse_date(F.col("day")), "yyyy-MM-dd"))

    def times(self, days: DataFrame) -> DataFrame:
        from framelake.functions.names import parse_time

        base = self.base
        found = self._listed(days.where("day is not null"), lambda k: f"{base}/hives/{k[0]}/days/{k[1]}/times", ["hive", "day"], "time")
        return found.withColumn("time", parse_time(F.col("time")))

    def videos(self, times: DataFrame) -> DataFrame:
        """SRC-14: the schedule with each video's url, of the base that was given."""
        from framelake.functions.names import build_video_name, percent_encoded

        name = build_video_name(F.col("hive"), F.to_date("day"), F.col("time"))
        return times.where("time is not null").withColumn("url", F.concat(F.lit(f"{self.video_base or self.base}/"), percent_encoded(name)))
