"""Repeated lines, found by hashing units of text over all documents.

A unit is a line, or a part of one that ends with a punctuation mark (`ENDS`)
before white space: passages are quoted from the middle of lines, and such
passages share units though no whole line. A unit begins at its first word and
goes on to the first word of the next, so that units hold all of a text but the
white space before its first word. Units are normalised (ASCII letters lowered,
white space runs to one space, ends trimmed) and equal if the XXH3 hashes (128
bits) of their bytes are. Of equal units the first by (doc_id, place in the text) is kept always. The others are
repeats, and a run of neighbouring repeats is removed if it has `min_words` words
or more: what it holds stands earlier, unit by unit, and short phrases that
documents share by chance stay where they are. A word counts as such, and eight
characters count as a word if that is more, for writing without spaces. Spans of
what is removed are offsets (code points) in the original text. All repeats, of any
length, are reported beside that, in spans of neighbouring ones. With `ends=""`
units are lines, with `min_words=1` each repeat is removed.

Digests are grouped with map-side aggregation to the rank of their first unit, so
that a line that stands in every document costs a row a task. What returns to the
documents is the list of their first units, never a row for each copy, and no list
where all units are first.

Defined results: a null text has no units and stays null. Rows with a null doc_id
rank first, by the hash of their text. Rows that repeat a doc_id are ranked by the hash of their
text; if that repeats too, they are one document and get the same answer. An
empty table gives an empty result; other columns stay unchanged in `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, documents, packed, sliced, unpacked
from framelake.llm.shingles import word_spans

#: Marks after which a unit ends, if white space follows.
ENDS = ".!?,;:"
MIN_WORDS = 20
#: Characters of a unit that count as a word if that makes more words.
WORD_CHARS = 8


class Units(NamedTuple):
    """Units of a batch of texts: `text` (number of the text), `start` and `stop` (bytes in it), `size` (in words), and if asked for `digests`, two numbers each."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    size: np.ndarray
    digests: np.ndarray | None


def units(texts: list[bytes | None], ends: str = ENDS, *, digests: bool = False) -> Units:
    data, starts, stops, borders = word_spans(texts)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Units(none, none, none, none, none.reshape(0, 2))
    raw = np.frombuffer(data, np.uint8)
    mark = np.zeros(256, bool)
    mark[list(ends.encode())] = True
    lines = np.cumsum(raw == 10)  # texts are parted by line ends too
    new = np.ones(len(starts), bool)
    new[1:] = mark[raw[stops[:-1] - 1]] | (lines[starts[1:]] != lines[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))
    text = np.searchsorted(borders, starts[first], "right")
    begin = np.concatenate([[0], borders])[text]
    start = starts[first] - begin
    stop = np.append(start[1:], 0)
    size = np.diff(np.concatenate([[0], borders])) - 1
    ending = np.append(text[1:] != text[:-1], True)
    stop[ending] = size[text[ending]]
    chars = np.cumsum((raw & 0xC0) != 0x80)  # code points of what is normalised: of words, and a space between two
    word_chars = np.cumsum(chars[stops - 1] - chars[starts] + 1)
    before = np.append(0, word_chars)
    n = last - first
    chars_in = before[last] - before[first] + n - 1
    return Units(text, start, stop, np.maximum(n, chars_in // WORD_CHARS), _digests(data, starts, stops, first, last) if digests else None)


def _digests(data: bytes, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words first..last (exclusive) of each unit, joined by spaces."""
    digest = xxhash.xxh3_128_digest
    raw, gaps = np.frombuffer(data, np.uint8), np.zeros(len(starts) + 1, np.int64)
    gaps[2:] = np.cumsum((starts[1:] - stops[:-1] != 1) | (raw[stops[:-1]] != 32))  # of words that aren't one space behind the word before
    plain = gaps[last] == gaps[first + 1]
    found = [digest(data[a:b]) if one else digest(b" ".join(data[a:b].split())) for a, b, one in zip(starts[first].tolist(), stops[last - 1].tolist(), plain.tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _tied(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), *more, F.col("text").cast("binary").alias("text"))


def unit_rows(docs: DataFrame, ends: str) -> DataFrame:
    """(d1, d2, doc_id, tie, place, n_units) of each unit of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = units(batch.column("text").to_pylist(), ends, digests=True)
            n = np.bincount(found.text, minlength=batch.num_rows)
            place = np.arange(len(found.text)) - np.repeat(np.cumsum(n) - n, n)
            of = pa.array(found.text)
            columns = [pa.array(found.digests[:, 0]), pa.array(found.digests[:, 1]), batch.column("doc_id").take(of), batch.column("tie").take(of), pa.array(place, pa.int32()), pa.array(n[found.text], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "doc_id", "tie", "place", "n_units"])

    return _tied(docs).mapInArrow(run, "d1 long, d2 long, doc_id long, tie long, place int, n_units int")


def first_units(docs: DataFrame, ends: str) -> DataFrame:
    """A row for each text with a first unit: doc_id, tie, n_units, and stay, the places of its first units; null if all are."""
    first = unit_rows(docs, ends).groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tie", "place", "n_units")).alias("f"))
    stay = first.groupBy("f.doc_id", "f.tie", "f.n_units").agg(F.collect_list("f.place").alias("stay"))  # no longer than the text's own units
    return stay.withColumn("stay", F.when(F.size("stay") < F.col("n_units"), F.col("stay")))


def removed_runs(found: Units, goes: np.ndarray, min_words: int) -> np.ndarray:
    """Whether each unit is in a run of neighbouring repeats of one text with min_words words or more."""
    if not len(goes):
        return goes
    new = np.ones(len(goes), bool)
    new[1:] = (goes[1:] != goes[:-1]) | (found.text[1:] != found.text[:-1])
    run = np.cumsum(new) - 1
    return goes & (np.bincount(run, found.size)[run] >= min_words)


def repeats(docs: DataFrame, *, ends: str = ENDS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_units, n_removed (units), removed (array of start, stop), kept_text, n_repeats (units) and repeated (as removed) of each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "lines")
    marks = scratch.save(first_units(docs, ends).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("n_units").alias("known"), "stay"))
    rows = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    rows = rows.join(marks.hint("merge"), same, "left")  # texts are shuffled at every size alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, stay, known = (batch.column(c).to_pylist() for c in ("text", "stay", "known"))
            # Without a row no unit is a first one; with no list all are.
            some = [k for k, t in enumerate(texts) if t is not None and (known[k] is None or stay[k] is not None)]
            found = units([texts[k] for k in some], ends)
            n_units = np.bincount(found.text, minlength=len(some))
            begin = np.cumsum(n_units) - n_units
            goes = np.ones(len(found.text), bool)
            for j, k in enumerate(some):
                if stay[k]:
                    goes[begin[j] + np.array(stay[k])] = False
            gone = removed_runs(found, goes, min_words)
            total, removed, spans, kept = [x or 0 for x in known], [0] * len(texts), [[] for _ in texts], list(texts)
            again, places = [0] * len(texts), [[] for _ in texts]
            for j, k in enumerate(some):
                at = slice(begin[j], begin[j] + n_units[j])
                total[k], removed[k] = int(n_units[j]), int(gone[at].sum())
                again[k] = int(goes[at].sum())
                if again[k]:
                    points = places_of(texts[k])
                    places[k] = in_points(runs_in(found.start[at], found.stop[at], goes[at]), points)
                if removed[k]:
                    runs = runs_in(found.start[at], found.stop[at], gone[at])
                    spans[k], kept[k] = in_points(runs, points), without(texts[k], runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t if t is None else t.decode() for t in texts], pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array([t if t is None else t.decode() for t in kept], pa.string()), pa.array(again, pa.int64()), pa.array(places, _SPANS)],
                names=["doc_id", "text", "n_units", "n_removed", "removed", "kept_text", "n_repeats", "repeated"],
            )

    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "stay", "known")
    return rows.mapInArrow(run, "doc_id long, text string, n_units long, n_removed long, removed array<struct<start:int,stop:int>>, kept_text string, n_repeats long, repeated array<struct<start:int,stop:int>>")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def runs_in(start: np.ndarray, stop: np.ndarray, gone: np.ndarray) -> list[tuple[int, int]]:
    """The runs (in bytes) of neighbouring units in `gone`."""
    edge = np.diff(gone.view(np.int8), prepend=0, append=0)
    return list(zip(start[edge[:-1] == 1].tolist(), stop[edge[1:] == -1].tolist()))


def places_of(text: bytes) -> np.ndarray | None:
    """Code points before each byte; None if they are bytes."""
    return None if text.isascii() else np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def in_points(runs: list[tuple[int, int]], points: np.ndarray | None) -> list[dict[str, int]]:
    return [{"start": a, "stop": b} if points is None else {"start": int(points[a]), "stop": int(points[b])} for a, b in runs]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated units taken out of their texts; all columns stay. Rows are joined by doc_id and text."""
    done = repeats(docs, **options).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), "kept_text").dropDuplicates(["_id", "_tie"])
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tie"))
    joined = packed(docs, F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash")).join(done, same, "left")
    return unpacked(joined, docs.columns, text=F.when(F.col("_id").isNull() & F.col("_tie").isNull(), F.col("_row.text")).otherwise(F.col("kept_text")))


def op1(spark, sf_dir: str) -> DataFrame:
    done = repeats(documents(spark, sf_dir))
    spans = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["start"], r["stop"])), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    return done.select("doc_id", "n_units", "n_removed", chars.alias("n_removed_chars"), spans("removed").alias("spans"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"), "n_repeats", spans("repeated").alias("repeat_spans"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, text, length(text) AS size,
                  string_split(regexp_replace(regexp_replace(text, '([{ENDS}])([\x20\x09\x0B-\x0D])', '\1' || chr(1) || '\2', 'g'), '(\n)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT doc_id, size, unnest(parts) AS u, unnest(range(0, len(parts))) AS place FROM d),
a AS (SELECT *, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY place) - length(u) + length(u) - length(regexp_replace(u, '^[\x20\x09-\x0D]+', '')) AS start,
             trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM u),
n AS (SELECT doc_id, size, norm, start, greatest(length(norm) - length(replace(norm, ' ', '')) + 1, length(norm) // {WORD_CHARS}) AS words,
             row_number() OVER (PARTITION BY doc_id ORDER BY place) AS place,
             coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY place), size) AS stop FROM a WHERE norm <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS goes FROM n),
g AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, goes ORDER BY place) AS run FROM r),
a2 AS (SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, count(*) AS n, sum(words) AS words FROM g WHERE goes GROUP BY doc_id, run),
q AS (SELECT doc_id, sum(n)::BIGINT AS n_repeats, string_agg(start || ':' || stop, ',' ORDER BY start) AS repeat_spans FROM a2 GROUP BY doc_id),
s AS (SELECT * FROM a2 WHERE words >= {MIN_WORDS}),
k AS (SELECT doc_id, start, stop, n, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before,
             lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS after FROM s),
c AS (SELECT k.doc_id, sum(n)::BIGINT AS n_removed, sum(stop - start)::BIGINT AS chars, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans,
             string_agg(substr(text, (before + 1)::INT, (start - before)::INT) || CASE WHEN after IS NULL THEN substr(text, (stop + 1)::INT) ELSE '' END, '' ORDER BY start) AS kept
      FROM k JOIN documents USING (doc_id) GROUP BY k.doc_id),
t AS (SELECT doc_id, count(*) AS n_units FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(chars, 0) AS n_removed_chars, coalesce(spans, '') AS spans,
       sha256(coalesce(kept, d.text, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats, coalesce(repeat_spans, '') AS repeat_spans
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)
"""
