"""Exact repeated substrings over all documents, by suffix sorting.

A byte is removed if a `LENGTH`-byte string covers it that also starts earlier
(in an earlier document, or earlier in the same). Suffix sorting all bytes isn't
needed to find them all:

1. Copies of whole texts are set aside: the first stays for comparison, the
   others repeat it from end to end.
2. Anchors: of the hashed `GRAM`-byte grams in each `LENGTH`-byte window, the
   smallest is chosen. Equal windows choose alike, so a string that occurs twice
   holds an anchor that occurs twice; other anchors are dropped.
3. A repeated anchor brings its context, the bytes of all windows around it.
   Contexts that are equal are grouped map-side: all but the first are repeats.
4. First contexts that share an anchor are suffix sorted together by bucket
   pointer refinement (`refined`): buckets of 8-byte grams are refined by sorting
   on the bucket pointers of later offsets, where each round uses the pointers
   that the round before has refined (8, 16, 32, 64, then LENGTH bytes). Only
   suffixes in buckets with others are sorted again. In a final bucket all
   suffixes but the first are repeats.
5. A group of contexts answers for the windows whose anchor stands `lo` to `hi`
   bytes behind their start; at first that is all of them. Such windows hold the
   `lo` bytes before the anchor and the REACH - `hi` bytes behind it, so they can be
   parted by those bytes without parting equal windows. Groups of more than `LARGE`
   contexts, which is what one task sorts, become two half intervals each, and so
   on until they can be sorted in one task. In an interval of one place the group's
   bytes are the whole window: its windows are equal, and an aggregate finds the first.

Every step keeps whole results; nothing is capped.

Defined results: a null text has 0 bytes. Texts under LENGTH bytes lose nothing.
Null ids come first in the order, rows of one doc_id with different texts follow
in the order of their texts' digests, and rows that repeat a doc_id and its text
are one document with one answer. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, documents, sliced, text_or_empty

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # bytes of context on either side of an anchor
#: Contexts of a group that are sorted in one task; larger groups are parted.
LARGE = 16_000
#: Contexts that are sorted together, besides the group that is begun.
TOGETHER = 4_000
_CHUNK = 1 << 20
_FIRST = -(1 << 63)
_U = np.uint64


def _grams(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of the GRAM-byte grams of data, by doubling."""
    h, base, width = (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), 1
    h ^= h >> _U(31)
    while width < GRAM:
        with np.errstate(over="ignore"):
            h = h[:-width] * base + h[width:]
            base = base * base
        width *= 2
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :])


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors in data, in which documents begin at `starts` (ascending, with the end last)."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = _grams(data)
    at = np.arange(len(h), dtype=_U)
    least = _window_minima((h & ~_U(_CHUNK * 2 - 1)) | at, REACH + 1)  # ties: the leftmost
    ends = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= ends
    places = np.unique(least[inside] & _U(_CHUNK * 2 - 1)).astype(np.int64)
    return places, h[places].view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about _CHUNK bytes: data, starts, number of the text and its offset for each; long texts are cut with overlap."""
    parts, size = [], 0

    def joined():
        lengths = [len(b) for b, _, _ in parts]
        return np.frombuffer(b"".join(b for b, _, _ in parts), np.uint8), np.cumsum([0, *lengths]), np.array([k for _, k, _ in parts]), np.array([o for _, _, o in parts])

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), _CHUNK - LENGTH):
            piece = text[at : at + _CHUNK - 1] if len(text) > _CHUNK else text
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > _CHUNK and parts:
                yield joined()
                parts, size = [], 0
            parts.append((piece, k, at))
            size += len(piece)
            if len(text) <= _CHUNK:
                break
    if parts:
        yield joined()


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, doc, tie, place) of all anchors of rows (doc, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            doc, tie = (batch.column(c).to_numpy() for c in ("doc", "tie"))
            for data, starts, number, offset in _chunks(batch.column("text").to_pylist()):
                places, h = anchors(data, starts)
                part = np.searchsorted(starts, places, "right") - 1
                found = (h, doc[number[part]], tie[number[part]], (places - starts[part] + offset[part]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["h", "doc", "tie", "place"])

    return docs.select("doc", "tie", F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long, doc long, tie long, place int")


#: Contexts that are handed on together.
_CONTEXTS = 10_000


def context_rows(docs: DataFrame) -> DataFrame:
    """(context, lead, doc, tie, place) for each of the places of rows (doc, tie, text, places); lead: bytes before the anchor."""

    def table(held: list[tuple[int, int, np.ndarray, list[bytes]]]) -> pa.RecordBatch:
        n = [len(places) for _, _, places, _ in held]
        place = np.concatenate([places for _, _, places, _ in held])
        columns = [pa.array([c for *_, own in held for c in own], pa.binary()), pa.array(np.minimum(place, REACH).astype(np.int32))]
        columns += [pa.array(np.repeat(np.array([row[i] for row in held], np.int64), n)) for i in range(2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(place.astype(np.int32))], names=["context", "lead", "doc", "tie", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in sliced(batches):
            for k in range(batch.num_rows):
                data, doc, tie = (batch.column(c)[k].as_py() for c in ("text", "doc", "tie"))
                places = np.unique(batch.column("places")[k].values.to_numpy())
                for at in range(0, len(places), _CONTEXTS):
                    some = places[at : at + _CONTEXTS]
                    held.append((doc, tie, some, [data[max(p - REACH, 0) : p + LENGTH] for p in some.tolist()]))
                    rows += len(some)
                    if rows >= _CONTEXTS:
                        yield table(held)
                        held, rows = [], 0
        if held:
            yield table(held)

    return docs.select("doc", "tie", F.col("text").cast("binary").alias("text"), "places").mapInArrow(run, "context binary, lead int, doc long, tie long, place int")


def refined(data: np.ndarray, wanted: np.ndarray, length: int = LENGTH, gram: int = 8) -> np.ndarray:
    """Bucket pointers of the suffixes of data that start at `wanted`: equal if and only if their first `length` bytes are.

    Each wanted suffix must have `length` bytes. Pointers of suffixes alone in
    their bucket stay as they are, since no later round can part them.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    key = np.zeros(len(data), _U)
    for i in range(gram):
        key = key << _U(8) | padded[i : i + len(data)]
    pointer, shared = _buckets(key)
    active, depth, free = np.flatnonzero(shared), gram, len(data)
    while depth < length:
        step = min(depth, length - depth)
        if depth + step == length:
            active = np.intersect1d(active, wanted, assume_unique=True)
        later = np.minimum(active + step, len(data) - 1)
        # The pointers of suffixes `step` later hold `depth` bytes: together depth + step.
        order, shared = _buckets(pointer[active].astype(_U) << _U(32) | pointer[later].astype(_U))
        pointer[active] = free + order  # numbers that no bucket has had
        active, depth, free = active[shared], depth + step, free + len(data)
    return pointer[wanted]


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its bucket's pointer (the first place of the bucket in sorted order), and whether the bucket has others."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    pointer, shared = np.empty(len(key), np.int64), np.empty(len(key), bool)
    pointer[order] = np.repeat(first, size)
    shared[order] = np.repeat(size > 1, size)
    return pointer, shared


def repeated_in(contexts: list[bytes], lead: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start in its document) of the windows of contexts, with lo to hi bytes before the anchor, that equal an earlier one of them."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data, starts = np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(sizes) - sizes
    least, most = np.maximum(lead - hi, 0), np.minimum(lead - lo, sizes - LENGTH)  # where in the context windows start
    n = np.clip(most - least + 1, 0, None)
    row = np.repeat(np.arange(len(contexts)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[row]
    if not len(row):
        return row, inner
    pointer = refined(data, starts[row] + inner)
    start = place[row] - lead[row] + inner
    order = np.lexsort((start, tie[row], doc[row], pointer))
    p, r, s = pointer[order], row[order], start[order]
    head = np.ones(len(p), bool)
    head[1:] = p[1:] != p[:-1]
    lead_of = np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))
    # A window can come from two anchors of one document: it is no repeat of itself.
    later = (doc[r] != doc[r[lead_of]]) | (tie[r] != tie[r[lead_of]]) | (s != s[lead_of])
    return r[later], s[later]


def sorted_repeats(groups: DataFrame) -> DataFrame:
    """(doc, tie, start, stop) of removed runs, from rows (part, context, lead, doc, tie, place, lo, hi) that are dealt and sorted by part."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        doc, tie, place, lead, lo, hi = (part[c].to_numpy() for c in ("doc", "tie", "place", "lead", "lo", "hi"))
        row, start = repeated_in(part["context"].tolist(), lead, doc, tie, place, lo, hi)
        out = pd.DataFrame({"doc": doc[row], "tie": tie[row], "start": start}).drop_duplicates().sort_values(["doc", "tie", "start"])
        gap = (out["doc"].diff() != 0) | (out["tie"].diff() != 0) | (out["start"].diff() > LENGTH)
        out["run"] = gap.cumsum()
        runs = out.groupby("run").agg(doc=("doc", "first"), tie=("tie", "first"), start=("start", "first"), stop=("start", "last"))
        runs["stop"] += LENGTH
        return runs.astype({"start": np.int32, "stop": np.int32}).reset_index(drop=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                batch = whole.iloc[at : at + TOGETHER]
                held.append(batch)
                rows += len(batch)
                if rows >= TOGETHER:
                    some = pd.concat(held, ignore_index=True)
                    last = some["part"] == some["part"].iloc[-1]  # its group may go on
                    if not last.all():
                        yield work(some[~last].reset_index(drop=True))
                    held = [some[last].reset_index(drop=True)]
                    rows = len(held[0])
        if held and rows:
            yield work(pd.concat(held, ignore_index=True))

    return groups.select("part", "context", "lead", "doc", "tie", "place", "lo", "hi").mapInPandas(run, "doc long, tie long, start int, stop int")


def parted(contexts: DataFrame) -> DataFrame:
    """contexts (.., lo, hi) with `part`, a hash of the bytes that all windows of their interval hold."""
    left = F.substring(F.col("context"), F.col("lead") - F.col("lo") + 1, F.col("lo") + GRAM + REACH - F.col("hi"))
    return contexts.withColumn("part", F.xxhash64("lo", "hi", left))


def halved(contexts: DataFrame) -> DataFrame:
    """Each row twice, with the lower and the upper half of its interval; halves in which it has no window are left out."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi"))
    rows = contexts.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")
    behind = F.octet_length("context") - F.col("lead") - GRAM
    return rows.where((F.col("lead") >= F.col("lo")) & (behind >= REACH - F.col("hi")))


def equal_windows(contexts: DataFrame) -> DataFrame:
    """The same as `sorted_repeats` for groups of one place: their windows are equal, so all but the first are repeats."""
    window = F.substring(F.col("context"), F.col("lead") - F.col("lo") + 1, F.lit(LENGTH))
    w = contexts.select("doc", "tie", (F.col("place") - F.col("lo")).alias("start"), "lo", window.alias("bytes"))
    first = w.groupBy("lo", "bytes").agg(F.min(F.struct("doc", "tie", "start")).alias("f"))
    again = w.join(first, ["lo", "bytes"]).where(F.struct("doc", "tie", "start") > F.col("f"))
    return again.select("doc", "tie", F.col("start").cast("int").alias("start"), (F.col("start") + LENGTH).cast("int").alias("stop"))


def repeated_runs(scratch: Scratch, contexts: DataFrame) -> DataFrame:
    """(doc, tie, start, stop) of the removed runs that different contexts (context, lead, doc, tie, place) show."""
    found, level = None, parted(contexts.withColumns({"lo": F.lit(0), "hi": F.lit(REACH)}))
    while True:
        kinds = scratch.save(level.groupBy("part").agg(F.count(F.lit(1)).alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("kinds > 1"))
        small, large = kinds.where(F.col("kinds") <= LARGE).select("part"), kinds.where(F.col("kinds") > LARGE)
        runs = sorted_repeats(level.join(checked(small, 16), "part", "left_semi").repartition("part").sortWithinPartitions("part"))
        ends = large.where("lo = hi").select("part")
        if not ends.isEmpty():
            runs = runs.unionByName(equal_windows(level.join(ends, "part")))
        runs = scratch.save(runs)
        found = runs if found is None else found.unionByName(runs)
        large = large.where("lo < hi").select("part")
        if large.isEmpty():
            return found
        level = scratch.save(parted(halved(level.join(large, "part").drop("part"))))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (flat array of byte starts and stops) of each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), F.xxhash64(F.sha2(text, 256)).alias("tie"), F.octet_length(text).alias("size"))
    entries = scratch.save(rows.select("doc", "tie", "size", F.sha2("text", 256).alias("digest")))
    first = entries.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copies = scratch.save(entries.join(first, "digest").where("doc > first").select("doc", "tie", "size").distinct())
    n_copies = copies.count()
    own = rows.join(checked(copies.select("doc", "tie"), 32, n_copies), ["doc", "tie"], "left_anti").where(F.col("size") >= LENGTH)

    all_anchors = scratch.save(anchor_rows(own))
    twice = all_anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    places = scratch.save(all_anchors.join(twice, "h").groupBy("doc", "tie").agg(F.collect_list("place").alias("places")))  # no more than the text has anchors
    scratch.drop(all_anchors)

    contexts = context_rows(own.join(places.hint("merge"), ["doc", "tie"]))
    contexts = contexts.groupBy("context", "lead").agg(F.min(F.struct("doc", "tie", "place")).alias("f")).select("context", "lead", "f.*")
    contexts = scratch.save(contexts)
    runs = repeated_runs(scratch, contexts)

    stays = contexts.groupBy("doc", "tie").agg(F.collect_list("place").alias("stay"))
    found = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    marks = places.join(stays, ["doc", "tie"], "left").join(found, ["doc", "tie"], "left")
    gone = F.array_except("places", F.coalesce("stay", F.array().cast("array<int>")))
    ranges = F.concat(
        F.transform(gone, lambda p: F.struct(F.greatest(p - REACH, F.lit(0)).alias("start"), (p + LENGTH).alias("stop"))),
        F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>")),
    )
    marks = marks.select("doc", "tie", ranges.alias("ranges")).where(F.size("ranges") > 0)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("stop")))
    marks = scratch.save(marks.unionByName(copies.where(F.col("size") >= LENGTH).select("doc", "tie", whole.alias("ranges"))))
    return rows.join(marks.hint("merge"), ["doc", "tie"], "left").select("doc_id", "text", "ranges")


def merged(ranges: list[dict[str, int]], size: int) -> list[tuple[int, int]]:
    """Sorted runs that cover the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(r["start"]), min(int(r["stop"]), size)) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs, start and stop in turn) and kept (remaining bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, spans, kept = [], [], []
            for data, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                runs = merged(ranges, len(data)) if ranges else []
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                spans.append(edges[1:-1])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = removed_spans(docs).select("doc_id", F.col("text").cast("binary").alias("text"), "ranges")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<int>, kept binary")


def op10(spark, sf_dir: str) -> DataFrame:
    done = dedup(documents(spark, sf_dir))
    n_kept = F.octet_length("kept").cast("long")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
