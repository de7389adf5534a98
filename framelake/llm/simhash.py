"""SimHash near-duplicates: fingerprints of word shingles, links by anchor points of a covering code, connected components.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes
(XXH64) of a text's shingles, repeats included. Fingerprints link at `DISTANCE`
differing bits or fewer. Equal fingerprints are one node first.

Two fingerprints that link differ in one bit at most in one of three fields of 22,
21 and 21 bits. In each field the anchors are the words of a covering code: 15 of
the field's bits form a word of the perfect Hamming code [15, 11], the others are
free. Its covering radius is 1: each value has one nearest anchor, its home, at a
distance of 1 or less. A value that differs in one bit more lies within 2 = radius +
threshold of that anchor. So each fingerprint is sent to all anchors within 2 (about
15 a field), as a visitor, and at its home it is a host; hosts are compared with
visitors on all 64 bits. No link is lost.

An anchor's rows are dealt into cells of `SIDE` hosts and `SIDE` visitors, so no
task holds a hot anchor. A cell sends on its components, a row for each fingerprint
in one, and not its pairs. Links of all cells go through large-star and small-star.

Defined results: a null text, or one without words, has the fingerprint 0, which
links like any other. A text with fewer words than a shingle is one shingle. Rows
with one doc_id are one node. A null doc_id is linked with nothing and has a null
component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, documents, sliced
from framelake.llm.components import components

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
#: (lowest bit, bits) of the fields.
FIELDS = ((0, 22), (22, 21), (43, 21))
#: Of a field's bits, those in the Hamming code.
CODE = 15
#: Hosts, and visitors, of an anchor that one task compares.
SIDE = 4096
#: Words hashed, and pairs compared, at a time.
WORDS, PAIRS = 1 << 14, 1 << 20
_U = np.uint64


def fingerprint(text: bytes, shingle_words: int) -> int:
    """The fingerprint of a text (UTF-8), as a signed number."""
    words = text.lower().split()  # bytes: lowers A-Z only, parts at the six white space characters
    if not words:
        return 0
    k = min(shingle_words, len(words))
    total, ones = len(words) - k + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, WORDS):
        own = words[at : at + WORDS + k - 1]
        line = b" ".join(own)
        stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.append(0, stops[:-1] + 1)
        n = len(own) - k + 1
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[k - 1 :].tolist())), _U, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [fingerprint(t or b"", shingle_words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def syndromes(x: np.ndarray) -> np.ndarray:
    """The place (from 1) of the code bit in which each value of a field differs from its nearest anchor; 0 for anchors."""
    out = np.zeros(len(x), _U)
    for k in range(CODE):
        out ^= (x >> _U(k) & _U(1)) * _U(k + 1)
    return out


def anchors(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, anchor, whether it is the home) of all anchors within 2 of each value of a field."""
    flips = np.array([0, *(1 << i for i in range(bits)), *(1 << i | 1 << j for i in range(bits) for j in range(i))], _U)
    own, turned = syndromes(x), syndromes(flips)
    at, found, home = [], [], []
    for flip, t in zip(flips, turned):
        here = np.flatnonzero(own == t)  # turning these bits leads to an anchor
        at.append(here)
        found.append(x[here] ^ flip)
        home.append(np.full(len(here), flip == (_U(1) << (t - _U(1)) if t else _U(0))))
    return np.concatenate(at), np.concatenate(found), np.concatenate(home)


def hosted(nodes: DataFrame) -> DataFrame:
    """(anchor, host, fp): rows of nodes (fp) at each anchor within 2, and at their homes as hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(start, 4096).to_numpy()
                for f, (low, bits) in enumerate(FIELDS):
                    at, anchor, home = anchors(fp.view(_U) >> _U(low) & _U((1 << bits) - 1), bits)
                    key = (anchor | _U(f << 22)).astype(np.int32)
                    # A host is a visitor of its own anchor too.
                    host = np.repeat([False, True], [len(at), int(home.sum())])
                    key, at = np.append(key, key[home]), np.append(at, at[home])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(host), pa.array(fp[at])], names=["anchor", "host", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor int, host boolean, fp long")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links (u, v) as links of each node to the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[root])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root < np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) of fingerprints, of rows (anchor, host, fp): the components of each cell."""
    sizes = rows.groupBy("anchor").agg(F.sum(F.col("host").cast("long")).alias("hosts"), F.count(F.lit(1)).alias("all"))
    hot = sizes.where(F.col("all") > SIDE).select("anchor", F.greatest(F.lit(1), F.ceil(F.col("hosts") / SIDE)).cast("int").alias("p"), F.ceil((F.col("all") - F.col("hosts")) / SIDE).cast("int").alias("q"))
    rows = rows.join(checked(hot, 16), "anchor", "left").fillna(1, ["p", "q"])
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("host"), F.col("p")).otherwise(F.col("q"))).cast("int")
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cells = F.when(F.col("host"), F.transform(upto(F.col("q")), lambda j: cell(mine, j))).otherwise(F.transform(upto(F.col("p")), lambda i: cell(i, mine)))
    rows = rows.select("anchor", F.explode(cells).alias("cell"), "host", "fp").select("anchor", "cell.*", "host", "fp")
    key = ["anchor", "i", "j"]

    def found(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked fingerprints of whole cells, some pairs at a time; rows are sorted by cell, hosts last."""
        host, fp = part.column("host").to_numpy(), part.column("fp").to_numpy()
        of = np.cumsum(borders(part, key)) - 1
        begin = np.flatnonzero(borders(part, key))[of]
        visitors = np.bincount(of, ~host)[of].astype(np.int64)
        hosts = np.flatnonzero(host & (visitors > 1))
        n, first = visitors[hosts], begin[hosts]
        ends = np.cumsum(n)
        at = 0
        while at < len(hosts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
            k = n[at:stop]
            i = np.repeat(hosts[at:stop], k)
            j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[at:stop], k)
            good = (np.bitwise_count((fp[i] ^ fp[j]).view(_U)) <= distance) & (fp[i] != fp[j])
            yield fp[i[good]], fp[j[good]]
            at = stop

    def thin(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([s[0] for s in some], [s[1] for s in some]))
        u, v = stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in whole(batches, key):
            for u, v in found(part):
                held.append((u, v))
                size += len(u)
                if size > PAIRS:
                    yield thin(held)
                    held, size = [], 0
        yield thin(held)

    return rows.repartition(*key).sortWithinPartitions(*key, "host").mapInArrow(run, "u long, v long").distinct()


def borders(part: pa.Table, key: list[str]) -> np.ndarray:
    """Whether each row of a sorted table begins a new key."""
    new = np.zeros(part.num_rows, bool)
    new[:1] = True
    for c in key:
        values = part.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def whole(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables of about a batch that end where a key does."""
    held: list[pa.Table] = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        begins = np.flatnonzero(borders(part, key))
        goes_on = bool(held) and all(part.column(c)[0] == held[0].column(c)[0] for c in key)
        if len(begins) == 1 and goes_on:
            held.append(part)
            continue
        last = int(begins[-1])
        if held or last:
            yield pa.concat_tables([*held, part.slice(0, last)])
        held = [part.slice(last)]  # one key
    if held:
        yield pa.concat_tables(held)


def simhash_groups(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row of docs (doc_id, text)."""
    if distance > DISTANCE:
        raise ValueError(f"anchors within 2 cover distances up to {DISTANCE}")
    scratch = Scratch(docs.sparkSession, "simhash")
    sketch = scratch.save(fingerprints(docs, shingle_words=shingle_words))
    known = sketch.where("doc_id is not null")
    nodes = scratch.save(known.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # A doc_id with several fingerprints links them.
    odd = known.groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).where("v <> hi")
    same = known.join(odd, "doc_id").select(F.col("fp").alias("u"), "v").where("u <> v")
    near = scratch.save(same.union(links(hosted(nodes), distance)).distinct())
    groups = components(scratch, near)
    labelled = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    labelled = scratch.save(labelled.join(least, "component").select(F.col("fp").alias("of"), "component_id"))
    out = sketch.join(labelled, F.col("fp") == F.col("of"), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op11(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
