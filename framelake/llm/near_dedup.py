"""Near-duplicate documents: MinHash bands, compared signatures, verified links, connected components.

A text's set holds the hashes (64 bits) of its distinct word shingles. `BANDS` x
`ROWS` universal hash minima are cut into bands; texts that agree on a band share
a bucket. Texts with equal sets are one node first. Then two rounds:

1. Stars. Each bucket pairs its members with one pivot: the member whose buckets
   are largest, which in a group of near copies is the text that most of them
   resemble. A member meets the same pivot in most buckets, so pairs grow with
   the members. Pairs are confirmed on full sets; the links' components are found.
2. The rest. Buckets that still hold members of two components are compared for
   good, inside the task that holds them: signatures of `LONG` minima (8 bits
   each) of two members of different components. A bucket's largest component
   is dealt over tasks and meets only the members outside it, which are dealt
   too, so no task holds a large bucket. Only pairs whose signatures come near
   the similarity leave the task, and of those that surely reach it only as many
   as join components. These are confirmed on full sets as well. Should a sure
   pair fail, the round is repeated without leaving any pair out.

At a similarity of 0.8 two texts share no bucket with a chance of
(1 - 0.8 ** ROWS) ** BANDS, about 3e-6, and their long signatures agree less than
`NEAR` with a chance of about 3e-6.

Defined results: a text with fewer words than a shingle is one shingle; a text
without words, or null, has an empty set and is linked with nothing. Rows with
one doc_id are one node. A null doc_id is linked with nothing, has a null
component and stays. An empty table gives an empty result. Other columns are
not read; `dedup` returns them unchanged. Where ids are null or repeat, `dedup`
takes each (doc_id, text) as a node, null ids last, and keeps one row of a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, documents, sliced, without_ids, without_rows
from framelake.llm.components import components
from framelake.llm.shingles import Signer, mixed, shingle_sets
from framelake.operators.curate import offset_rank

SHINGLE_WORDS = 5
SIMILARITY = 80  # of 100
BANDS, ROWS = 32, 5
#: Minima of a long signature; of each 8 bits are kept, so unequal ones agree once in 256.
LONG = 1024
#: Agreement of long signatures: 4.5 standard errors below and 5.6 above what the similarity gives.
NEAR, SURE = 762, 891
#: Members of a bucket that a task holds of either side.
SIDE = 4096
#: Bytes of sets and number of pairs that are confirmed together, about.
CELL_BYTES, CELL_PAIRS = 32 << 20, 200_000


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, n_shingles, set_digest, tie (its first 8 bytes) and bands (hashes of the bands' minima) of each row; the last three are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(BANDS * ROWS)
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle_words)
            digests = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            bands = [band_hashes(sign(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([d and tie(d) for d in digests], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_digest", "tie", "bands"],
            )

    return as_bytes(docs).mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, tie long, bands array<long>")


def tie(digest: bytes) -> int:
    return int.from_bytes(digest[:8], signed=True)


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """A number for each band, which holds the band's place: equal numbers are equal bands."""
    rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed((h ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def long_signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(id, tie, signature): `LONG` minima, 8 bits of each, of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(LONG, seed=2)
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle_words)
            # The upper bits of minima are alike in large sets; a product's upper bits depend on all of them.
            slots = [(sign(s) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes() for s in sets]
            ties = [tie(xxhash.xxh3_128_digest(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ties, pa.int64()), pa.array(slots, pa.binary())], names=["id", "tie", "signature"])

    return as_bytes(docs).mapInArrow(run, "id long, tie long, signature binary").dropDuplicates(["id", "tie"])


def as_bytes(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select("doc_id", *names, F.col("text").cast("binary").alias("text"))


def members_of(reps: DataFrame) -> DataFrame:
    """(bucket, id, tie, n, mates) of reps (id, tie, n, bands): a row for each band whose bucket has two members or more."""
    rows = reps.select("id", "tie", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1")
    return rows.join(shared, "bucket")


def alike_in_size(a: Column | str, b: Column | str) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def stars(members: DataFrame) -> DataFrame:
    """Pairs (u, v, nu, nv), u < v, of members with their buckets' pivots."""
    weight = members.groupBy("id").agg(F.sum(F.length(F.bin("mates"))).alias("weight"))  # of the logarithms of its buckets' sizes
    heavy = members.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id", "n")).alias("p"))
    met = members.join(heavy, "bucket").where((F.col("id") != F.col("p.id")) & alike_in_size("n", F.col("p.n")))
    me, other = F.struct("id", "n"), F.struct("p.id", "p.n")
    both = met.select(F.least(me, other).alias("a"), F.greatest(me, other).alias("b"))
    return both.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv")).distinct()


def confirmed(scratch: Scratch, docs: DataFrame, pairs: DataFrame, shingle_words: int) -> DataFrame:
    """Pairs (u, v) of pairs (u, v, nu, nv, a saved table) whose whole sets reach the similarity.

    Ids are dealt into blocks, pairs into cells of two blocks, and each text goes
    once to a cell that has a pair of it: as often as it has pairs at most, and
    no oftener than there are blocks.
    """
    ids = pairs.select(F.col("u").alias("id"), F.col("nu").alias("n")).union(pairs.select("v", "nv")).distinct()
    n_ids, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-2 * 8 * size // CELL_BYTES), int((2 * pairs.count() / CELL_PAIRS) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    cells = pairs.select("u", "v", (F.least(block("u"), block("v")) * blocks + F.greatest(block("u"), block("v"))).alias("cell"))
    wanted = scratch.save(cells.select("cell", F.col("u").alias("id")).union(cells.select("cell", "v")).distinct())
    texts = docs.where("text is not null").select("doc_id", "text").join(checked(wanted, 24), F.col("doc_id") == F.col("id"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in sliced(right.to_batches()):
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), shingle_words)):
                sets.setdefault(i, []).append(s)
        u, v = left.column("u").to_numpy(), left.column("v").to_numpy()
        good = np.fromiter((any(reach(a, b) for a in sets.get(i, ()) for b in sets.get(j, ())) for i, j in zip(u.tolist(), v.tolist())), bool, len(u))
        return pa.table({"u": u[good], "v": v[good]})

    return cells.groupBy("cell").cogroup(as_bytes(texts, "cell").groupBy("cell")).applyInArrow(run, "u long, v long")


def reach(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) reach the similarity."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < SIMILARITY * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two runs to merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= SIMILARITY * (small + large - common)


def dealt(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets with two components or more, dealt into cells (bucket, kind, a, b), with chunk and is_major.

    The members outside a bucket's largest component form p chunks, those inside
    it q. Kind 0: minor chunk a meets major chunk b, and with b = 0 itself. Kind
    1: minor chunk a meets minor chunk b.
    """
    labelled = members.join(groups, F.col("id") == F.col("node"), "left").select("bucket", "id", "tie", "n", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    split = sizes.groupBy("bucket").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chunks = lambda k: F.ceil(k / SIDE)
    split = split.select("bucket", F.col("top.component").alias("top"), chunks(F.col("all") - F.col("top.k")).alias("p"), chunks(F.col("top.k")).alias("q"))
    rows = labelled.join(split, "bucket").withColumn("is_major", F.col("component") == F.col("top"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("is_major"), F.col("q")).otherwise(F.col("p"))))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    me = F.col("chunk")
    others = F.transform(F.filter(upto(F.col("p")), lambda i: i != me), lambda i: cell(1, F.least(i, me), F.greatest(i, me)))
    cells = F.when(F.col("is_major"), F.transform(upto(F.col("p")), lambda i: cell(0, i, me))).otherwise(F.concat(F.transform(upto(F.col("q")), lambda j: cell(0, me, j)), others))
    return rows.withColumn("cell", F.explode(cells)).select("bucket", "cell.*", "chunk", "is_major", "id", "tie", "n", "component")


def resembling(rows: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs (u, v, nu, nv, sure) of different components that come near the similarity, of dealt rows with bands and signature.

    A pair is looked at in the first bucket that it shares. Unless `all_pairs`,
    pairs whose components sure pairs of the same cell join are left out.
    """
    key = ["bucket", "kind", "a", "b"]
    sure_at = LONG + 1 if all_pairs else SURE

    def work(bucket: int, kind: int, a: int, b: int, part: pa.Table) -> Iterator[tuple[int, int, int, int, bool]]:
        first = ~part.column("is_major").to_numpy(zero_copy_only=False) if kind == 0 else part.column("chunk").to_numpy() == a
        order = np.argsort(~first, kind="stable")
        ids, n, component = (part.column(c).to_numpy()[order] for c in ("id", "n", "component"))
        bands = np.stack(part.column("bands").to_numpy()[order])
        slots = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, LONG)[order]
        place = (bands == bucket).argmax(1)
        label = np.unique(component, return_inverse=True)[1]
        n_first, among = int(first.sum()), kind == 0 and b == 0
        for i in range(n_first):
            at = np.arange(i + 1 if among else n_first, len(ids))
            at = at[(label[at] != label[i]) & (100 * np.minimum(n[at], n[i]) >= SIMILARITY * np.maximum(n[at], n[i]))]
            if len(at):
                at = at[~(bands[at, : place[i]] == bands[i, : place[i]]).any(1)]
            for block in range(0, len(at), 4096):
                near = at[block : block + 4096]
                agree = (slots[near] == slots[i]).sum(1)
                near, agree = near[agree >= NEAR], agree[agree >= NEAR]
                for j in near[agree >= sure_at][np.argsort(-agree[agree >= sure_at], kind="stable")].tolist():
                    if label[i] != label[j]:
                        yield (*pair(ids, n, i, j), True)
                        label[label == label[j]] = label[i]
                for j in near[(agree < sure_at) & (label[near] != label[i])].tolist():
                    yield (*pair(ids, n, i, j), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, int, bool]] = []
        for group in runs_of(batches, key):
            found += work(*(group.column(c)[0].as_py() for c in key), group)
            if len(found) > 10_000:
                yield rows_of(found)
                found = []
        yield rows_of(found)

    names = ["u", "v", "nu", "nv", "sure"]
    rows_of = lambda found: pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.bool_() if k == 4 else pa.int64()) for k in range(5)], names=names)
    return rows.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(run, "u long, v long, nu long, nv long, sure boolean")


def pair(ids: np.ndarray, n: np.ndarray, i: int, j: int) -> tuple[int, int, int, int]:
    if ids[j] < ids[i]:
        i, j = j, i
    return int(ids[i]), int(ids[j]), int(n[i]), int(n[j])


def runs_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Each group of equal keys of sorted rows, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_groups(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near")
    sketch = scratch.save(sketches(docs, shingle_words))
    known = sketch.where("doc_id is not null and n_shingles > 0")
    # Bands depend on the set alone, so any row of the class will do.
    same = scratch.save(known.groupBy("set_digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"), F.min("tie").alias("tie"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")))
    reps = same.select("id", "tie", "n", "bands")
    members = scratch.save(members_of(reps))
    # A doc_id with texts of several sets links their classes.
    odd = known.groupBy("doc_id").agg(F.min("set_digest").alias("lo"), F.max("set_digest").alias("hi")).where("lo <> hi").select("doc_id")
    links = known.join(odd, "doc_id", "left_semi").join(same.select("set_digest", "id"), "set_digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).where("u <> v")

    pairs = scratch.save(stars(members))
    links = scratch.save(links.union(confirmed(scratch, docs, pairs, shingle_words)).distinct())
    groups = components(scratch, links)
    open_rows = scratch.save(dealt(members, groups))
    if not open_rows.isEmpty():
        ids = open_rows.select(F.col("id").alias("doc_id")).distinct()
        signed = scratch.save(long_signatures(docs.where("text is not null").join(checked(ids, 16), "doc_id", "left_semi"), shingle_words))
        rows = open_rows.join(reps.select("id", "tie", "bands"), ["id", "tie"]).join(signed, ["id", "tie"])
        for all_pairs in (False, True):
            scratch.drop(pairs)
            pairs = scratch.save(resembling(rows, all_pairs).groupBy("u", "v", "nu", "nv").agg(F.max("sure").alias("sure")))
            found = scratch.save(confirmed(scratch, docs, pairs, shingle_words))
            if pairs.where("sure").join(found, ["u", "v"], "left_anti").isEmpty():
                break
        scratch.drop(signed, pairs)
        if not found.isEmpty():
            # What is known to belong together is a star for each component: new links are added to these.
            links = scratch.save(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").union(found))
            groups = components(scratch, links)
    scratch.drop(members, open_rows)
    copies = same.where("rows > 1").select("set_digest", "id")
    rows = sketch.select("doc_id", "n_shingles", "set_digest").join(copies, "set_digest", "left").withColumn("node", F.coalesce("id", "doc_id"))
    out = rows.join(groups, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows of a near-duplicate group but its smallest doc_id; all columns stay."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return without_ids(docs, near_groups(docs, **options).where("not kept").select("doc_id"))
    scratch = Scratch(docs.sparkSession, "nodes")
    digest, order = F.coalesce(F.sha2("text", 256), F.lit("")), (F.col("doc_id").asc_nulls_last(), F.col("digest"))
    keys = docs.select("doc_id", digest.alias("digest")).distinct().repartitionByRange(*order)
    keys = scratch.save(keys.withColumn("part", F.spark_partition_id()))
    nodes = scratch.save(offset_rank(keys, "part", *order, name="node").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "node"))
    rows = docs.select("doc_id", "text", digest.alias("digest")).join(nodes, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
    rows = scratch.save(rows.select(F.col("node").alias("doc_id"), "text"))
    found = near_groups(rows, **options).select(F.col("doc_id").alias("node"), "kept").join(nodes, "node")
    return without_rows(docs, digest, found.select(F.col("id").alias("doc_id"), F.col("of").alias("digest"), "kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle_words=2)
