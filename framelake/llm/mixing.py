"""Mixing sources to target weights in fixed-length blocks.

Each source's documents are packed, in a pseudorandom order, into one stream of
words that is cut into blocks of `block_words` (the last is shorter). A source's
target words give its number of slots, and these its share of all slots. Each slot
of each output shard draws its source by that share, with a hash as the random
number, so that a shard's counts by source are a multinomial draw. Independent
draws miss the sources' numbers of slots by about their square root; then, as a
correction, the last slots of each source that has drawn too many go, in order, to
the sources that have drawn too few, and each meets its number. In pass j div
blocks, a source's j-th slot takes the block at the permuted index of j mod
blocks; a short last block ends its pass, and the last slot takes only the words
that are still missing, so that each source meets its target to the word. Blocks are
joined to slots by their index. Permutations are swap-or-not shuffles, exact for
any length and computed from the index alone.

Targets: sources in code point order (null last) weigh `weights` in turn and
share `share` of all words; a target stops at `cap` times its source's words and
the excess is shared by weight among the others until none is above.

Streams are laid out by chunks of about CHUNK_ROWS documents (a hash of doc_id and
text), so that no window holds a source. Sources may be many: their order, shares
and numbers are running sums over parts, and slots find their source by cells of
the numbers that a source's slots have.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source of its own; null ids are documents like others. Repeated rows
are packed one after another, each with its own words. A source without words
has target 0. An empty table gives an empty result. Other columns are not read;
`mix` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, documents, packed, text_or_empty, unpacked, word_count, words
from framelake.operators.order import PART, parted, ranked, running

BLOCK_WORDS = 512
SHARD_SLOTS = 2048
CHUNK_ROWS = 4096
SHARDS_A_TASK = 32
ROUNDS = 12
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 20


def shuffled(index: Column, length: Column, *key: Column) -> Column:
    """The place of index in a pseudorandom permutation of 0 .. length - 1, chosen by key.

    Swap-or-not: each round pairs x with k - x mod length and swaps the pair or not.
    """
    rounds = F.array(*[F.xxhash64(F.lit(r), *key) for r in range(ROUNDS)])

    def swap(x: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(k, length) - x, length)
        return F.when(F.xxhash64(k, F.greatest(x, partner)) % 2 == 0, partner).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), swap)


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source_no, source, source_size, weight, target of sizes (source, size): a row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = ranked(s, F.col("source").asc_nulls_last(), name="source_no").withColumn("source_no", F.col("source_no") - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int")).cast("long"))
    s = s.withColumn("limit", cap * F.col("source_size"))
    # Sources reach their cap in the order of cap over weight: the level at which each would be capped.
    fill = F.col("limit") / F.col("weight")
    up = parted(s, fill, F.col("source_no"))
    up = running(up, {"limits": F.col("limit"), "weights": F.col("weight")}, by=[], order=[fill, F.col("source_no")]).drop(PART)
    sums = s.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight")).withColumn("_k", F.lit(0))
    up = up.withColumn("_k", F.lit(0)).join(F.broadcast(sums), "_k")  # one row
    left = F.lit(share) * F.col("all_words") - (F.col("limits") - F.col("limit"))
    up = up.withColumn("level", left / (F.col("all_weight") - (F.col("weights") - F.col("weight"))))
    first = up.where(fill > F.col("level")).agg(F.min(F.struct(fill.alias("fill"), "source_no", "level")).alias("f")).select(F.col("f.level").alias("_level"), F.lit(0).alias("_k"))
    up = up.join(F.broadcast(first), "_k")
    target = F.when(F.col("_level").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("_level")))
    return up.select("source_no", "source", "source_size", "weight", target.alias("target"))


def by_cells(points: DataFrame, at: str, ranges: DataFrame, first: str, size: str) -> DataFrame:
    """points with the columns of the range that holds each: an equi-join on cells of CHUNK_ROWS numbers, however many or long ranges are."""
    cell = lambda c: F.floor(c / CHUNK_ROWS)
    r = ranges.where(F.col(size) > 0).withColumn("_cell", F.explode(F.sequence(cell(F.col(first)), cell(F.col(first) + F.col(size) - 1))))
    inside = (F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(size))
    return points.withColumn("_at", cell(F.col(at))).join(r, (F.col("_at") == F.col("_cell")) & inside).drop("_at", "_cell")


class Mix:
    """One mix of docs (doc_id, source, text): `rows`, `sources`, `slots`, `pieces` are its tables."""

    def __init__(self, docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, **shares):
        self.scratch = Scratch(docs.sparkSession, "mix")
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        sized = self.scratch.save(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), F.xxhash64("text").alias("text_hash")))
        n_rows = sized.count()
        self.sources = self.scratch.save(targets(sized, **shares))
        self.n_sources = self.sources.count()
        self.rows = self.scratch.save(self._laid_out(sized, max(1, -(-n_rows // CHUNK_ROWS))))
        self.slots = self.scratch.save(self._dealt())

    def _laid_out(self, sized: DataFrame, n_chunks: int) -> DataFrame:
        """Each row with `start`, its first word's place in its source's stream."""
        rows = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(self.seed)), F.lit(n_chunks)))
        rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        totals = rows.groupBy("source_key", "chunk").agg(F.sum("size").alias("words"))
        totals = parted(totals, F.col("source_key"), F.col("chunk"))
        bases = running(totals, {"upto": F.col("words")}, by=["source_key"], order=[F.col("chunk")]).select("source_key", "chunk", (F.col("upto") - F.col("words")).alias("base"))
        inside = Window.partitionBy("source_key", "chunk").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        rows = rows.join(bases, ["source_key", "chunk"]).withColumn("start", F.col("base") + F.col("inside"))
        sources = self.sources.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
        return rows.join(checked(sources, 128, self.n_sources), "source_key").select("doc_id", "source", "size", "text_hash", "start", "source_no", "source_size", "target")

    def _numbered(self) -> DataFrame:
        """The sources that have a target, with their slots: n_slots, and `first`, the slots of the sources before."""
        size = F.lit(self.block_words)
        s = self.sources.where("target >= 1").withColumn("want", F.floor("target"))
        s = s.withColumns({"n_full": F.floor(F.col("source_size") / size), "n_blocks": F.ceil(F.col("source_size") / size)})
        s = s.withColumns({"passes": F.floor(F.col("want") / F.col("source_size")), "rest": F.col("want") % F.col("source_size")})
        s = s.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / size))
        s = running(parted(s, F.col("source_no")), {"upto": F.col("n_slots")}, by=[], order=[F.col("source_no")]).drop(PART)
        return self.scratch.save(s.withColumn("first", F.col("upto") - F.col("n_slots")).drop("upto"))

    def _drawn(self, sources: DataFrame) -> DataFrame:
        """shard, slot, source_no and j, the slot's number among those of its source: a multinomial draw, and its correction."""
        total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
        spark, per = self.scratch.spark, self.shard_slots
        shards = -(-total // per)
        ids = spark.range(0, shards, 1, max(1, -(-shards // SHARDS_A_TASK))).withColumnRenamed("id", "shard")
        last = F.least(F.lit(per).cast("long"), F.lit(total) - F.col("shard") * per) - 1
        slots = ids.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        slots = slots.withColumn("x", F.pmod(F.xxhash64(F.lit(self.seed), "shard", "slot"), F.lit(max(1, total))))
        drawn = self.scratch.save(by_cells(slots, "x", sources.select("source_no", "first", "n_slots"), "first", "n_slots").select("shard", "slot", "source_no"))
        counts = parted(drawn.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n")), F.col("source_no"), F.col("shard"))
        counts = running(counts, {"upto": F.col("n")}, by=["source_no"], order=[F.col("shard")]).select("shard", "source_no", (F.col("upto") - F.col("n")).alias("before"), "n")
        inside = F.row_number().over(Window.partitionBy("shard", "source_no").orderBy("slot")) - 1
        drawn = drawn.withColumn("_i", inside).join(counts, ["shard", "source_no"]).withColumn("j", F.col("before") + F.col("_i"))
        got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
        both = sources.select("source_no", "n_slots").join(got, "source_no", "left").na.fill(0, ["got"])
        over, under = F.greatest(F.col("got") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("got"), F.lit(0))
        both = both.withColumns({"over": over, "under": under})
        both = running(parted(both, F.col("source_no")), {"overs": F.col("over"), "unders": F.col("under")}, by=[], order=[F.col("source_no")])
        both = self.scratch.save(both.select("source_no", "n_slots", "got", (F.col("overs") - F.col("over")).alias("over_at"), "under", (F.col("unders") - F.col("under")).alias("under_at")))
        drawn = drawn.select("shard", "slot", "source_no", "j").join(both.select("source_no", "n_slots", "over_at"), "source_no")
        stays = drawn.where("j < n_slots").select("shard", "slot", "source_no", "j")
        goes = drawn.where("j >= n_slots").select("shard", "slot", (F.col("over_at") + F.col("j") - F.col("n_slots")).alias("m"))
        moved = by_cells(goes, "m", both.select("source_no", "got", "under", "under_at"), "under_at", "under")
        return stays.unionByName(moved.select("shard", "slot", "source_no", (F.col("got") + F.col("m") - F.col("under_at")).alias("j")))

    def _dealt(self) -> DataFrame:
        """A row a slot: shard, slot, source_no, pass, block, and words (of a cut last slot: fewer)."""
        size = F.lit(self.block_words)
        s = self._numbered()
        j = self._drawn(s).join(s.select("source_no", "source_size", "n_full", "n_blocks", "passes", "rest"), "source_no")
        j = j.withColumn("pass", F.floor(F.col("j") / F.col("n_blocks"))).withColumn("k", F.col("j") % F.col("n_blocks"))
        # Full blocks are permuted; the short last block, if any, ends each pass.
        block = F.when(F.col("k") < F.col("n_full"), shuffled(F.col("k"), F.col("n_full"), F.lit(self.seed), F.col("source_no"), F.col("pass"))).otherwise(F.col("k"))
        end = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
        cut = F.least(size, end - F.col("k") * size)
        return j.select("shard", "slot", "source_no", "pass", block.alias("block"), cut.cast("long").alias("words"))

    def shard_counts(self) -> DataFrame:
        """How many slots of each shard each source has."""
        return self.slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("slots"))

    def overlaps(self) -> DataFrame:
        """rows by the blocks they touch: block, and from lo to hi the words in it that are theirs."""
        size = F.lit(self.block_words)
        first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
        touched = self.rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        at = F.col("block") * size
        return touched.withColumn("lo", F.greatest(F.col("start") - at, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - at, size))

    def taken(self) -> DataFrame:
        """rows with `taken`, the words of theirs that the mix takes, repeats counted."""
        uses = self.slots.groupBy("source_no", "block").agg(F.collect_list("words").alias("ends"))  # one a pass
        own = F.aggregate("ends", F.lit(0).cast("long"), lambda a, end: a + F.greatest(F.least(F.col("hi"), end) - F.col("lo"), F.lit(0)))
        joined = self.overlaps().join(uses, ["source_no", "block"], "left")
        keys = ["doc_id", "source", "size", "source_size", "target", "start", "text_hash"]
        # Rows without words repeat their keys and have 0 each; `copies` brings repeats back.
        out = joined.groupBy(*keys).agg(F.coalesce(F.sum(own), F.lit(0)).alias("taken"), F.count_if(F.col("size") == 0).alias("copies"))
        return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1))))).drop("copies", "start", "text_hash")

    def pieces(self) -> DataFrame:
        """A row for each document and pass that takes any of it: `parts`, the word ranges taken, and whether that is all."""
        joined = self.overlaps().join(self.slots, ["source_no", "block"]).withColumn("hi", F.least("hi", "words")).where("lo < hi")
        shift = F.col("block") * self.block_words - F.col("start")
        part = F.struct((F.col("lo") + shift).alias("lo"), (F.col("hi") + shift).alias("hi"))
        grouped = joined.groupBy("doc_id", "source", "size", "text_hash", "start", "pass").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("n"))
        return grouped.select("doc_id", F.col("source").alias("_source"), "text_hash", "pass", "parts", (F.col("n") == F.col("size")).alias("whole"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: one row for each pass that takes words of a document, with the taken words as text.

    A document that a pass takes whole keeps its text as it is. Rows that are
    equal in doc_id, source and text count as one here. All columns stay.
    """
    once = packed(docs, "doc_id", "source", "text", F.xxhash64("text").alias("_hash")).dropDuplicates(["doc_id", "source", "_hash"])
    once = Scratch(docs.sparkSession, "mixed").save(once)
    pieces = Mix(once.select("doc_id", "source", "text"), **options).pieces().withColumnRenamed("doc_id", "_doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("text_hash"))
    out = once.join(pieces, same).withColumn("_words", F.when(~F.col("whole"), words(text_or_empty())))
    part = F.flatten(F.transform("parts", lambda p: F.slice("_words", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int"))))
    out = out.withColumn("_text", F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(part, " ")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **new)


def op7(spark, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir).select("doc_id", "source", "text")).taken().select("doc_id", "size", "source_size", "target", "taken", "source")
