"""Quality rules: repetition counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (each word, and each two neighbours) are
estimated, one from trusted rows and one from all rows (each n-gram of each text
counts). A weight is the logarithm of an n-gram's share among the trusted over its
share in all, shrunk toward 0 by `PRIOR` occurrences that are dealt as all rows
are: words that the corpus holds seldom say next to nothing, so clean texts whose
words no trusted text holds aren't taken for junk, while common n-grams that the
trusted texts avoid weigh heavily. A text's verdict is the mean weight of its
n-grams: length-normalised, and compared with a fixed threshold. Weights are
rounded to integers, so that sums do not depend on the order of rows and reruns
give the same verdict for every text. The model has `buckets` numbers, whatever
the corpus; only these reach the driver.

Defined results: a null text has no words and fails the base rule; so does an
empty text. Null ids are scored like others; a null id is never trusted. Without
trusted rows all weights are 0 and the ratio rejects nothing. Rows that repeat
are counted and scored each. An empty table gives an empty result. Other columns
stay in `keep` and are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import BROADCAST_BYTES, Scratch, documents, let, text_or_empty, words

BUCKETS = 1 << 16
#: Weights are whole multiples of 1 / SCALE.
SCALE = 1 << 16
#: Mean log-likelihood ratio below which a text is rejected.
MIN_RATIO = -0.1
#: Occurrences by which the weight of an n-gram is shrunk.
PRIOR = 50
WINDOW = 5


@dataclass(frozen=True)
class RatioModel:
    """Integer weights by bucket."""

    weights: list[int]

    def total(self, h: Column) -> Column:
        """Sum of the weights of the n-grams of a text, from the hashes of its words."""
        # A text literal that the optimizer folds into one constant array.
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")
        one, two = grams(h, len(self.weights))
        zero = F.lit(0).cast("long")

        def added(t: Column) -> Column:
            step = lambda a, i: a + F.get(t, one(i)) + F.when(i > 0, F.get(t, two(i))).otherwise(0)
            return F.aggregate(places(h), zero, step)

        return let(table, added)


def hashed(w: Column) -> Column:
    """64 bits of each word; whatever looks at words again and again looks at these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def places(h: Column) -> Column:
    return F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))


def grams(h: Column, buckets: int) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """The bucket of the word at a place, and of that word and the one before it, by the words' hashes."""
    at = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    return lambda i: at(F.get(h, i)), lambda i: at(F.xxhash64(F.get(h, i - 1), F.get(h, i)))


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(b, raw, good): how often the texts of docs (text, is_trusted) hold each bucket's n-grams. Map-side aggregation leaves at most `buckets` rows a task to shuffle."""

    def both(h: Column) -> Column:
        one, two = grams(h, buckets)
        return F.concat(F.transform(places(h), one), F.transform(F.slice(places(h), 2, F.greatest(F.size(h) - 1, F.lit(0))), two))

    rows = docs.where("text is not null").select("is_trusted", F.explode(let(hashed(words(F.col("text"))), both)).alias("b"))
    return rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("is_trusted").alias("good"))


def fit(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS) -> RatioModel:
    """Weights from all texts of docs against those whose doc_id is in trusted (doc_id).

    Texts are read once, beside the broadcast ids; ids too many for that are joined
    to the trusted texts only, and all texts are counted without a join.
    """
    texts, one = docs.select("doc_id", "text"), F.lit(1).alias("is_trusted")
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    if ids.count() * 24 <= BROADCAST_BYTES:
        counts = counted(texts.join(F.broadcast(ids.select("doc_id", one)), "doc_id", "left"), buckets)
    else:
        good = counted(texts.join(ids, "doc_id", "left_semi").select("text", one), buckets).select("b", "good")
        raw = counted(texts.select("text", F.lit(None).cast("int").alias("is_trusted")), buckets).select("b", "raw")
        counts = raw.join(good, "b", "left").na.fill(0, ["good"])
    counts = Scratch(docs.sparkSession, "ratio").save(counts)
    raw_all, good_all = counts.agg(F.sum("raw"), F.sum("good")).first()
    weights = [0] * buckets
    if good_all:
        share = good_all / raw_all
        ratio = (F.col("good") + PRIOR * share) / ((F.col("raw") + PRIOR) * share)
        for b, x in counts.select("b", F.round(F.log(ratio) * SCALE).cast("int")).collect():  # at most `buckets` rows
            weights[b] = x
    return RatioModel(weights)


def base_counts(h: Column, text: Column) -> dict[str, Column]:
    """The four counts of the base rules; h: the hashes of the words of text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(h),
    }


def repeat_words(h: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that the text holds twice or more, from the words' hashes."""
    at = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h, n)).otherwise(F.lit(0).cast("long")))


def covered(hashes: Column, n: int) -> Column:
    """Places within n of the start of a hash that occurs twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(pairs, lambda ps: F.filter(ps, lambda p, k: (p["h"] == F.get(ps, k - 1)["h"]) | (p["h"] == F.get(ps, k + 1)["h"])))
    starts = F.array_sort(F.transform(twice, lambda p: p["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(n), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


#: What a verdict has.
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio_sum", "n_grams", "base_failed", "kept")


def verdict(text: Column, model: RatioModel, min_ratio: float) -> Column:
    """A struct of n_words, the base counts, base_failed, ratio_sum, n_grams and kept.

    One expression, with the words and their hashes bound once: a filter on a field of it can be
    pushed down without the words being split anew for each of them.
    """
    zero = F.lit(0).cast("long")

    def measured(h: Column) -> Column:
        n = F.size(h).cast("long")
        named = {"n_words": n} | base_counts(h, text) | {"ratio_sum": model.total(h), "n_grams": n + F.greatest(n - 1, zero)}
        return F.struct(*[c.alias(k) for k, c in named.items()])

    def judge(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        kept = ~failed & (c["ratio_sum"] >= c["n_grams"] * F.lit(round(min_ratio * SCALE)))
        return F.struct(*[c[k].alias(k) for k in FIELDS[:-2]], failed.alias("base_failed"), kept.alias("kept"))

    return let(let(hashed(words(text)), measured), judge)


def judged(docs: DataFrame, model: RatioModel, *, min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs (doc_id, text) and the fields of its verdict, which take the place of columns with their names."""
    own, name = [c for c in docs.columns if c not in FIELDS], "_verdict"
    while name in own:
        name += "_"
    return docs.withColumn(name, verdict(text_or_empty(), model, min_ratio)).select(*[F.col(f"`{c}`") for c in own], f"{name}.*")


def trusted_rows(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def keep(docs: DataFrame, trusted: DataFrame, *, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows of docs that pass; all columns of docs, no others."""
    return docs.where(verdict(text_or_empty(), fit(docs, trusted), min_ratio)["kept"])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, trusted_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio_sum", "n_grams")
