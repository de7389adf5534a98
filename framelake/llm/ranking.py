"""Document quality by Bradley-Terry pairwise ranking.

Each preference pair is a document labelled 1 against one labelled 0. The chance
that the first wins is the logistic function of the difference of their scores,
so a linear score is fitted by logistic loss on differences of features (Newton
steps with a ridge). Features are general counts of a text and the shares of its
byte trigrams, hashed into `BUCKETS`, so that what tells the labels apart is
learned and not written down. Scores are thresholded at a quantile: the share of 0 labels
among the training rows. A score is shifted before the logistic function so that
this quantile becomes `THRESHOLD`, and documents at or above it are predicted 1.

Learning takes at most `MAX_LABELLED` labelled documents, those with the smallest hash
of their doc_id (of rows that repeat one, the least features), and `PAIRS_EACH` partners for each row of the rarer label; the
driver gets their features, never texts. All documents are scored.

Defined results: null and empty texts are scored like others, from features that
are 0. Null ids are scored and never learned from. Null labels are left out; of
repeated labels of a doc_id the smallest counts. Without both labels all scores
are 0.5. Repeated rows score the same; an empty table gives an empty result.
Labels, language, source and ids are no features; other columns are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import documents, sliced, text_or_empty

MAX_LABELLED = 20_000
PAIRS_EACH = 16
#: Hashed byte trigrams.
BUCKETS = 256
RIDGE = 1e-2
THRESHOLD = 0.3
FOLDS = 5

COUNTS = (
    "symbol_chars", "upper_letters", "digit_chars", "punctuation", "stop_ends", "distinct_words", "adjacent_repeats", "top_word", "distinct_lines", "top_line", "mean_word", "short_words", "long_words", "log_words", "words_a_line",
)
_SYMBOLS = "#*$%&<>@~^_=+\\{}[]|"
_DROP_SYMBOLS = str.maketrans("", "", _SYMBOLS)
_DROP_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DROP_DIGITS = str.maketrans("", "", "0123456789")


def counted(text: str) -> list[float]:
    """Numbers about a whole text that hold for any language."""
    words = text.split()
    if not words:
        return [0.0] * len(COUNTS)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n, chars = len(words), len(text)
    counts, line_counts = Counter(words), Counter(lines)
    lengths = list(map(len, words))
    return [
        (chars - len(text.translate(_DROP_SYMBOLS))) / chars,
        (chars - len(text.translate(_DROP_UPPER))) / chars,
        (chars - len(text.translate(_DROP_DIGITS))) / chars,
        sum(map(text.count, ",;:?!\"'()")) / chars,
        (text.count(". ") + text.count(".\n")) / n,
        len(counts) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        max(counts.values()) / n,
        len(line_counts) / max(1, len(lines)),
        max(line_counts.values(), default=0) / max(1, len(lines)),
        sum(lengths) / n,
        sum(x <= 3 for x in lengths) / n,
        sum(x >= 12 for x in lengths) / n,
        float(np.log1p(n)),
        float(np.log1p(n / max(1, len(lines)))),
    ]


def trigrams(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of the shares of its byte trigrams by bucket."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        x = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(x) >= 3:
            h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
            out[k] = np.sqrt(np.bincount(h >> np.uint32(24), minlength=BUCKETS) / len(h))
    return out


def features(texts: list[str]) -> np.ndarray:
    """A row of features for each text: `COUNTS`, then `BUCKETS` of trigrams."""
    counts = np.array([counted(t) for t in texts], np.float32).reshape(-1, len(COUNTS))
    return np.hstack([counts, trigrams([t.encode() for t in texts])])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, label and features of rows (doc_id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = features(batch.column("text").to_pylist())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], names=["doc_id", "label", "features"])

    return docs.mapInArrow(run, "doc_id long, label int, features array<float>")


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) + self.shift, -35, 35)))


def conjugate(times, goal: np.ndarray, steps: int = 60) -> np.ndarray:
    """x with times(x) = goal, by conjugate gradients."""
    x, r = np.zeros_like(goal), goal.copy()
    d, size = r.copy(), r @ r
    end = 1e-12 * size
    for _ in range(steps):
        if size <= end:
            break
        t = times(d)
        a = size / (d @ t)
        x += a * d
        r -= a * t
        new = r @ r
        d, size = r + new / size * d, new
    return x


def fit_pairs(x: np.ndarray, label: np.ndarray, *, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE, seed: int = 5) -> Ranker:
    """A ranker of rows x from preference pairs of the labels 1 over 0."""
    k = x.shape[1] if x.ndim == 2 and len(x) else len(COUNTS) + BUCKETS
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    left, right = np.repeat(few, pairs_each), rng.choice(many, len(few) * pairs_each)
    win, lose = (right, left) if few is bad else (left, right)
    # Sums over pairs of a number times (z[win] - z[lose]), and its product with a vector, without a row for each pair.
    back = lambda v: (np.bincount(win, v, len(z)) - np.bincount(lose, v, len(z))) @ z / len(win)
    ahead = lambda v: (z @ v)[win] - (z @ v)[lose]
    w = np.zeros(k)
    for _ in range(20):
        p = 1 / (1 + np.exp(np.clip(ahead(w), -35, 35)))  # chance that the worse one wins
        step = conjugate(lambda v, q=p * (1 - p): ridge * v + back(q * ahead(v)), ridge * w - back(p))
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    raw = np.sort(z @ w)
    cut = min(max(len(bad), 1), len(raw) - 1)  # the quantile at the share of 0 labels, between its neighbours
    at = (raw[cut - 1] + raw[cut]) / 2
    return Ranker(mean, scale, w, float(np.log(THRESHOLD / (1 - THRESHOLD)) - at))


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> Ranker:
    """A ranker from docs (doc_id, text) and labels (doc_id, label)."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of two numbers
    got = featured(rows.select("doc_id", "label", "text")).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("features").alias("features"))  # no more than max_labelled rows
    got = got.toArrow().sort_by("doc_id")
    x = got.column("features").combine_chunks().values.to_numpy() if got.num_rows else np.empty(0, np.float32)
    return fit_pairs(x.reshape(got.num_rows, -1) if got.num_rows else x, got.column("label").to_numpy())


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            score = ranker.score(features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    ranker = fit(docs, labels.where(~held_out()))
    return scored(docs, ranker).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
