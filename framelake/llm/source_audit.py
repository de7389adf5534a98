"""Source divergence audit: how far the term shares of each source are from those of others, and which terms stand out.

Terms are runs of ASCII letters (lowered) and of characters beyond ASCII. A language
keeps the terms that stand in `MIN_DOCS` of its documents or more. A group (language,
source) gives each kept term the smoothed share p = 1 + floor(`UNIT` * (count +
`PRIOR`) / (N + `PRIOR` * V)), an integer, so that all sums are exact.

Divergence of two groups is the sum of |p - q| over all kept terms. Most terms are
absent from most groups, where p is the group's floor p0. So the sum is V * |p0 - q0|
plus corrections by terms, which split by how many groups hold a term:

* Heavy terms (more than `LIGHT` groups, or a quarter of the language's) fill dense
  tiles of groups by terms, and |p - q| is taken for all pairs of a tile at once.
* Light terms give sparse corrections: |p - q0| - |p0 - q0| for a group that holds
  the term against every other (from sorted shares and their prefix sums), and for
  each pair of the term's posting list what both make different together.

Both partial sums are added. The work is dealt into cells (language, block of terms,
two blocks of groups): about `TERMS` terms and twice `GROUPS` groups, a matrix of
partial sums as the result, so no task holds a whole language. Counting is one pass
over the texts, whose rows are added up in each task before they are shuffled.

Defined results: a null text, lang or source is ''. Each row is a document of its
own, repeated ids or not (doc_id isn't read). Groups without kept terms count like
others. Without kept terms all divergences are 0. A language with one source has no
pairs. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, documents, sliced

MIN_DOCS = 30
PRIOR, UNIT = 5, 1_000_000_000
TOP = 50
#: Groups up to which a term's pairs are listed.
LIGHT = 64
#: Terms and groups of a block, about.
TERMS, GROUPS = 1024, 256
#: Counted terms that a task holds before it sends them on.
HELD = 300_000
#: Bytes of a text that are parted into terms together.
PIECE = 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")
_GROUP = ["lang", "source"]


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end between terms."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = cut.end() if cut else len(text)
        yield text[at:stop]
        at = stop


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by task; and a row with an empty term for each group."""

    def table(held: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, in_docs) in held.items():
            terms = [b"", *n]
            for column, values in zip(columns, ([lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(in_docs.__getitem__, n)])):
                column += values
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in sliced(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for piece in pieces(text.lower()):
                    terms = _TERM.findall(piece)
                    n.update(terms)
                    own.update(terms)
                in_docs.update(own)
                size += len(n)
            if size > HELD:
                yield table(held)
                held, size = {}, 0
        yield table(held)

    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in _GROUP], F.coalesce("text", empty).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, all_terms: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (all_terms + PRIOR * kept)), in decimals; 0 where nothing is kept."""
    top, below = F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"), (all_terms + PRIOR * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, below)).otherwise(0).cast("long")


def audit_tables(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(cells, groups), both written.

    cells: lang, source, term, p, q (the language's) and holders (groups with the
    term) for each kept term of a group; groups: lang, source, p0, kept (the
    language's number of kept terms) and others (its number of groups).
    """
    scratch = Scratch(docs.sparkSession, "audit")
    counts = scratch.save(counted(docs).groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("holders"))
    terms = scratch.save(terms.where(F.col("docs") >= min_docs).drop("docs"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_all"))
    names = counts.where("term = ''").select(*_GROUP)
    langs = names.groupBy("lang").agg(F.count(F.lit(1)).alias("others")).join(langs, "lang", "left").fillna(0, ["kept", "lang_all"])
    cells = scratch.save(counts.join(terms, ["lang", "term"]).drop("docs"))
    sizes = cells.groupBy(*_GROUP).agg(F.sum("n").alias("all"))
    groups = names.join(sizes, _GROUP, "left").fillna(0, ["all"]).join(langs, "lang")
    groups = scratch.save(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("all"), F.col("kept"))))
    found = cells.join(checked(groups, 128), _GROUP)
    p, q = share(F.col("n"), F.col("all"), F.col("kept")), share(F.col("lang_n"), F.col("lang_all"), F.col("kept"))
    cells_p = scratch.save(found.select(*_GROUP, "term", p.alias("p"), q.alias("q"), "holders"))
    scratch.drop(counts, terms, cells)
    return cells_p, groups.select(*_GROUP, "p0", "kept", "others")


def heavy_sums(a: np.ndarray, b: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """Sums over terms (columns) of |a - b| - |a0 - b0| for each row of a and row of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], 16):
        out += np.abs(a[:, None, at : at + 16] - b[None, :, at : at + 16]).sum(2)
    return out - a.shape[1] * np.abs(a0[:, None] - b0[None, :])


def single_sums(group: np.ndarray, p: np.ndarray, own0: np.ndarray, other0: np.ndarray) -> np.ndarray:
    """Sums over the postings (group, p) of each group of |p - other0| - |own0 - other0|, for each other group."""
    out = np.zeros((len(own0), len(other0)), np.int64)
    order = np.lexsort((p, group))
    group, p = group[order], p[order]
    ends = np.searchsorted(group, np.arange(len(own0) + 1))
    for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            upto = np.append(0, np.cumsum(p[a:b]))
            below = np.searchsorted(p[a:b], other0)
            out[g] = other0 * below - upto[below] + upto[-1] - upto[below] - other0 * (b - a - below) - (b - a) * np.abs(own0[g] - other0)
    return out


def pair_sums(left: tuple, right: tuple, a0: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """What terms that both groups hold add to their single sums; left and right: (term, group, p), sorted by term."""
    out = np.zeros(len(a0) * len(b0), np.int64)
    (lt, lg, lp), (rt, rg, rp) = left, right
    first, last = np.searchsorted(rt, lt), np.searchsorted(rt, lt, "right")
    ends = np.cumsum(last - first)
    at = 0
    while at < len(lt):  # pairs of about a million at a time; a posting list has at most LIGHT groups
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
        n = (last - first)[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)
        p, q, p0, q0 = lp[i], rp[j], a0[lg[i]], b0[rg[j]]
        np.add.at(out, lg[i] * len(b0) + rg[j], np.abs(p - q) - np.abs(p - q0) - np.abs(q - p0) + np.abs(p0 - q0))
        at = stop
    return out.reshape(len(a0), len(b0))


def divergences(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) for each ordered pair of groups of a language."""
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), n)).cast("int")
    placed = groups.select(*_GROUP, "p0", "kept", "others", blocks("others", GROUPS).alias("gb"), F.greatest(F.lit(1), blocks("kept", TERMS)).alias("tb"))
    placed = placed.withColumn("g", pick("source", F.col("gb")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    met = F.explode(F.transform(upto(F.col("gb")), lambda x: F.struct(F.least(x, F.col("g")).alias("a"), F.greatest(x, F.col("g")).alias("b"))))
    sides = placed.select(*_GROUP, "p0", "kept", "g", "tb", met.alias("at")).select(*_GROUP, "p0", "kept", "g", "at.*", F.explode(upto(F.col("tb"))).alias("k"))
    known = placed.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "g", "gb", "tb", "others")
    rows = cells.join(checked(known, 96), (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
    is_heavy = (F.col("holders") > LIGHT) | (4 * F.col("holders") >= F.col("others"))
    rows = rows.select("lang", "source", "term", "p", is_heavy.alias("heavy"), pick("term", F.col("tb")).alias("k"), met.alias("at")).select("lang", "k", "at.*", "source", "term", "p", "heavy")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, k, a, b = (right.column(c)[0].as_py() for c in ("lang", "k", "a", "b"))
        names, g, p0 = (np.array(right.column(c).to_pylist(), t) for c, t in (("source", object), ("g", np.int64), ("p0", np.int64)))
        kept = right.column("kept")[0].as_py()
        of = {}
        places = []
        for block in (a, b):
            at = np.flatnonzero(g == block)
            of[block] = {s: i for i, s in enumerate(names[at])}
            places.append(at)
        (ia, ib), (a0, b0) = places, (p0[places[0]], p0[places[1]])
        source, p, heavy = left.column("source").to_pylist(), left.column("p").to_numpy(), left.column("heavy").to_numpy(zero_copy_only=False)
        term = np.unique(np.array(left.column("term").to_pylist(), object), return_inverse=True)[1] if left.num_rows else np.empty(0, np.int64)

        def side(block: int, zero: np.ndarray) -> tuple[np.ndarray, tuple]:
            """(dense tile of heavy terms, postings of light ones) of one block of groups."""
            mine = np.fromiter((of[block].get(s, -1) for s in source), np.int64, len(source))
            tall = np.unique(term[heavy], return_inverse=True)
            tile = np.repeat(zero[:, None], len(tall[0]), 1)
            own = mine[heavy]
            tile[own[own >= 0], tall[1][own >= 0]] = p[heavy][own >= 0]
            light = np.flatnonzero(~heavy & (mine >= 0))
            light = light[np.argsort(term[light], kind="stable")]
            return tile, (term[light], mine[light], p[light])

        tile_a, light_a = side(a, a0)
        tile_b, light_b = side(b, b0) if b != a else (tile_a, light_a)
        total = heavy_sums(tile_a, tile_b, a0, b0) + single_sums(light_a[1], light_a[2], a0, b0) + single_sums(light_b[1], light_b[2], b0, a0).T
        total += pair_sums(light_a, light_b, a0, b0)
        if k == 0:
            total += kept * np.abs(a0[:, None] - b0[None, :])
        i, j = np.nonzero(np.ones(total.shape, bool) if a != b else ~np.eye(len(a0), dtype=bool))
        s, o, v = names[ia[i]], names[ib[j]], total[i, j]
        if a != b:
            s, o, v = np.append(s, o), np.append(o, s), np.append(v, v)
        return pa.table({"lang": pa.array([lang] * len(v), pa.string()), "source": pa.array(s, pa.string()), "other": pa.array(o, pa.string()), "value": pa.array(v, pa.int64())})

    key = ["lang", "k", "a", "b"]
    parts = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(work, "lang string, source string, other string, value long")
    return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' rows for all other sources of the language, 'term' rows for the `top` terms."""
    cells, groups = audit_tables(docs, min_docs=min_docs)
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    pairs = divergences(cells, groups).select(*_GROUP, F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = cells.where("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS n
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.n + {PRIOR} * g.v) AS p,
             1 + ({UNIT}::HUGEINT * (k.n + {PRIOR})) // (g.lang_n + {PRIOR} * g.v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM a
QUALIFY part = 'pair' OR rank <= {TOP}
"""
