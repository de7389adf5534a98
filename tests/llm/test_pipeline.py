"""The pipeline's stages against a plain Python version of each, on the smallest documents."""

import collections
import hashlib
import math
import re

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from framelake.llm import mixing, quality_rules
from framelake.llm.common import documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xx(*values):
    """The engine's xxhash64 of values in turn: text, ('i', int) or ('l', long)."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[1].to_bytes(4 if v[0] == "i" else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def grams(t):
    w = WORD.findall(t)
    return [xx(x) % quality_rules.BUCKETS for x in w] + [xx(("l", xx(x)), ("l", xx(y))) % quality_rules.BUCKETS for x, y in zip(w, w[1:])]


def rules(docs, good):
    raw, ok = collections.Counter(), collections.Counter()
    for i, t, _ in docs:
        g = grams(t)
        raw.update(g)
        if i in good:
            ok.update(g)
    share, prior = sum(ok.values()) / sum(raw.values()), quality_rules.PRIOR
    weight = {b: round(math.log((ok[b] + prior * share) / ((n + prior) * share)) * quality_rules.SCALE) for b, n in raw.items()}
    out = []
    for i, t, s in docs:
        w = WORD.findall(t)
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(win)
        again = {k + j for k, x in enumerate(win) if n[x] > 1 for j in range(5)}
        g = grams(t)
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and sum(weight[b] for b in g) >= len(g) * round(quality_rules.MIN_RATIO * quality_rules.SCALE):
            out.append((i, t, s))
    return out


def exact(docs):
    seen = {}
    for i, t, s in sorted(docs):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t, s))
    return list(seen.values())


def near(docs, k=5):
    sets, parent = {}, {}
    for i, t, _ in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [d for d in docs if root(d[0]) == d[0]]


def permuted(x, n, *key):
    for r in range(mixing.ROUNDS):
        k = xx(("i", r), *key)
        y = (k % n - x) % n
        if xx(("l", k), ("l", max(x, y))) % 2 == 0:
            x = y
    return x


def mix(docs):
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    by = collections.defaultdict(list)
    chunks = max(1, -(-len(docs) // mixing.CHUNK_ROWS))
    for i, t, s in docs:
        by[s].append((xx(("l", i), ("l", xx(t)), ("i", mixing.SEED)) % chunks, i, t))
    order = sorted(by)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    words = {s: sum(size[i] for _, i, _ in by[s]) for s in order}
    total, capped = mixing.SHARE * sum(words.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(mixing.CAP * words[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if weight[s] * level > mixing.CAP * words[s]}
        if not new:
            break
        capped |= new
    out, size_b = [], mixing.BLOCK_WORDS
    for number, s in enumerate(order):
        stream = [(i, k) for _, i, _ in sorted(by[s]) for k in range(size[i])]
        text = {i: t for _, i, t in by[s]}
        want = mixing.CAP * words[s] if s in capped else int(weight[s] * level)
        full, passes = words[s] // size_b, -(-want // words[s])
        for p in range(passes):
            left, taken = min(want - p * words[s], words[s]), collections.defaultdict(list)
            for k in range(-(-left // size_b)):
                block = permuted(k, full, ("i", mixing.SEED), ("l", number), ("l", p)) if k < full else k
                for i, at in stream[block * size_b : block * size_b + min(size_b, left - k * size_b)]:
                    taken[i].append(at)
            for i, at in taken.items():
                w = WORD.findall(text[i])
                out.append((i, text[i] if len(at) == size[i] else " ".join(w[k] for k in sorted(at)), s))
    return out


def test_stages(spark, tmp_path):
    table = documents(spark, SF)
    docs = [(r.doc_id, r.text or "", r.source) for r in table.collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    have = table
    for k, ((name, stage), plain) in enumerate(zip(corpus_pipeline.STAGES, [lambda d: rules(d, good), exact, near, mix])):
        out = stage(spark, have, SF)
        assert out.columns == table.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        have = spark.read.parquet(str(tmp_path / str(k)))
        docs = plain(docs)
        assert sorted((r.doc_id, r.text, r.source) for r in have.collect()) == sorted(docs), name
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, have, SF).collect()
    assert sorted((r.doc_id, list(r.token_ids)) for r in last) == sorted((i, tok.encode(t, add_special_tokens=False).ids) for i, t, _ in docs)
    assert {r.decoded_sha256 for r in last} == {hashlib.sha256(t.encode()).hexdigest() for _, t, _ in docs}
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in again.collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_stages_take_empty_documents(spark):
    have = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        have = stage(spark, have, SF)
    assert have.count() == 0


@pytest.mark.parametrize("extra", [{"_row": "x"}, {"parts": "y", "whole": "z", "kept_text": "k"}])
def test_stages_keep_other_columns(spark, extra):
    from pyspark.sql import functions as F

    docs = documents(spark, SF).limit(60).withColumns({k: F.lit(v) for k, v in extra.items()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0


def test_stages_take_nulls_and_repeats(spark):
    t = "some words that go on and on for a while and are not repeated in here at all so that rules pass"
    rows = [(None, t, None, None, None), (None, None, None, None, None), (1, t, "en", "a", 5), (1, t, "en", "a", 5), (1, t + " more", "en", None, 5), (2, "", "en", "a", 0), (3, "x " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns and {r.doc_id for r in kept} <= {None, 1, 2, 3}, name
        else:
            assert len(kept) == len(rows)


def test_dedup_tells_rows_apart_by_id_and_text(spark):
    from framelake.llm import exact_dedup, near_dedup

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a, 0), (5, a, 1), (5, b, 2), (None, b, 3), (None, c, 4), (None, c, 4), (7, "d  e", 5), (7, "d  e", 5), (8, "d e", 6), (9, None, 7), (9, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    once = [(3, a, 0), (5, b, 2), (7, "d  e", 5), (9, None, 7), (None, c, 4)]
    sort = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert sort(exact_dedup.dedup(docs)) == sorted(once, key=str)
    near = [(a + " x", 4), (b + " x", None)]
    more = docs.unionByName(spark.createDataFrame([(i, t, 9) for t, i in near], docs.schema))
    assert sort(near_dedup.dedup(more)) == sorted([*(x for x in once if x[0] != 7), (7, "d  e", 5)], key=str)
    assert exact_dedup.dedup(docs.limit(0)).count() == near_dedup.dedup(docs.limit(0)).count() == 0
