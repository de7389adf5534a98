"""SimHash, vector codes and the source audit against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from framelake.llm import simhash, source_audit, vector_codes
from test_text_operators import WORD, docs, empty, got, odd, rows  # noqa: F401


def plain_fingerprint(text, k=4):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, distance=4):
    """Smallest id reachable of points (id, fingerprint)."""
    root = {i: i for i, _ in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(points):
        for j, b in points[:n]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in points}


def test_fingerprints_and_components(docs):  # noqa: F811
    texts = {i: t for i, t, _ in rows()}
    found = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fp % 2**64 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == plain_components(sorted(prints.items()))
    assert found[1].component_id == found[3].component_id == 1


def test_odd_rows_of_simhash(odd, empty):  # noqa: F811
    assert simhash.simhash_groups(empty).collect() == []
    found = simhash.simhash_groups(odd).collect()
    assert len(found) == 6
    assert all((r.doc_id is None) == (r.component_id is None) for r in found)
    assert {r.component_id for r in found if r.doc_id == 1} == {1} and [r.component_id for r in found if r.doc_id == 2] == [2]
    with pytest.raises(ValueError):
        simhash.simhash_groups(odd, distance=5)


def test_anchors_cover_all_links():
    rng = np.random.default_rng(3)
    for low, bits in simhash.FIELDS:
        x = rng.integers(0, 1 << bits, 300, np.uint64)
        at, anchor, home = simhash.anchors(x, bits)
        assert np.bincount(at, home, 300).tolist() == [1.0] * 300
        assert (np.bitwise_count(x[at] ^ anchor) <= 2).all() and (np.bitwise_count(x[at] ^ anchor)[home] <= 1).all()
        own = collections.defaultdict(set)
        for i, a in zip(at.tolist(), anchor.tolist()):
            own[i].add(a)
        for b in [None, *range(bits)]:  # a value that differs in at most one bit visits the home
            y = x if b is None else x ^ np.uint64(1 << b)
            at_y, anchor_y, _ = simhash.anchors(y, bits)
            visits = set(zip(at_y.tolist(), anchor_y.tolist()))
            assert all((i, a) in visits for i, a in zip(at[home].tolist(), anchor[home].tolist()))


def test_links_of_a_hot_ball_and_of_chains(spark, monkeypatch):
    """Thousands of fingerprints near one, dealt into many cells, and others at exact distances."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(1_500)}
    far = [rng.getrandbits(64) for _ in range(300)]
    edge = [far[0] ^ 0b1111, far[0] ^ 0b11111, far[1] ^ (0b11111 << 40), far[2] ^ 1 << 63]
    points = [(i, x) for i, x in enumerate([*sorted(near), *far, *edge])]
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in points], "fp long, id long").cache()
    monkeypatch.setattr(simhash, "SIDE", 100)
    pairs = simhash.links(simhash.hosted(nodes), 4).collect()
    sides = {x - 2**64 if x >= 2**63 else x: i for i, x in points}
    root = {i: i for i, _ in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in pairs:
        x, y = sorted((find(sides[r.u]), find(sides[r.v])))
        root[y] = x
    assert {i: find(i) for i in root} == plain_components(points)


def test_a_long_text_has_its_fingerprint_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "WORDS", 7)
    text = " ".join(f"w{i % 37} X{i}" for i in range(200))
    for t in (text, "one two three four five six seven", "eins zwei", "x"):
        assert simhash.fingerprint(t.encode(), 4) % 2**64 == plain_fingerprint(t)


# --- vector codes


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """{row: (code, error)} and the codebooks of rows (id, list) in order."""
    whole = [[max(-(1 << 26), min(1 << 26, math.floor(4096 * x))) for x in v] for _, v in vectors]
    d = -(-max(map(len, whole), default=0) // parts)
    whole = [v + [0] * (parts * d - len(v)) for v in whole]
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted(range(len(whole)), key=lambda r: (vectors[r][0] is None, vectors[r][0] or 0))[:entries]
    books = [[cut(whole[r], p) for r in first] for p in range(parts)]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((off(v, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(cut(v, p), p)[1] for p in range(parts)] for v in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, c in zip(whole, codes) if c[p] == e]
                if mine and e in {c[p] for c in codes}:
                    books[p] = [*books[p][:e], [sum(x) // len(mine) for x in zip(*mine)], *books[p][e + 1 :]]
    last = [[near(cut(v, p), p) for p in range(parts)] for v in whole]
    return [("".join(f"{e:02x}" for _, e in r), sum(o for o, _ in r)) for r in last], books


def plain_digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compared(spark, vectors):
    made = spark.createDataFrame([(i, v, None) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    found, books = vector_codes.compress(made)
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    codes, plain = plain_codes(kept)
    assert sorted((r.vec_id, r.code.hex(), r.error) for r in found.collect()) == sorted((i, *c) for (i, _), c in zip(kept, codes))
    assert vector_codes.digest(books) == plain_digest(plain)


def test_codes_of_vectors(spark):
    rng = random.Random(11)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(80)]
    vectors += [(200 + i, vectors[i][1]) for i in range(5)]  # repeats, and ties between equal entries
    compared(spark, [*vectors, (300, None), (301, [float("nan")] * 16), (302, [float("inf")] * 16), (303, [None] * 16), (304, [3e38] * 16)])


def test_codes_of_few_equal_short_and_no_vectors(spark):
    compared(spark, [(i, [1.0, -1.0, 0.5, 0.25, -0.0001, 7.0, 8.0, 9.0]) for i in range(30)])
    compared(spark, [(3, [0.5] * 8), (1, [0.25] * 8)])
    compared(spark, [(i, [float(i)] * (3 + i % 9)) for i in range(40)])
    compared(spark, [(1, []), (2, [])])
    found, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert found.collect() == [] and books.size == 0


def test_nearest_is_exact_where_float32_is_not():
    """Entries whose distances differ in the last units, far beyond 24 bits, and exact ties."""
    rng = np.random.default_rng(8)
    book = np.repeat(rng.integers(-(1 << 26), 1 << 26, (1, 8)), 16, 0).astype(np.int64)
    book += rng.integers(-2, 3, book.shape)
    book[7] = book[2]
    x = (book[rng.integers(0, 16, 500)] + rng.integers(-2, 3, (500, 8))).astype(np.int32)
    exact = ((x[:, None, :].astype(np.int64) - book[None]) ** 2).sum(2)
    code, error = vector_codes.nearest(x, book)
    assert (code == exact.argmin(1)).all() and (error == exact.min(1)).all() and 7 not in code


def test_op12_has_labels_together(spark, tmp_path):
    rows_ = [(i, [float(i % 7)] * 8, None if i % 3 else i % 2) for i in range(40)]
    spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: r for r in vector_codes.op12(spark, str(tmp_path)).collect()}
    by = collections.Counter()
    for i, _, label in rows_:
        by[label] += found[i].error
    assert all(found[i].label_error == by[label] for i, _, label in rows_)


# --- source audit


def plain_audit(texts, min_docs, top=50):
    """Rows of texts (lang, source, text)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, in_docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in texts:
        found = term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = set()
    for lang in {x for x, _ in n}:
        kept = sorted(t for t, k in in_docs[lang].items() if k >= min_docs)
        groups = [s for x, s in n if x == lang]
        total = sum((n[lang, s] for s in groups), collections.Counter())
        share = lambda c: [1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept]
        shares, q = {s: share(n[lang, s]) for s in groups}, share(total)
        for s in groups:
            pairs = [(o, sum(abs(a - b) for a, b in zip(shares[s], shares[o]))) for o in groups if o != s]
            terms = [(t, a - b) for t, a, b in zip(kept, shares[s], q) if n[lang, s][t] and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("light, terms, groups", [(64, 1024, 256), (3, 7, 5)])
def test_audit(spark, monkeypatch, light, terms, groups):
    """Also with blocks so small that terms and groups are dealt over many cells."""
    for name, value in (("LIGHT", light), ("TERMS", terms), ("GROUPS", groups)):
        monkeypatch.setattr(source_audit, name, value)
    rng = random.Random(2)
    words = [f"{a}{b}é" if a == "q" else a + b for a in "abcdq" for b in "xyzuvw"]
    texts = []
    for i in range(400):
        source = rng.choice(["s1", "s1", "s1", *(f"s{k}" for k in range(14))])
        own = [w for w in words if rng.random() < 0.3 and (hash_of(w) % 3 or hash_of(w + source) % 4 == 0)]
        texts.append((rng.choice(["en", "de"]), source, " ".join(rng.choice([w, w.upper()]) + rng.choice(["", "1", "_"]) for w in own * rng.randint(1, 3))))
    texts += [(None, None, None), (None, "s1", "bx, cx"), ("fr", "s2", ""), ("en", "only", None), ("en", "zz", "中文 ÀB")]
    made = spark.createDataFrame([(i, *t, 3, 4) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string, n long, p long")
    found = source_audit.audit(made, min_docs=20)
    assert {tuple(r) for r in found.collect()} == plain_audit(texts, 20)
    assert source_audit.audit(made.where("doc_id < 0")).collect() == []


def hash_of(text):
    return xxhash.xxh64_intdigest(text.encode())


def test_terms_of_a_text_in_pieces(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 5)
    text = "alpha beta--gamma élan 12 x".encode()
    assert [t for p in source_audit.pieces(text) for t in source_audit._TERM.findall(p)] == source_audit._TERM.findall(text)
