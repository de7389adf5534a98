"""Registered queries against plain versions of their contracts, over tables with null and large ids."""

import collections
import random
import zlib

import pytest

from framelake.llm import bpe, near_dedup, ranking, suffix_dedup
from test_text_operators import WORD, brute_spans, got, rows, sha, shingles

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def texts():
    return {i: t for i, t, _ in rows()} | {BIG: "a text of its own with an id that no float holds", BIG + 2: "", None: "words without an id, a few"}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < 30)) for i in range(10, 51)] + [(None, 1), (BIG, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def test_op2(spark, folder, texts):
    found = got(ranking.op2(spark, folder))
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # Labels of held-out rows change nothing, and equal texts score alike.
    turned = [(i, 1 - int(i < 30) if found[i].held_out else int(i < 30)) for i in range(10, 51)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ranker = ranking.fit(docs, spark.createDataFrame(turned, "doc_id long, label int").where(~ranking.held_out()))
    again = got(ranking.scored(docs, ranker))
    assert all(abs(again[i].score - r.score) < 1e-9 for i, r in found.items()) and found[45].score == found[46].score


def test_op4(spark, folder, texts):
    found = got(near_dedup.op4(spark, folder))
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert found[None].component_id is None and found[BIG].component_id == BIG and found[BIG].kept and found[46].component_id == found[45].component_id
    assert all(r.kept == (i == r.component_id) for i, r in found.items() if i is not None)


def test_op9(spark, folder, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = got(bpe.op9(spark, folder))
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(tok.decode(ids, skip_special_tokens=False)))
        assert tuple(found[i])[1:] == want


def test_op10(spark, folder, texts):
    order = sorted(texts, key=lambda i: (i is not None, i or 0))
    data = [(texts[i] or "").encode() for i in order]
    found = got(suffix_dedup.op10(spark, folder))
    for i, b, (gone, spans, kept) in zip(order, data, brute_spans(data)):
        assert tuple(found[i])[1:] == (len(b), gone, spans, sha(kept)), i


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies_cost_pairs_by_their_number(spark, k):
    """2,000 texts that differ from one base in two words each: a few pairs a text, one component."""
    from framelake.llm.common import Scratch

    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(2_000):
        words = list(base)
        for at in rng.sample(range(120), 2):
            words[at] = f"x{i}at{at}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame([*texts, (5_000, " ".join(base))], "doc_id long, text string")
    known = near_dedup.sketches(docs, k).selectExpr("doc_id as id", "tie", "n_shingles as n", "bands")
    members = Scratch(spark, "t").save(near_dedup.members_of(known))
    assert near_dedup.stars(members).count() < 8 * 2_000
    found = got(near_dedup.near_groups(docs, shingle_words=k))
    assert {r.component_id for r in found.values()} == {0}


def test_vocabularies_that_are_not_implemented():
    import json

    spec = json.loads(bpe.vocabulary())
    bpe.Codec(json.dumps(spec))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}):
        with pytest.raises(ValueError, match="not implemented"):
            bpe.Codec(json.dumps(spec | change))


def test_a_word_of_two_million_characters():
    own = bpe.Codec(bpe.vocabulary())
    text = "é" + "ab" * 1_000_000 + " end"
    (ids,) = own.encode_batch([text])
    assert own.decode(ids) == text and max(map(len, own.kept)) < 10
    (short,) = own.encode_batch(["é" + "ab" * 500 + " end"])
    assert collections.Counter(memoryview(ids).cast("I").tolist()).most_common(1)[0][0] == collections.Counter(memoryview(short).cast("I").tolist()).most_common(1)[0][0]


def test_words_are_counted_alike(texts):
    from framelake.llm.shingles import word_hashes

    _, ends = word_hashes([None if t is None else t.encode() for t in texts.values()])
    assert [b - a for a, b in zip([0, *ends], ends)] == [len(WORD.findall(t or "")) for t in texts.values()]


def thue_morse(size, a, b):
    return [b if i.bit_count() % 2 else a for i in range(size)]


@pytest.mark.parametrize("size", [1_024, 4_096])
def test_words_and_lines_that_polynomials_take_for_equal(spark, tmp_path, size):
    """A Thue-Morse word and line, and their complements: different texts stay, in op1 as in its SQL, and in op4."""
    import duckdb

    from framelake.llm import line_dedup

    made = [("a", "b", ""), ("b", "a", ""), ("a", "b", " "), ("b", "a", " ")]
    texts = [(i, joint.join(thue_morse(size, a, b))) for i, (a, b, joint) in enumerate(made)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = got(line_dedup.op1(spark, str(tmp_path)))
    assert all(r.n_removed == r.n_repeats == 0 for r in lines.values())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(line_dedup.OP1_SQL)
    assert sorted(sql.fetchall()) == sorted(tuple(r[c] for c in sql.columns) for r in lines.values())
    near = got(near_dedup.op4(spark, str(tmp_path)))
    assert [near[i].component_id for i in range(2)] == [0, 1] and near[0].kept and near[1].kept


def test_repeats_of_any_length_are_reported(spark):
    from framelake.llm import line_dedup

    docs = spark.createDataFrame([(1, "yes\nall rights reserved.\nmore"), (2, "other\nAll  rights reserved.\nyes\nno"), (3, None)], "doc_id long, text string")
    found = got(line_dedup.repeats(docs))
    assert (found[1].n_repeats, found[2].n_repeats, found[3].n_repeats) == (0, 2, 0)
    assert found[2].n_removed == 0 and [tuple(r) for r in found[2].repeated] == [(6, 32)]
    assert [tuple(r) for r in got(line_dedup.repeats(docs, min_words=1))[2].removed] == [(6, 32)]


def der(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)) + content


def test_keys_of_any_size_and_in_the_url_safe_alphabet():
    import base64

    from framelake.llm import secret_scan

    rng = random.Random(4)
    for size in (40, 8_000):  # of a number; the whole key has 72,000 bytes
        key = der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" + rng.randbytes(size)) for _ in range(8)))
        plain, safe = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode()
        pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END RSA PRIVATE KEY-----"
        assert set("-_") & set(safe)
        for text in (plain, safe, safe.rstrip("="), key.hex(), key.hex().upper(), pem, base64.encodebytes(key).decode().rstrip("\n")):
            assert secret_scan.confirmed_spans(f"see {text} end") == [("der_key", 4, 4 + len(text))]
        assert secret_scan.confirmed_spans(f"see {safe[:-8]} end") == [] and secret_scan.confirmed_spans(f"x-{plain}\n") == [("der_key", 2, 2 + len(plain))]


def test_time_is_in_proportion_to_texts_that_look_like_keys():
    import time

    from framelake.llm import secret_scan

    def took(text):
        began = time.process_time()
        assert secret_scan.confirmed_spans(text) == []
        return time.process_time() - began

    for unit in ("MIIEvQIBADAN", "MIIEvQIBADAN" * 5 + "\n", "b3BlbnNzaC1rZXktdjEA", "MIIEvQIBADAN-_", "MIKEvQIBADCB"):
        small, large = (min(took(unit * (size // len(unit))) for _ in range(2)) for size in (100_000, 800_000))
        assert large < 16 * small + 0.1, unit


def test_op2_against_a_plain_fit(spark):
    """The ranker's weights are where plain gradient descent on the same preference pairs ends, and held-out labels are met."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts_of = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(list(labels))).collect()}
    ids = sorted(i for i in texts_of if zlib.crc32(str(i).encode()) % 5)
    x, y = ranking.features([texts_of[i] for i in ids]).astype(np.float64), np.array([labels[i] for i in ids])
    own = ranking.fit_pairs(x, y)

    z = np.clip((x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1), -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(5)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    left, right = np.repeat(few, ranking.PAIRS_EACH), rng.choice(many, len(few) * ranking.PAIRS_EACH)
    d = z[right] - z[left] if few is bad else z[left] - z[right]  # better minus worse, a row a pair
    w, rate = np.zeros(d.shape[1]), 1 / (ranking.RIDGE + 0.25 * np.linalg.norm(d, 2) ** 2 / len(d))
    momentum = w.copy()
    for k in range(5_000):
        slope = ranking.RIDGE * momentum - (d / (1 + np.exp(np.clip(d @ momentum, -35, 35)))[:, None]).mean(0)
        after = momentum - rate * slope
        momentum, w = after + k / (k + 3) * (after - w), after
    assert np.corrcoef(z @ own.weights, z @ w)[0, 1] > 0.999 and np.abs(own.weights - w).max() < 0.02 * np.abs(w).max()

    found = {r.doc_id: r.predicted for r in ranking.op2(spark, "/root/testdata/sf0.01").collect()}
    held = [i for i in texts_of if not zlib.crc32(str(i).encode()) % 5]
    assert len(held) > 50 and np.mean([found[i] == labels[i] for i in held]) >= 0.95


def test_op7_as_a_query(spark, tmp_path):
    rng = random.Random(8)
    rows_ = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 50, 400, 3_000]))), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(150)] + [(900, None, "z")]
    spark.createDataFrame(rows_, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    from framelake.llm import mixing

    found = got(mixing.op7(spark, str(tmp_path)))
    again = got(mixing.op7(spark, str(tmp_path)))
    assert found == again and found.keys() == {r[0] for r in rows_}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows_}
    by = collections.Counter()
    for i, _, s in rows_:
        by[s] += size[i]
    # Plain targets: shares by weight, and what is above a cap goes to the others until none is.
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, left, target = set(), 1.5 * sum(by.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = left - sum(2 * by[s] for s in capped)
        target = {s: 2.0 * by[s] for s in capped} | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * by[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for i, _, s in rows_:
        r = found[i]
        taken[s] += r.taken
        assert (r.size, r.source_size) == (size[i], by[s]) and 0 <= r.taken <= 2 * r.size and abs(r.target - target[s]) < 1e-6
    assert all(abs(taken[s] - target[s]) < 1 for s in order)


def test_columns_that_clash(spark, tmp_path):
    from framelake.llm import quality_rules, sharding

    docs = spark.createDataFrame([(i, f"some words of text number {i} that go on and on", "old", "x", "y", True) for i in range(20)], "doc_id long, text string, shard string, shard_ string, _verdict string, kept boolean")
    sharding.write(docs, str(tmp_path / "s"), limit=100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 20 and {r.shard__ for r in back.collect()} == {"old"} and {r.shard_ for r in back.collect()} == {"x"} and back.select("shard").distinct().count() > 1
    model = quality_rules.fit(docs, spark.createDataFrame([(1,)], "doc_id long"))
    judged = quality_rules.judged(docs, model)
    assert len(judged.columns) == len(set(judged.columns)) and {r._verdict for r in judged.collect()} == {"y"} and judged.where("n_words = 11").count() == 20
