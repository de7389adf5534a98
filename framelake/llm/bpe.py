"""Byte-level BPE encoding and decoding by a trie of words.

In byte-pair encoding the tokens of a prefix are fixed by its last token alone:
the encoding of w[:i] is that of w[:i-k] and one token of k bytes, and among the
tokens that end the prefix exactly one keeps a border with its predecessor that
no merge would cross. So each trie node needs one number, its last token. The
distinct words of a batch of texts that a task hasn't met are sorted, which is
the depth-first order of their trie, and the trie is walked along them: only the
path to the word at hand is held, and a shared prefix is encoded once. A word's
tokens are read back along the last tokens.

Words that a task has met keep their ids, in two generations of `MAX_WORDS`: when
the younger is full it becomes the older, whose words are dropped unless they
were met again. Words over `LONG_WORD` bytes aren't kept. A batch ends at
`BATCH_CHARS` characters, inside a long text too, so memory is bounded by that,
by the longest word and by a text's ids.

Defined results: a null text is an empty text with no tokens. The strings of
special tokens in a text become their ids, as the tokenizers library does. Texts
of any length are encoded whole. Null ids and repeated rows are answered as they
come; an empty table gives an empty result; other columns are left alone. A
tokenizers file with settings that are not implemented here is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from framelake.llm.common import documents, sliced, text_or_empty

MAX_WORDS = 150_000
LONG_WORD = 256
BATCH_CHARS = 4 << 20
#: Rows that a worker gives back at a time.
ROWS_BACK = 500
#: Fixed value: how byte-level BPE splits text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, by rule: printable bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTrie:
    """Encodes words (bytes) with a vocabulary and its merges."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.halves = {made: (a, b) for a, b, made in merges}
        self.rank = {made: r for r, (_, _, made) in enumerate(merges)}
        self.pair = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.length = {t: len(b) for b, t in tokens.items()}
        #: Each end of a token, and the token that it is, if any.
        self.ends: dict[bytes, int | None] = {t[k:]: None for t in tokens for k in range(1, len(t))} | tokens
        #: The token that is token a and one byte more, by a << 8 | byte.
        self.grown = {tokens[t[:-1]] << 8 | t[-1]: i for t, i in tokens.items() if t[:-1] in tokens}
        self.whole: dict[int, bool] = {}
        self.borders: dict[int, bool] = {}

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self.whole:
            halves = self.halves.get(token)
            self.whole[token] = halves is None or self.reachable(halves[0]) and self.reachable(halves[1]) and self.border_until(*halves, self.rank[token])
        return self.whole[token]

    def border(self, a: int, b: int) -> bool:
        """Whether a border between tokens a and b lasts."""
        known = self.borders.get(a << 32 | b)
        if known is None:
            if len(self.borders) > MAX_WORDS:
                self.borders.clear()
            known = self.borders[a << 32 | b] = self.border_until(a, b, len(self.pair) + 1)
        return known

    def border_until(self, a: int, b: int, end: int) -> bool:
        """Whether no merge of a rank under `end` crosses the border.

        Goes back in time: the later of the two merges that made the tokens at
        the border is undone; a pair that stood there merged if its rank came
        before either of its parts was merged away (of equal merges, the left first).
        """
        left_gone = right_gone = end
        rank, pair, halves = self.rank, self.pair, self.halves
        while True:
            r = pair.get((a, b))
            if r is not None and r < left_gone and (r <= right_gone if right_gone < end else r < end):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                left_gone, a = ra, halves[a][1]
            elif rb >= 0:
                right_gone, b = rb, halves[b][0]
            else:
                return True

    def encode(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """The token ids of each word; sorted words share the work on their prefixes."""
        length, grown, ends, border, reachable = self.length, self.grown, self.ends, self.border, self.reachable
        before, last = b"", [-1]  # last[i]: the last token of the word's first i bytes
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                # Only one token fits, so the likeliest is tried first: the one before and this byte.
                token = grown.get(last[-1] << 8 | word[i - 1]) if i > 1 else None
                if token is not None:
                    k = length[token]
                    if not (reachable(token) if k == i else border(last[i - k], token)):
                        token = None
                k = 0
                while token is None:
                    k += 1
                    end = word[i - k : i]
                    if k > i or end not in ends:
                        raise ValueError(f"no token ends {word[max(0, i - 50) : i]!r}")
                    token = ends[end]
                    if token is not None and not (reachable(token) if k == i else border(last[i - k], token)):
                        token = None
                last.append(token)
            before = word
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i -= length[ids[-1]]
            yield ids[::-1]


def latin_split() -> re.Pattern:
    """`SPLIT` for texts of the first 256 characters, whose classes are written out."""
    chars = [chr(c) for c in range(256)]
    letters, numbers = ("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")
    spaces = "".join(re.escape(c) for c in chars if regex.match(r"\p{White_Space}", c))
    pattern = SPLIT.replace(r"\P{White_Space}", f"[^{spaces}]").replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    return re.compile(pattern.replace(r"\p{White_Space}", f"[{spaces}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


def young_letters() -> str:
    """Pattern of the characters that the regex library takes for letters or numbers and older Unicode tables don't know."""
    letter = regex.compile(r"[\p{L}\p{N}]").match
    young = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and letter(chr(c))]
    starts = [c for k, c in enumerate(young) if not k or young[k - 1] != c - 1]
    ends = [c for k, c in enumerate(young) if k + 1 == len(young) or young[k + 1] != c + 1]
    return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends)) + "]"


def checked_settings(spec: dict) -> None:
    """Raise on a tokenizers file that would encode or decode otherwise than `Codec`."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = [k for k in ("normalizer",) if spec.get(k) is not None]
    odd += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or after.get("type", "ByteLevel") != "ByteLevel":
        odd.append("model, pre_tokenizer or decoder")
    odd += [t["content"] for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if odd:
        raise ValueError(f"not implemented in a tokenizers file: {', '.join(odd)}")


class Codec:
    """Encodes and decodes texts with a tokenizers file of a byte-level BPE vocabulary."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        checked_settings(model)
        letters = byte_letters()
        raw = lambda t: bytes(map(letters.__getitem__, t))
        vocab = model["model"]["vocab"]
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        tokens = {raw(t): i for t, i in vocab.items() if t not in added}
        split = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.trie = WordTrie(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in split])
        self.added = {t: struct.pack("<I", i) for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(SPLIT).findall
        self.latin = latin_split().findall
        self.young = re.compile(young_letters()).search
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The bytes of all tokens, one after another.
        bytes_of = {i: b for b, i in tokens.items()} | {i: t.encode() for t, i in added.items()}
        sizes = np.zeros(max(bytes_of) + 1, np.int64)
        sizes[list(bytes_of)] = [len(b) for b in bytes_of.values()]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(bytes_of[i] for i in sorted(bytes_of)), np.uint8)

    def find(self, text: str) -> list[str]:
        """The words of a text; where Unicode versions could differ, as the tokenizers library splits."""
        try:
            text.encode("latin-1")
            return self.latin(text)
        except UnicodeEncodeError:
            pass
        if not self.young(text):
            return self.split(text)
        return [text[i:j] for _, (i, j) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The words and special tokens of a text, in lists for about BATCH_CHARS of it."""
        parts = [text] if self.special is None or not self.special.search(text) else self.special.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                yield [part]
            else:
                for a, b in cuts(part):
                    yield self.find(part[a:b] if b - a < len(part) else part)

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        held: list[tuple[list[str], bool]] = []  # words, and whether they end their text
        size, parts = 0, []
        for text in texts:
            for words in self.pieces(text):
                held.append((words, False))
                size += sum(map(len, words)) if len(text) > BATCH_CHARS else 0
                if size > BATCH_CHARS:
                    yield from self._encoded(held, parts)
                    held, size = [], 0
            held.append(([], True))
            size += len(text) if len(text) <= BATCH_CHARS else 0
            if size > BATCH_CHARS:
                yield from self._encoded(held, parts)
                held, size = [], 0
        yield from self._encoded(held, parts)

    def _encoded(self, held: list[tuple[list[str], bool]], parts: list[bytes]) -> Iterator[bytes]:
        """The ids of the texts that end in held; parts: ids of the text that has begun."""
        met = set().union(*(words for words, _ in held))
        if len(self.kept) > MAX_WORDS:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        ids_of = dict(self.added)
        new = []
        for w in met:
            known = kept.get(w)
            if known is None:
                known = older.get(w)
                if known is None:
                    if w not in ids_of:
                        new.append((w.encode(), w))
                    continue
                kept[w] = known
            ids_of[w] = known
        new.sort()
        for (raw, w), ids in zip(new, self.trie.encode(b for b, _ in new)):
            ids_of[w] = packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) <= LONG_WORD:
                kept[w] = packed
        for words, ends in held:
            parts.append(b"".join([ids_of[w] for w in words]))
            if ends:
                yield b"".join(parts)
                parts.clear()

    def decode(self, ids: bytes) -> str:
        at = np.frombuffer(ids, "<u4")
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[at] - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.bytes[places].tobytes().decode("utf-8", "replace")


_SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")


def cuts(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text of about BATCH_CHARS: cut between a letter and a space with a letter behind it, which words never cross."""
    at = 0
    while len(text) - at > BATCH_CHARS:
        found = _SAFE.search(text, at + BATCH_CHARS)
        if not found:
            break
        yield at, found.end()
        at = found.end()
    yield at, len(text)


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The worker's codec of a vocabulary; kept while the worker lives."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def vocabulary(path: str | None = None) -> str:
    """The text of a tokenizers file, read on the driver; by default the public 50k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text, for each row."""
    return _coded(docs, spec, False)


def encoded(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, token_ids (array of ints), n_tokens and the digests of ids and decoded text, for each row."""
    return _coded(docs, spec, True)


def _coded(docs: DataFrame, spec: str, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file: a few MB
    fields = {"doc_id": "long"} | ({"token_ids": "array<int>"} if with_ids else {}) | {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for part in sliced(batches, ROWS_BACK):
            ids = list(own.encode_batch(part.column("text").to_pylist()))
            columns = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            }
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                columns["token_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([columns[c] for c in fields], names=list(fields))

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields.items()))


def decoded(encoded_docs: DataFrame, spec: str) -> DataFrame:
    """doc_id and text of rows (doc_id, token_ids); null ids are no ids."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for part in sliced(batches, ROWS_BACK):
            texts = [own.decode(np.array(ids, "<i4").tobytes()) for ids in part.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ids = F.coalesce("token_ids", F.array().cast("array<int>")).alias("token_ids")
    return encoded_docs.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary())
