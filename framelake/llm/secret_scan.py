"""Secrets in texts: three base patterns, and candidates confirmed by structure.

Base kinds are plain patterns. The other kinds report base64 or hex only after it
has been decoded and its structure parsed to the last byte: a private key in DER
(nested lengths that add up, with the version number and parts of such a key), a
private key of OpenSSH (fields with their lengths, public and private parts that
fill the blob), or a signed token (a JSON header that names its algorithm, a JSON
payload and a signature). Public keys are no secrets and are not reported. A key
of any size is found where its first bytes stand, behind other characters of the
same run too; it may be in the URL-safe alphabet, or wrapped over lines, with a PEM
header or without, and the line ends may be written as \\n. What looks random but
parses as nothing is not reported, nor a key that is encoded twice.

A run is decoded once for each place of a first character in a group, and what
begins like a key is parsed there by its lengths alone, at most ten elements of it
(of OpenSSH, as many as it has keys); nothing is decoded or copied for each
candidate, so time is in proportion to a text, whatever it holds.

Defined results: a null text is empty and has no spans. Null ids and repeated
rows are answered as they come; an empty table gives an empty result; other
columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import documents, sliced, text_or_empty

#: Fixed by the contract: kinds in order, their patterns, the group that counts and its least length.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")
#: Fixed value: what the blob of an OpenSSH private key begins with.
SSH_MAGIC = b"openssh-key-v1\x00"
#: Elements of a key, more than any layout has; characters of a name in an OpenSSH key.
MOST_ITEMS, MOST_NAME = 10, 64

_ASSIGN_HINT = re.compile(r"(?ai)passw|secret|token|api_?key")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_PEM_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]{1,64}-----")
_PEM_TAIL = re.compile(r"-----END [A-Z0-9 ]{1,64}-----")
#: Line breaks in JSON or .env text are the two characters \n.
_ESCAPED = re.compile(r"\\+[nr]")
#: Base64 that is wrapped over lines without a header.
_LINES64 = re.compile(r"(?:(?<![A-Za-z0-9+/\\])|(?<=\\n))[A-Za-z0-9+/]{40,}(?:(?:[ \t]*\r?\n[ \t]*|(?:\\+r)?\\+n)[A-Za-z0-9+/]+={0,2})+")
_LINE64 = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/\\]))[A-Za-z0-9+/]+={0,2}")
_RUN64 = re.compile(r"[A-Za-z0-9+/]{40,}")
#: The URL-safe alphabet; a run counts if it has one of its own characters.
_RUN_URL = re.compile(r"[A-Za-z0-9_-]{40,}")
_RUN16 = re.compile(r"[0-9a-fA-F]{64,}")
#: Where a key's first bytes can stand: a SEQUENCE, or the magic of OpenSSH.
_HEAD64 = re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXkt")
_HEAD16 = re.compile(r"30(?=[0-8])|6f70656e7373682d6b65792d")
_PART = re.compile(r"[A-Za-z0-9_-]{8,}")


def der_items(data: memoryview) -> list[tuple[int, memoryview]] | None:
    """(tag, content) of DER elements that fill data; None if lengths don't add up, or there are more than MOST_ITEMS."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or len(items) == MOST_ITEMS:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k]), at + k
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def is_der_key(data: memoryview) -> bool:
    """One SEQUENCE that is laid out as a private key: PKCS#1, PKCS#8 (also encrypted), DSA or SEC1."""
    outer = der_items(data)
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags == [0x02] * 9 and parts[0][1] == b"\0":  # version and eight numbers of an RSA key
        return len(parts[1][1]) >= 32
    if tags == [0x02] * 6 and parts[0][1] == b"\0":  # version, three parameters and two numbers of a DSA key
        return len(parts[1][1]) >= 64
    if tags == [0x30, 0x04]:  # algorithm and encrypted key
        inner = der_items(parts[0][1])
        return bool(inner) and inner[0][0] == 0x06 and len(parts[1][1]) >= 16
    if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81} and parts[0][1] in (b"\0", b"\1"):  # version, algorithm, key
        inner = der_items(parts[1][1])
        return bool(inner) and inner[0][0] == 0x06 and len(parts[2][1]) >= 16
    if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1} and parts[0][1] == b"\1":  # an elliptic curve's number
        return len(parts[1][1]) in (20, 24, 28, 32, 48, 66)
    return False


def ssh_size(data: memoryview) -> int:
    """Bytes of the OpenSSH private key that data begins with, by its lengths; 0 if they don't fit in data or in its layout."""
    at = len(SSH_MAGIC)
    if data[:at] != SSH_MAGIC:
        return 0

    def field() -> memoryview | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    def is_name(x: memoryview) -> bool:
        return len(x) <= MOST_NAME and x.tobytes().isascii()

    cipher, derivation, options = field(), field(), field()
    if not cipher or not derivation or options is None or not is_name(cipher) or not is_name(derivation):
        return 0
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    if keys < 1:
        return 0
    for _ in range(keys):
        public = field()
        if public is None or len(public) < 8 or not is_name(public[4 : 4 + int.from_bytes(public[:4])]):
            return 0
    private = field()
    if private is None or len(private) < 16 or len(private) % 8:
        return 0
    return 0 if cipher == b"none" and private[:4] != private[4:8] else at  # its check numbers agree


def der_size(data: memoryview) -> int:
    """Bytes of the element that data begins with, by its header; 0 if it has none."""
    if len(data) < 2 or data[1] & 0x80 and not 1 <= data[1] & 0x7F <= 4:
        return 0
    k = data[1] & 0x7F if data[1] & 0x80 else 0
    return 2 + k + (int.from_bytes(data[2 : 2 + k]) if k else data[1])


def key_at(data: memoryview) -> tuple[str, int] | None:
    """(kind, bytes) of the private key that data begins with."""
    if data[:1] != b"\x30":
        size = ssh_size(data)
        return ("ssh_key", size) if size else None
    size = der_size(data)
    at = 2 + (data[1] & 0x7F if data[1:2] and data[1] & 0x80 else 0)
    plausible = 16 <= size <= len(data) and (data[at : at + 2] == b"\x02\x01" or data[at : at + 1] == b"\x30")
    return ("der_key", size) if plausible and is_der_key(data[:size]) else None


class Decoded:
    """A run of base64 or hexadecimal digits, decoded from any of its characters on; once for each place of a group."""

    def __init__(self, run: str, digits: int, size: int):
        self.run, self.digits, self.size, self.whole = run, digits, size, {}

    def since(self, k: int) -> memoryview:
        first = k % self.digits
        if first not in self.whole:
            run = self.run[first:]
            self.whole[first] = memoryview(leading64(run) if self.digits == 4 else leading16(run))
        return self.whole[first][(k - first) // self.digits * self.size :]


def decoded64(run: str) -> bytes | None:
    run = "".join(run.split()).rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), altchars=b"-_" if "-" in run or "_" in run else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(run: str) -> bool:
    """Header and payload are JSON objects, and the header names its algorithm."""
    head, body, signature = run.split(".")
    try:
        first, second = (json.loads(decoded64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict) and decoded64(signature) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not _ASSIGN_HINT.search(text) or kind == "access" and "AKIA" not in text or kind == "hex" and not _HEX_RUN.search(text):
            continue  # cheaper tests that hold for every text with such a match
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return out


def base64_size(size: int) -> int:
    """Characters that so many bytes take in base64, without padding."""
    return -(-size * 4 // 3)


def pem_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of the PEM blocks of a text."""
    tail, at = None, 0
    while head := _PEM_HEAD.search(text, at):
        at = head.end()
        if tail is None or tail.start() < at:
            tail = _PEM_TAIL.search(text, at)
            if not tail:
                return
        after = _PEM_HEAD.search(text, at, tail.start())
        if not after:
            yield head.start(), tail.end(), text[at : tail.start()]
            at = tail.end()


def wrapped_spans(text: str, at: int, stop: int) -> list[tuple[str, int, int]]:
    """Keys over two lines or more of a block: lines of one width, the last of them shorter or not."""
    lines, out, i = [m.span() for m in _LINE64.finditer(text, at, stop)], [], 0
    width = [b - a for a, b in lines]
    first = 0
    while first < len(lines) - 1:
        after = first + 1
        while after < len(lines) and width[after] == width[first]:
            after += 1
        end = after + (after < len(lines) and width[after] < width[first])
        block, wide = Decoded("".join(text[x:y] for x, y in lines[first:end]), 4, 3), width[first]
        i = max(i, first)
        while i < after and i < end - 1:
            if key := key_at(block.since((i - first) * wide)):
                last = i + -(-base64_size(key[1]) // wide) - 1  # lines but the last are full
                x, y = lines[last]
                used = base64_size(key[1]) - (last - i) * wide
                # It ends with its line, but for padding.
                if last > i and text[x + used : y].strip("=") == "":
                    out.append((key[0], lines[i][0], y))
                    i = last
            i += 1
        first = after
    return out


def leading64(run: str) -> bytes:
    """What the whole groups of a run in base64 decode to."""
    run = run.split("=", 1)[0]
    return decoded64(run if len(run) % 4 != 1 else run[:-1]) or b""


def run_spans(text: str, pattern: re.Pattern, heads: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Keys in runs of one line, at any place of a run."""
    is_hex = heads is _HEAD16
    for run in pattern.finditer(text):
        if pattern is _RUN_URL and "-" not in run[0] and "_" not in run[0]:
            continue
        at, stop = run.span()
        data = Decoded(run[0], 2, 1) if is_hex else Decoded(run[0], 4, 3)
        while head := heads.search(text, at, stop):
            at = head.start()
            if key := key_at(data.since(at - run.start())):
                end = at + (key[1] * 2 if is_hex else base64_size(key[1]))
                pad = text[end : end + 2]
                yield key[0], at, end + (0 if is_hex else len(pad) - len(pad.lstrip("=")))
                at = end
            else:
                at += 1


def leading16(run: str) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2])


def token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Three parts with a dot between each: header, payload, signature."""
    held: list[tuple[int, int]] = []
    for m in _PART.finditer(text):
        a, b = m.span()
        if held and not (held[-1][1] == a - 1 and text[a - 1] == "."):
            held = []
        held = [*held[-2:], (a, b)]
        if len(held) == 3 and b - a >= 16 and is_signed_token(text[held[0][0] : b]):
            yield "signed_token", held[0][0], b
            held = []


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of keys and tokens; a run inside another key's span is no key of its own."""
    out: list[tuple[str, int, int]] = []
    if "-----BEGIN" in text:
        for a, b, body in pem_spans(text):
            data = memoryview(decoded64(_ESCAPED.sub("", body)) or b"")
            key = key_at(data)
            if key and key[1] == len(data):
                out.append((key[0], a, b))
    if _RUN64.search(text):
        taken = Taken(out)
        for m in _LINES64.finditer(text):
            if m.start() not in taken:
                out += wrapped_spans(text, *m.span())
        taken = Taken(out)
        out += [s for s in run_spans(text, _RUN64, _HEAD64) if s[1] not in taken]
        out += run_spans(text, _RUN16, _HEAD16)
    if "-" in text or "_" in text:
        taken = Taken(out)
        out += [s for s in run_spans(text, _RUN_URL, _HEAD64) if s[1] not in taken]
    if text.count(".") > 1:
        out += token_spans(text)
    return out


class Taken:
    """Whether a place lies in one of some spans that don't overlap."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = sorted((a, b) for _, a, b in spans)

    def __contains__(self, place: int) -> bool:
        k = bisect.bisect_right(self.spans, (place, 1 << 62)) - 1
        return k >= 0 and place < self.spans[k][1]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, found text) of each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            spans = [[{"kind": k, "start": a, "end": b, "found": t[a:b]} for k, a, b in ordered(base_spans(t) + confirmed_spans(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,found:string>>")


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, derived from the spans of `scan`."""
    found = scan(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
