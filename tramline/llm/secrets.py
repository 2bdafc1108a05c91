"""Secret scans with structural confirmation.

Three base patterns (assignments, access ids, long hex) report what they match.  Beyond them, candidates in base64 or hex are
decoded and reported only if their structure holds: private keys must parse as DER with every nested length exact, or as the
OpenSSH container; signed tokens must have a JSON header that names an algorithm, a JSON payload and a decodable signature.
Base64 may be broken into lines, by line ends or by their escapes as in JSON, with or without armour: a key states its own length,
so exactly that many characters are taken.  An armoured key encrypted under ``DEK-Info`` has no readable structure inside;
its cipher must be known, its vector and its length must fit that cipher's block.

One narrow pass over whole texts.  Positions are code points, ends exclusive.

Defined results: null texts count as empty and have no spans; ties at one start are ordered by kind; repeated rows are scanned alike;
an empty table gives an empty result.  Columns beyond ``doc_id`` and ``text`` are ignored by ``scan`` and carried by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm.common import in_batches

KINDS = ("assign", "access", "hex", "key", "signed")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BEGIN = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
BREAKS = re.compile(r"\\r\\n|\\n|\\r|\r\n|\n|\r")  # line ends and their escapes
KEY_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{6}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LINE_BREAK = re.compile(r"(?:\\r\\n|\\n|\r?\n)[ \t]*(?=[A-Za-z0-9+/_-])")
PAD = re.compile(r"(?:(?:\\r\\n|\\n|\r?\n)[ \t]*)?={1,2}")
SSH_MAGIC = b"openssh-key-v1\0"
#: Block sizes of the ciphers that armoured keys name.
CIPHER_BLOCKS = {"AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16, "DES-EDE3-CBC": 8, "DES-CBC": 8}
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
DEPTH, VALUES = 8, 1000  # a structure that is nested deeper or has more values is no key


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def decode(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def parse_der(get: Callable[[int, int], bytes], at: int, end: int, left: list[int], depth: int = 0) -> list[tuple[int, int, int, list | None]] | None:
    """The values from ``at`` to ``end`` as (tag, start, end, children), or None unless every length is exact.

    ``get(a, b)`` gives bytes; only heads are read.  ``left`` holds how many values may still come: no key has ``VALUES`` of them.
    """
    out = []
    while at < end:
        left[0] -= 1
        head = get(at, min(at + 6, end))
        if len(head) < 2 or depth > DEPTH or left[0] < 0:
            return None
        tag, size, at = head[0], head[1], at + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or len(head) < 2 + more:
                return None
            size, at = int.from_bytes(head[2 : 2 + more], "big"), at + more
            if size < 0x80:
                return None  # not the shortest form
        if at + size > end:
            return None
        inner = parse_der(get, at, at + size, left, depth + 1) if tag & 0x20 else None
        if tag & 0x20 and inner is None:
            return None
        out.append((tag, at, at + size, inner))
        at += size
    return out


def private_key(get: Callable[[int, int], bytes], size: int) -> bool:
    """PKCS#1, SEC1, DSA or PKCS#8 private keys, encrypted PKCS#8, or the OpenSSH container, in ``size`` bytes read by ``get``."""
    if get(0, min(size, len(SSH_MAGIC))) == SSH_MAGIC:
        at = len(SSH_MAGIC)
        for _ in range(3):  # cipher, key derivation and its options
            if at + 4 > size:
                return False
            at += 4 + int.from_bytes(get(at, at + 4), "big")
        return at + 4 <= size and 1 <= int.from_bytes(get(at, at + 4), "big") <= 16
    if get(0, min(size, 1)) != b"\x30" or (top := parse_der(get, 0, size, [VALUES])) is None or len(top) != 1 or not top[0][3]:
        return False
    fields = top[0][3]
    tags = [f[0] for f in fields]
    _, a, b, _ = fields[0]
    if tags[0] == 0x02 and b - a == 1 and get(a, b)[0] <= 1:
        if len(tags) >= 6 and set(tags[:6]) == {0x02}:
            return True
        if tags[1:2] == [0x04] and fields[1][2] - fields[1][1] >= 16:
            return True
        return tags[1:3] == [0x30, 0x04] and _algorithm(fields[1][3])
    return tags == [0x30, 0x04] and _algorithm(fields[0][3])


def _whole(data: bytes) -> bool:
    return private_key(lambda a, b: data[a:b], len(data))


def _algorithm(fields: list | None) -> bool:
    return bool(fields) and fields[0][0] == 0x06 and fields[0][2] - fields[0][1] >= 3


def signed_token(header: str, payload: str, signature: str) -> bool:
    parts = [decode(header), decode(payload)]
    if None in parts or (decode(signature) is None and signature):
        return False
    try:
        head, body = (json.loads(p.decode("utf-8")) for p in parts)
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def armoured_key(body: str) -> bool:
    """Whether what stands between the armour lines is a private key: base64 of one, or one encrypted under named headers."""
    lines = [x.strip() for x in BREAKS.split(body)]
    named = dict(x.split(": ", 1) for x in lines if ": " in x)
    raw = decode("".join("".join(x.split()) for x in lines if ": " not in x))
    if raw is None or not raw:
        return False
    if "DEK-Info" not in named:
        return _whole(raw)
    cipher, _, vector = named["DEK-Info"].partition(",")
    block = CIPHER_BLOCKS.get(cipher)
    whole = block and len(vector) == 2 * block and not set(vector.upper()) - set("0123456789ABCDEF")
    return bool(whole) and named.get("Proc-Type", "").endswith("ENCRYPTED") and len(raw) % block == 0


class Run:
    """Base64 characters in a row, line breaks left out, from ``at`` to the first character that is neither.

    A text is walked once: starts inside a run share it.  Bytes are decoded where they are asked for, so what a start costs does not depend on the
    length that it states.
    """

    def __init__(self, text: str, at: int):
        self.text, self.lines, self.places, parts, n = text, [], [], [], 0
        while m := LINE.match(text, at):
            self.lines.append(at)
            self.places.append(n)
            parts.append(m[0])
            n, at = n + len(m[0]), m.end()
            gap = LINE_BREAK.match(text, at)
            if gap is None:
                break
            at = gap.end()
        self.chars, self.end = "".join(parts).replace("-", "+").replace("_", "/"), at

    def place(self, at: int) -> int:
        """The number of the character that stands at ``at`` in the text."""
        k = bisect.bisect_right(self.lines, at) - 1
        return self.places[k] + at - self.lines[k]

    def after(self, place: int) -> int:
        """Where in the text the characters before ``place`` end."""
        k = bisect.bisect_left(self.places, place) - 1
        return self.lines[k] + place - self.places[k]

    def reader(self, place: int) -> Callable[[int, int], bytes]:
        """Bytes a to b of what is encoded from ``place`` on."""

        def get(a: int, b: int) -> bytes:
            low = a // 3
            some = self.chars[place + 4 * low : place + -(-b * 8 // 6)]
            return base64.b64decode(some[: len(some) - (len(some) % 4 == 1)] + "=" * (-len(some) % 4 % 3))[a - 3 * low : b - 3 * low]

        return get


def _key_size(get: Callable[[int, int], bytes], ssh: bool, most: int) -> int | None:
    """The length in bytes that a key states at its start, if its first fields are those of a private key and ``most`` bytes hold it."""
    if ssh:
        size = len(SSH_MAGIC)
        if get(0, min(size, most)) != SSH_MAGIC:
            return None
        for k in range(6):  # cipher, key derivation, its options, the number of keys, public and private part
            if size + 4 > most:
                return None
            n = int.from_bytes(get(size, size + 4), "big")
            if k == 3 and n != 1:
                return None
            size += 4 if k == 3 else 4 + n
        return size if size <= most else None
    raw = get(0, min(6, most))
    if len(raw) < 6 or raw[0] != 0x30:
        return None
    more = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if more > 3:
        return None
    size = 2 + more + (int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1])
    return size if size <= most and raw[2 + more] in (0x02, 0x30) else None


def bare_key(run: Run, at: int) -> int | None:
    """Where the key that starts at ``at`` ends, padding included, if one does."""
    place = run.place(at)
    get = run.reader(place)
    size = _key_size(get, run.text.startswith("b3", at), (len(run.chars) - place) * 6 // 8)
    if size is None or not private_key(get, size):
        return None
    end = run.after(place + -(-size * 8 // 6))
    pad = PAD.match(run.text, end) if size % 3 else None
    end = pad.end() if pad else end
    return None if LINE.match(run.text, end) else end


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "PRIVATE KEY-----" in text:
        for m in BEGIN.finditer(text):
            end = text.find("-----", m.end())
            tail = f"-----END {m[1]}-----"
            if end > 0 and text.startswith(tail, end) and armoured_key(text[m.end() : end]):
                out.append(("key", m.start(), end + len(tail)))
    if "eyJ" in text:
        out += [("signed", m.start(), m.end()) for m in SIGNED.finditer(text) if signed_token(m[1], m[2], m[3])]
    # Starts come in order, so one pass over the spans found so far tells which of them lie inside one.
    known = sorted((a, b) for _, a, b in out)
    k = last = 0
    run = None
    for m in KEY_START.finditer(text):
        while k < len(known) and known[k][0] <= m.start():
            last = max(last, known[k][1])
            k += 1
        if m.start() < last:
            continue
        if run is None or m.start() >= run.end:
            run = Run(text, m.start())
        if (end := bare_key(run, m.start())) is not None:
            out.append(("key", m.start(), end))
            last = end
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and _whole(bytes.fromhex(m[0])):
            out.append(("key", m.start(), m.end()))
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in _ordered(spans))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts of base spans, ``base_sha256`` of them joined, and ``spans``: all, joined as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + confirmed_spans(text))))
            cols = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return in_batches(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans go together."""
    at, names = docs.columns.index("text"), docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for kind, a, b in _ordered(base_spans(text) + confirmed_spans(text)):
            if a >= last:
                out += [text[last:a], f"[{kind}]"]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns
            columns[at] = pa.array([clean(t.as_py()) for t in columns[at]], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_batches(docs, run, docs.schema)
