"""Token counts by a compiled transducer.

A byte-level BPE tokenizer becomes a deterministic finite-state transducer over bytes whose transitions carry the change of the
number of tokens.  After every byte of a word the last token of the encoding so far is unique: it is the one token that ends
there and may follow the last token at its own start (a sequence is the encoding exactly if each adjacent pair encodes to
itself).  A state therefore holds, for each start whose bytes may still grow into a token, the node in the trie of tokens, the
last token there and the difference of the counts.  These states are finite in number; they are compiled when first met and
dropped together once there are ``STATES`` of them, except those in use.

Words are the matches of the tokenizer's pattern.  Where a word starts is a function of a few neighbouring characters, so the
starts of a whole batch come from array comparisons; a byte that starts a word leads to its state from any state at all.

Each text is cut into chunks of ``CHUNK`` bytes, and the transducer runs over the chunks of a batch in lockstep.  The map of a
chunk, from the state before it to the state after it and the tokens emitted, is kept as a head (the bytes before its first word start)
and the count and exit from there on, which no entry changes.  A prefix scan composes the maps: all exits that are constant
are known at once, the heads behind them run side by side, and a chunk without any word start hands its exit on to the next round.

Defined results: null and empty texts have no bytes and no tokens; special strings inside texts are single tokens, as is the library's
default; very long texts are read in pieces of ``PIECE`` characters with the state carried over; repeated rows are counted alike;
an empty table gives an empty result.  Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tramline.llm.common import in_batches

CHUNK, PIECE, SLICE_BYTES, STATES = 1024, 1 << 20, 1 << 21, 100_000
BELOW = 100
CONTEXT = 8  # characters on either side that say where words start
FEW = 12  # lanes below which plain loops are faster than arrays
LIMIT = 512
LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # what ``starts`` computes
#: White space beyond the categories Zs, Zl and Zp.
CONTROL_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
_COMPILED: dict[str, Transducer] = {}  # one per Python worker


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point in the pattern."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(CONTROL_SPACES)] = SPACE
    return out


def starts(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which characters start a word; ``first`` and ``last`` mark the ends of the texts that the array holds."""
    kind = classes()[points]
    before, after = np.r_[np.uint8(EDGE), kind[:-1]], np.r_[kind[1:], np.uint8(EDGE)]
    before[first], after[last] = EDGE, EDGE
    blank = np.r_[False, points[:-1] == 0x20] & (before == SPACE)
    start = np.where(kind == SPACE, (before != SPACE) | (after < SPACE), (before != kind) & ~blank)
    # Contractions: an apostrophe that starts a word, and one or two letters.
    at = np.nonzero(start & (points == 0x27) & ~last)[0]
    if len(at):
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        two = np.where(last[at + 1], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        for where, n in ((at[short], 2), (at[long], 3)):
            start[where + 1] = False
            more = where[~last[where + n - 1]] + n
            start[more] = True
    return start


class Transducer:
    """States and transitions of one vocabulary; ``move`` runs many lanes at once."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)
        pre = model["pre_tokenizer"] or {}
        if model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in model["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not compiled")
        self.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        text_of = _visible()
        byte_of = {c: b for b, c in text_of.items()}
        ids = {bytes([b]): b for b in range(256)}
        data = [bytes([b]) for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # of a token: left part, right part, rank
        self.right: dict[tuple[int, int], list[int]] = {}  # ranks of the merges of a left part, by the first byte of the right part; -1: any
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = (bytes(byte_of[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b not in ids:
                ids[a + b] = len(data)
                data.append(a + b)
                self.made[ids[a + b]] = ids[a], ids[b], rank
            if (ids[a], ids[b]) not in self.ranks:
                self.ranks[ids[a], ids[b]] = rank, ids[a + b]
                for c in (-1, b[0]):
                    self.right.setdefault((ids[a], c), []).append(rank)
        self.data = data
        # Trie: children by node and byte, the token of a node.
        self.child: dict[int, int] = {}
        self.token = [-1]
        for word, own in ids.items():
            node = 0
            for b in word:
                key = node << 8 | b
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = own
        self.below: list[list[int]] = [[] for _ in self.token]  # the tokens below a node, BELOW + 1 at most
        for word, own in ids.items():
            node = 0
            for b in word:
                if len(self.below[node]) <= BELOW:
                    self.below[node].append(own)
                node = self.child[node << 8 | b]
        self.column, self.bytes, self.width = np.full(256, -1, np.int64), [], 128
        self._clear()

    def _clear(self) -> None:
        self.pairs: dict[tuple, bool] = {}
        self.tails: dict[int, tuple] = {}
        self.narrow: dict[tuple, tuple] = {}
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.next = np.full((1024, self.width), -1, np.int32)
        self.emit = np.zeros((1024, self.width), np.int8)
        self.intern(((0, (), 0),))  # state 0: before a word

    def intern(self, state: tuple) -> int:
        own = self.ids.get(state)
        if own is None:
            own = self.ids[state] = len(self.states)
            self.states.append(state)
            if own == len(self.next):
                self.next = np.r_[self.next, np.full_like(self.next, -1)]
                self.emit = np.r_[self.emit, np.zeros_like(self.emit)]
        return own

    def encode(self, word: bytes) -> list[int]:
        """The merges of one word, plainly."""
        out = list(word)
        while len(out) > 1:
            found = [(self.ranks[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.ranks]
            if not found:
                break
            i = min(found)[1]
            out[i : i + 2] = [self.ranks[out[i], out[i + 1]][1]]
        return out

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the left (0) or right (1) end of a token while it is being merged, each with the rank at which it goes."""
        out, rank = [], math.inf
        while True:
            out.append((token, rank))
            if token not in self.made:
                return out
            *parts, rank = self.made[token]
            token = parts[side]

    def tail(self, last: int) -> tuple:
        """What matters of a last token to those that follow: the parts at its right end, each with how many of the merges that it
        could begin come before it goes."""
        if last not in self.tails:
            found = ((x, bisect.bisect_left(self.right.get((x, -1), ()), rank)) for x, rank in self.edge(last, 1))
            self.tails[last] = tuple((x, n) for x, n in found if n)
        return self.tails[last]

    def narrowed(self, tail: tuple, byte: int) -> tuple:
        """A tail as it matters to tokens that begin with ``byte``."""
        key = tail, byte
        out = self.narrow.get(key)
        if out is None:
            found = ((x, bisect.bisect_left(self.right.get((x, byte), ()), self._limit(x, -1, n))) for x, n in tail)
            out = self.narrow[key] = tuple((x, n) for x, n in found if n)
        return out

    def _limit(self, x: int, byte: int, n: int) -> float:
        ranks = self.right.get((x, byte), ())
        return ranks[n] if n < len(ranks) else math.inf

    def follows(self, tail: tuple, token: int) -> bool:
        """Whether ``token`` can be the next one after a tail narrowed to its first byte: no part of either merges across before it goes.

        Of equal merges the left one comes first, so one inside the left token is done before one across, and one across before
        one inside the right token.
        """
        key = tail, token
        ok = self.pairs.get(key)
        if ok is None:
            byte = self.data[token][0]
            ok = self.encode(self.data[token]) == [token] if not tail else self.follows((), token)
            for x, n in tail if ok else ():
                limit = self._limit(x, byte, n)
                for y, gone in self.edge(token, 0):
                    rank = self.ranks.get((x, y), (math.inf,))[0]
                    if rank < limit and rank <= gone:
                        ok = False
            self.pairs[key] = ok
        return ok

    def alive(self, node: int, tail: tuple) -> bool:
        """Whether any longer token below ``node`` can follow ``tail``; beyond ``BELOW`` of them it is not worth the question."""
        if not tail:
            return True
        key = tail, ~node
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = len(self.below[node]) > BELOW or any(self.follows(tail, t) for t in self.below[node])
        return ok

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The columns of bytes in the tables; a byte gets one when first met."""
        for b in np.nonzero(np.bincount(data, minlength=256) * (self.column < 0))[0].tolist():
            self.column[b] = len(self.bytes)
            self.bytes.append(b)
        if len(self.bytes) > self.width:
            self.next = np.pad(self.next, ((0, 0), (0, 256 - self.width)), constant_values=-1)
            self.emit = np.pad(self.emit, ((0, 0), (0, 256 - self.width)))
            self.width = 256
        return self.column[data]

    def compile(self, state: int, column: int) -> None:
        """The transition of ``state`` on the byte of ``column``."""
        byte = self.bytes[column]
        grown, taken = [], None
        for node, tail, less in self.states[state]:
            tail = self.narrowed(tail, byte) if node == 0 else tail
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            token = self.token[node]
            if token >= 0 and taken is None and self.follows(tail, token):
                taken = token, less + 1
            if self.below[node] and self.alive(node, tail):
                grown.append((node, tail, less))
        if taken is None:
            raise ValueError("the vocabulary isn't closed under its merges")
        token, emitted = taken
        own = self.intern((*((node, tail, less - emitted) for node, tail, less in grown), (0, self.tail(token), 0)))
        self.next[state, column], self.emit[state, column] = own, emitted

    def shrink(self, *used: np.ndarray) -> None:
        """Once there are too many states, keeps those in the given arrays, which are renumbered in place."""
        if len(self.states) <= STATES:
            return
        old = self.states
        self._clear()
        for array in used:
            values, where = np.unique(array, return_inverse=True)
            array[:] = np.array([self.intern(old[v]) for v in values], array.dtype)[where.reshape(-1)] if len(values) else array

    def move(self, data: np.ndarray, start: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, count: np.ndarray, used: tuple = ()) -> None:
        """Runs every lane over the columns of its ``size`` bytes from ``at`` on; ``state`` and ``count`` are changed in place."""
        order = np.argsort(-size, kind="stable")
        at, size, now, got = at[order], size[order], state[order], count[order]
        lanes = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), side="right")
        t = 0
        while t < len(lanes) and lanes[t] > FEW:
            k = int(lanes[t])
            where = at[:k] + t
            byte, before = data[where], np.where(start[where], 0, now[:k])
            after = self.next[before, byte]
            missing = after < 0
            if missing.any():
                for s, b in {*zip(before[missing].tolist(), byte[missing].tolist(), strict=True)}:
                    self.compile(s, b)
                after = self.next[before, byte]
            got[:k] += self.emit[before, byte]
            now[:k] = after
            if len(self.states) > STATES:
                self.shrink(now, *used)
            t += 1
        if t < len(lanes):
            for lane in range(int(lanes[t])):
                self._one(data, start, int(at[lane]) + t, int(at[lane] + size[lane]), lane, now, got, used)
        state[order], count[order] = now, got

    def _one(self, data: np.ndarray, start: np.ndarray, low: int, high: int, lane: int, now: np.ndarray, got: np.ndarray, used: tuple) -> None:
        for a in range(low, high, CHUNK):  # by bounded stretches, between which states can be dropped
            b = min(high, a + CHUNK)
            s, n = int(now[lane]), int(got[lane])
            for byte, fresh in zip(data[a:b].tolist(), start[a:b].tolist(), strict=True):
                if fresh:
                    s = 0
                if self.next[s, byte] < 0:
                    self.compile(s, byte)
                n += int(self.emit[s, byte])
                s = int(self.next[s, byte])
            now[lane], got[lane] = s, n
            self.shrink(now, *used)

    def count(self, pieces: list[tuple[str, int, int, bool, bool]], entry: tuple | None) -> tuple[np.ndarray, tuple]:
        """Tokens of each piece, and the state after the last.

        A piece is a text with its context: characters before and after that only say where words start, and whether the text
        really starts and ends there.  ``entry`` is the state before the first piece if it goes on from another.
        """
        texts = [p[0] for p in pieces]
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
        first[(ends - sizes)[sizes > 0]], last[(ends - 1)[sizes > 0]] = True, True
        start = starts(points, first, last)
        own = np.ones(len(points), bool)
        for (_, left, right, opens, _), end, n in zip(pieces, ends.tolist(), sizes.tolist(), strict=True):
            own[end - n : end - n + left] = own[end - right : end] = False
            if n and opens:
                start[end - n] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        data = self.columns(np.frombuffer("".join(texts).encode(), np.uint8))
        flag = np.zeros(len(data) + 1, bool)
        flag[place[start & own]] = True
        edges = np.r_[place, len(data)]
        low = edges[[e - n + p[1] for p, e, n in zip(pieces, ends.tolist(), sizes.tolist(), strict=True)]] if pieces else np.zeros(0, np.int64)
        high = edges[[e - p[2] for p, e in zip(pieces, ends.tolist(), strict=True)]] if pieces else np.zeros(0, np.int64)
        return self._scan(data, flag[:-1], low, high, entry)

    def _scan(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, entry: tuple | None) -> tuple[np.ndarray, tuple]:
        n = -(-(high - low) // CHUNK)
        piece = np.repeat(np.arange(len(low)), n)
        at = low[piece] + (np.arange(len(piece)) - (np.cumsum(n) - n)[piece]) * CHUNK
        end = np.minimum(at + CHUNK, high[piece])
        marks = np.nonzero(start)[0]
        k = np.searchsorted(marks, at)
        sync = np.minimum(np.r_[marks, len(data)][k], end)  # the first word start of the chunk
        exits, count = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        carried = np.array([self.intern(entry)] if entry is not None else [0], np.int32)
        self.move(data, start, sync, end - sync, exits, count, (carried,))
        # The scan: heads whose entry is known run together; a chunk that is all head makes its exit known.
        known, todo = sync < end, sync > at
        while todo.any():
            i = np.nonzero(todo)[0]
            opens = np.r_[True, piece[1:] != piece[:-1]][i]
            ready = opens | known[i - 1]
            i, opens = i[ready], opens[ready]
            state = np.where(opens, carried[0], exits[i - 1]).astype(np.int32)
            head = np.zeros(len(i), np.int64)
            self.move(data, start, at[i], sync[i] - at[i], state, head, (exits, carried))
            count[i] += head
            whole = ~known[i]
            exits[i[whole]] = state[whole]
            known[i], todo[i] = True, False
        after = self.states[int(exits[-1])] if len(exits) and len(n) and n[-1] else entry or self.states[0]
        return np.bincount(piece, count, len(low)).astype(np.int64), after


def _visible() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def transducer(raw: bytes) -> Transducer:
    """The transducer of a vocabulary file's bytes, one per worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(raw)
    return _COMPILED[key]


def count_texts(machine: Transducer, texts: Iterator[str | None]) -> list[int]:
    """Tokens of each text, worked off in slices of about ``SLICE_BYTES`` characters."""
    total: list[int] = []
    pieces, owner, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if pieces:
            for k, n in zip(owner, machine.count(pieces, None)[0].tolist(), strict=True):
                total[k] += n
        pieces.clear(), owner.clear()
        held = 0

    for k, text in enumerate(texts):
        total.append(0)
        parts = machine.cut.split(text) if text and machine.cut else [text or ""]
        total[k] += len(parts) - 1
        for part in filter(None, parts):
            if len(part) <= PIECE:
                pieces.append((part, 0, 0, True, True))
                owner.append(k)
                held += len(part)
                if held >= SLICE_BYTES:
                    flush()
                continue
            state = None
            for a in range(0, len(part), PIECE):
                left, right = min(a, CONTEXT), min(max(0, len(part) - a - PIECE), CONTEXT)
                n, state = machine.count([(part[a - left : a + PIECE + right], left, right, a == 0, right == 0)], state)
                total[k] += int(n[0])
    flush()
    return total


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.  The vocabulary file, 64 MB at most, is broadcast."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    raw = Path(vocabulary).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    held = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            tokens = count_texts(machine, (t.as_py() for t in batch.column(1)))
            sizes = [0 if t is None else t for t in pc.binary_length(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean"
    return in_batches(docs.select("doc_id", "text"), run, schema)
