"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton over word ids.  Training texts stream through it word by word;
after each word the state is the longest suffix of the text that occurs in some item.  When that length reaches a window
(``window`` words, or the whole of a shorter item), the words of the window are hit and its state names the items.

Items are held in blocks whose total words are bounded by ``BLOCK_WORDS``: one block is one automaton in each task's
and in the driver's memory.  A larger benchmark means further passes, each of which reads the texts alone and stores only the
hits, keyed by the text's hash; they are merged and joined to the documents once, so that however many blocks there are the
documents are handed on once.  There, an item longer than a fraction of a block is split into pieces that overlap by a window
less one word, which have the same windows; so nothing of unproven size is ever collected or broadcast.

Defined results: null or empty texts have no words and no hits; items that are null, empty or have a null id are ignored
(a null id is no item that could be named); repeated items count once per id; ties need no rule as every occurring item is
listed; an empty table gives an empty result, an empty benchmark marks nothing.  Extra columns are carried along, whatever
their names.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import discard, in_batches, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_WORDS = 500_000  # measured: some 0.4 kB a word in each worker, words that occur once included
WINDOW = 10
#: ``remove``: hits of at least this many words in a row are cut; beyond this share of hit words the document goes.
MIN_SPAN, MAX_COVERAGE = 10, 0.5


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton of the items' words, in flat arrays, with the items of each window.

    Most states have one way on, kept in two arrays; only the others own a dictionary.  A state whose strings are longer than a
    window leads, by ``window_of``, to the state of its last ``window`` words; only those states name items, by the number
    of an interned set.  So an item adds one entry for each of its windows, and a scan does constant work for each word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        whole: list[tuple[str, list[int]]] = []
        for name, ws in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            whole.append((name, seq))
            last = 0
            for w in seq:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.window_of = array("i", [-1]) * len(self.link)
        for p in order:
            if self.length[p] >= window:
                up = self.link[p]
                self.window_of[p] = p if self.length[up] < window else self.window_of[up]
        names: dict[int, list[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}  # state -> lengths and names of short items that end there
        for name, seq in whole:
            at = 0
            for k, w in enumerate(seq, 1):
                at = self._next(at, w)
                if k >= window:
                    names.setdefault(self.window_of[at], []).append(name)
            if 0 < len(seq) < window:
                ends = self.short.setdefault(at, [])
                same = [found for n, found in ends if n == len(seq)]
                same[0].add(name) if same else ends.append((len(seq), {name}))
        self.sets: list[tuple[str, ...]] = []
        self.named = array("i", [-1]) * len(self.link)
        known: dict[tuple[str, ...], int] = {}
        for p, some in names.items():
            self.named[p] = known.setdefault(tuple(sorted(set(some))), len(known))
        self.sets = list(known)
        # The nearest state on the way up, itself included, where a short item ends: at most ``window`` of them in a row.
        self.end_up = array("i", [-1]) * len(self.link)
        for p in order:
            self.end_up[p] = p if p in self.short else self.end_up[self.link[p]]

    def _next(self, p: int, w: int) -> int:
        if self.word[p] == w:
            return self.to[p]
        return self.more[p].get(w, -1) if p in self.more else -1

    def _set(self, p: int, w: int, q: int) -> None:
        if self.word[p] == w or self.word[p] < 0:
            self.word[p], self.to[p] = w, q
        else:
            self.more.setdefault(p, {})[w] = q

    def _new(self, length: int) -> int:
        for column, value in ((self.word, -1), (self.to, -1), (self.link, -1), (self.length, length)):
            column.append(value)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.length[p] + 1)
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self._next(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self._next(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and self._next(p, w) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self._next(p, w)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def scan(self, tokens: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items that have an occurring window."""
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        window_of, named, end_up, short, window = self.window_of, self.named, self.end_up, self.short, self.window
        spans: list[list[int]] = []
        sets: set[int] = set()
        found: set[str] = set()
        get, none = self.ids.get, {}
        at = size = 0
        for j, token in enumerate(tokens):
            w = get(token)
            if w is None:
                at = size = 0
                continue
            while True:
                q = to[at] if word[at] == w else more.get(at, none).get(w, -1)
                if q >= 0 or not at:
                    break
                at = link[at]
                size = length[at]
            if q < 0:
                continue
            at, size = q, size + 1
            if size >= window:
                sets.add(named[window_of[at]])
                _cover(spans, j + 1 - window, j + 1)
            p = end_up[at]
            while p >= 0:
                for n, names in short[p]:
                    if n <= size:
                        found |= names
                        _cover(spans, j + 1 - n, j + 1)
                p = end_up[link[p]]
        return spans, found.union(*[self.sets[k] for k in sets])


def _cover(spans: list[list[int]], start: int, end: int) -> None:
    while spans and spans[-1][1] >= start:
        a, b = spans.pop()
        start, end = min(start, a), max(end, b)
    spans.append([start, end])


_BUILT: dict[str, Automaton] = {}  # one per Python worker: the automaton of the block at hand


def _automaton(block: str, held: Broadcast, window: int) -> Automaton:
    if block not in _BUILT:
        _BUILT.clear()
        _BUILT[block] = Automaton(held.value, window)
    return _BUILT[block]


def pieces(text: str, size: int, window: int) -> list[str]:
    """The words of ``text`` in pieces of at most ``size`` words, more than a window, which together have the same windows."""
    ws = words(text)
    step = size - window + 1
    starts = range(0, max(1, len(ws) - window + 1), step)
    return [b" ".join(ws[k : k + size]).decode("utf-8", "surrogatepass") for k in starts]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> tuple[int, Iterator[list[tuple[str, list[bytes]]]]]:
    """How many blocks there are, and the items by blocks of about ``block_words`` words each, one collected at a time.

    The rows of one id are spread over the blocks by their texts, and so are the pieces of a long item.
    """
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (block_words * 2)))  # a word and its separator have two characters at least
    size = max(4 * window, block_words // 4)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = pieces(text.as_py(), size, window)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.string())], names=["item_id", "text"])

    if parts > 1:
        long = F.length("text") >= 2 * size
        items = stored(items.filter(~long).unionByName(in_batches(items.filter(long), split, items.schema)).distinct(), "benchmark")

    def each() -> Iterator[list[tuple[str, list[bytes]]]]:
        for k in range(parts):
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
            yield [(r[0], ws) for r in sorted(rows) if (ws := words(r[1]))]

    return parts, each()


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def hits_column(docs: DataFrame) -> str:
    """The column that ``scan`` adds: ``_hits``, with more underscores where the input has that name already."""
    return _unused(docs, "_hits")


def _found(docs: DataFrame, key: str, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """Stored: ``key, spans, items`` of the distinct texts that a block of items hits; the pass reads no other column."""
    block, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType.fromDDL(f"{key} string, spans array<array<int>>, items array<string>")
    kinds = [pa.string(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(block, held, window)
        for batch in batches:
            rows = [(k, *machine.scan(words(text.as_py()))) for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            rows = [(k, spans, sorted(names)) for k, spans, names in rows if spans]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    texts = docs.filter("text is not null").select(F.sha2("text", 256).alias(key), "text")
    out = stored(in_batches(texts, run, schema).dropDuplicates([key]), "hits")
    held.destroy()
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, change: Callable | None = None) -> DataFrame:
    """``docs`` with ``hits_column`` added: ``n_words``, merged word ``spans`` [start, end) that are hit, and sorted ``items``.

    One narrow pass over the texts, without a shuffle, where the benchmark is one block; otherwise one for each block and a
    join with what they found.  ``change`` may turn the last pass's batches, which end with the hits, into others of the same
    columns, without a second hand-over of the texts.
    """
    hits, key = hits_column(docs), _unused(docs, "_key")
    schema = T.StructType([*docs.schema.fields, T.StructField(hits, T.StructType.fromDDL("n_words long, spans array<array<int>>, items array<string>"))])
    at, width = docs.columns.index("text"), len(docs.columns)
    many, each = blocks(benchmark, block_words, window)
    if many > 1:
        found = [_found(docs, key, items, window) for items in each]
        merged = reduce(DataFrame.unionByName, found).groupBy(key)  # a text has one row from each block at most
        merged = stored(merged.agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).alias(hits)), "merged")
        for f in found:
            discard(f)
        docs, block, held = docs.withColumn(key, F.sha2("text", 256)).join(merged, key, "left").drop(key), None, None
    else:
        block, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(next(each))

    def of(text: str | None, earlier: dict | None, machine: Automaton | None) -> dict:
        ws = words(text)
        if machine is not None:
            spans, names = machine.scan(ws)
        else:
            spans, names = [], set(earlier["items"] if earlier else ())
            for a, b in sorted(map(tuple, earlier["spans"] if earlier else ())):
                _cover(spans, a, b)
        return {"n_words": len(ws), "spans": spans, "items": sorted(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(block, held, window) if held is not None else None
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
        for batch in batches:
            earlier = batch.column(width).to_pylist() if machine is None else [None] * len(batch)
            got = [of(text.as_py(), e, machine) for text, e in zip(batch.column(at), earlier, strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(got, kind)], names=schema.names)
            yield change(out) if change else out

    return in_batches(docs, run, schema)


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document how much of it is hit and by which items."""
    h = scan(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return h.select(
        "doc_id",
        "_hits.n_words",
        n_hit.alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without what the benchmark covers.

    Documents of whose words more than ``max_coverage`` are hit go.  From the others, every run of hit words that has at
    least ``min_span`` words is cut with the separators inside it, and so is a run shorter than a window, which only whole
    short items can make up; runs in between stay.  ``n_chars`` follows where there is such a column.  All other
    documents stay as they are.
    """
    at, names = docs.columns.index("text"), docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = batch.column(batch.num_columns - 1).to_pylist()
        keep = [sum(b - a for a, b in h["spans"]) <= max_coverage * h["n_words"] for h in hits]
        batch = batch.filter(pa.array(keep, pa.bool_()))
        spans = [h["spans"] for h, k in zip(hits, keep, strict=True) if k]
        columns = batch.columns
        texts = [cut(text.as_py(), x, min_span, window) for text, x in zip(columns[at], spans, strict=True)]
        columns[at] = pa.array(texts, columns[at].type)
        if chars is not None:
            sizes = [len(t) if x and t is not None else n.as_py() for t, x, n in zip(texts, spans, columns[chars], strict=True)]
            columns[chars] = pa.array(sizes, columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan(docs, benchmark, window, change=change).drop(hits_column(docs))


def cut(text: str | None, spans: list[list[int]], min_span: int, window: int) -> str | None:
    """``text`` without the word spans of ``min_span`` words or more, and without those that whole short items made."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    keep, last = [], 0
    for start, end in spans:
        if end - start >= min_span or end - start < window:
            keep.append(raw[last : at[start][0]])
            last = at[end - 1][1]
    return b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")
