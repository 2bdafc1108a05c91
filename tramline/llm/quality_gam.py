"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes ``FEATURES`` numbers.  Cyclic boosting visits the features in turn, each time fitting one shallow tree (two
levels, on the bins of that feature alone) to the current gradient and adding it, shrunk, to that feature's lookup table;
afterwards the pairs whose joint bins explain most of what is left get two-dimensional tables by the same kind of
trees.  Scoring is a bin search and a table addition per feature and pair, for whole batches at once.

Training takes at most about ``max_rows`` labelled rows (a bounded, hashed sample), of which only the features reach the
driver.  Scoring is one narrow pass over every text.

Defined results: null texts count as empty, whose features are all zero, and get a score like any other; repeated rows are
scored alike; rows without a label or id aren't learned from; with no labels or one class only the score is the smoothed
share of that class; an empty table gives an empty result.  Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import in_batches, labelled_sample

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "pipes", "stops", "commas", "bangs", "line_words",
    "dup_lines", "distinct", "top_share", "wide", "ends_marked", "dup_pairs",
)
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.25
RIDGE, MIN_HESS = 1.0, 1.0
MAX_ROWS = 12_000
_CLASS = np.zeros((256, 8), np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b".?;:", b",", b"!", bytes(range(128, 256)))):
    _CLASS[list(_chars), _k] = 1
_MARKS = b"#*$%&|<>!"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    upper, digits, symbols, pipes, stops, commas, bangs, wide = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist()
    size = len(raw)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts = Counter(words)
    pairs = n - 1 - len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    marked = sum(c for w, c in counts.items() if w[-1] in _MARKS)
    return [
        math.log1p(n), (size - n) / n, upper / size, digits / size, symbols / n, pipes / n, stops / n, commas / n, bangs / n, n / len(lines),
        1 - len(set(lines)) / len(lines), len(counts) / n, counts.most_common(1)[0][1] / n, wide / size, marked / n, pairs / n,
    ]


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a two-level tree on ordered bins with gradient sums ``g`` and curvature sums ``h``."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(gl):
            return 0.0, -1
        gr, hr = g[lo:hi].sum() - gl, h[lo:hi].sum() - hl
        gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gl + gr) ** 2 / (hl + hr + RIDGE)
        gain[(hl < MIN_HESS) | (hr < MIN_HESS)] = -1
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1 if gain[k] > 0 else -1

    cuts = [0, len(g)]
    first = best(0, len(g))[1]
    if first > 0:
        cuts = sorted({0, first, len(g), *[c for c in (best(0, first)[1], best(first, len(g))[1]) if c > 0]})
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four-leaf cross on a grid of bins: one cut of each axis; Newton steps and the gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    top, out = -1.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            a = np.array([G[i, j], G[i, -1] - G[i, j], G[-1, j] - G[i, j], G[-1, -1] - G[i, -1] - G[-1, j] + G[i, j]])
            b = np.array([H[i, j], H[i, -1] - H[i, j], H[-1, j] - H[i, j], H[-1, -1] - H[i, -1] - H[-1, j] + H[i, j]])
            gain = (a**2 / (b + RIDGE)).sum() - a.sum() ** 2 / (b.sum() + RIDGE)
            if gain > top:
                step = -a / (b + RIDGE)
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
                top = gain
    return out, top


class Gam:
    """Bin edges, one lookup table per feature, and coarse two-dimensional tables for some pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [e[:: max(1, len(e) // (PAIR_BINS - 1))] for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(set(y.tolist())) < 2:
            return
        bins = self._bins(x, self.edges)
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for d, table in enumerate(self.tables):
                g, h = self._pull(f, y)
                step = RATE * _tree(np.bincount(bins[d], g, len(table)), np.bincount(bins[d], h, len(table)))
                table += step
                f += step[bins[d]]
        low = self._bins(x, self.coarse)
        shape = [len(c) + 1 for c in self.coarse]

        def grid(i: int, j: int) -> tuple[np.ndarray, float]:
            g, h = self._pull(f, y)
            at, size = low[i] * shape[j] + low[j], shape[i] * shape[j]
            return _cross(np.bincount(at, g, size).reshape(shape[i], shape[j]), np.bincount(at, h, size).reshape(shape[i], shape[j]))

        every = [(i, j) for j in range(len(shape)) for i in range(j) if min(shape[i], shape[j]) > 1]
        chosen = sorted(every, key=lambda p: -grid(*p)[1])[:PAIRS]
        made = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in chosen}
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in made.items():
                step = RATE * grid(i, j)[0]
                table += step
                f += step[low[i], low[j]]
        self.pairs = [(i, j, table) for (i, j), table in made.items()]

    @staticmethod
    def _pull(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for b, table in zip(self._bins(x, self.edges), self.tables, strict=True):
            f += table[b]
        if self.pairs:
            low = self._bins(x, self.coarse)
            for i, j, table in self.pairs:
                f += table[low[i], low[j]]
        return 1 / (1 + np.exp(-f))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, seed: int = 5) -> Gam:
    """Learn ``label`` (0 or 1, beside ``doc_id`` in ``labels``) from the texts of ``docs``."""
    rows = labelled_sample(docs, labels, label, max_rows, seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = in_batches(rows, measure, "x array<double>, y double").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the order of rows from the cluster doesn't matter
    return Gam(x[order], (y[order] > 0).astype(np.float64))


def score(docs: DataFrame, model: Gam, held_out: Column, cut: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], np.float64).reshape(-1, len(FEATURES))
            p = held.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return in_batches(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
