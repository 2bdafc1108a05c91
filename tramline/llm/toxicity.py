"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a word embedding and the mean embedding of its character n-grams (both hashed).  A forward
and a backward GRU read each window of ``SPAN`` words, attention pools their states, and a logistic unit scores the
window.  Windows overlap by half and cover the whole text.  A document's score comes from its highest window and the
number of its windows, calibrated on the training documents.

Training is multiple-instance learning: the label belongs to the document, the evidence to some window.  Smoothed log-odds of
the n-grams (which also start one embedding dimension) propose each document's windows; after a first pass the network
proposes them itself.  At most about ``max_rows`` labelled rows are used (a bounded, hashed sample), whose unique words and
word numbers reach the driver.  Scoring is one narrow pass; words are projected once per batch and cached.

Defined results: null and wordless texts have no window and get the lowest calibrated score; repeated rows are scored alike; rows
without a label or id aren't learned from; with no labels or one class only the score is the smoothed share of that
class; an empty table gives an empty result.  Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import in_batches, labelled_sample

SPAN, STEP = 32, 16
EMBED, HIDDEN = 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
MAX_ROWS, EPOCHS, BATCH, RATE = 3000, 6, 64, 0.01
LEAST_DOCS = 3
DROP, EMBED_RATE = 0.4, 4  # share of words hidden from a training window; embeddings learn this much faster
ODDS = 0.5  # share of the n-gram log-odds that starts the first embedding dimension
CALIBRATE = 5  # every fifth training document
LEAST_STEPS = 200  # small samples are gone through more often
WORDS_CACHED = 200_000
GROUP = 4096  # windows at a time
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the 3- to 5-byte n-grams of all marked words in a row, and where each word's begin."""
    marked = [f"<{w}>".encode("utf-8", "surrogatepass") for w in tokens]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer(b"".join(marked) + bytes(4), np.uint8).astype(np.uint32)
    n = len(codes) - 4
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes up to the word's end
    h = codes[:n] * np.uint32(0x01000193) ^ codes[1 : n + 1]
    out = np.empty((n, 3), np.int64)
    for k in range(3):
        h = (h * np.uint32(0x01000193)) ^ codes[k + 2 : n + k + 2]
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, k] = (x ^ (x >> np.uint32(13))) % np.uint32(GRAM_BUCKETS)
    ok = left[:, None] >= np.array([3, 4, 5])
    per = np.add.reduceat(ok.sum(axis=1), np.cumsum(sizes) - sizes) if len(tokens) else np.zeros(0, np.int64)
    return out[ok], np.cumsum(np.concatenate([[0], per]))


def buckets(tokens: list[str]) -> np.ndarray:
    """Hashed buckets of whole words."""
    return np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in tokens), np.int64, len(tokens))


def windows(n: int) -> list[int]:
    """Where the windows of a text of ``n`` words start: every ``STEP`` words, the last one ending with the text."""
    return [*range(0, max(1, n - SPAN), STEP), *([n - SPAN] if n > SPAN else [])] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name; float32 throughout."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"word": np.zeros((WORD_BUCKETS, EMBED)), "gram": r.normal(0, 0.1, (GRAM_BUCKETS, EMBED))}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)), f"U{d}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
        self.p |= {"a": r.normal(0, 0.5, 2 * HIDDEN), "o": r.normal(0, 0.5, 2 * HIDDEN), "z": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.calibration = (0.0, 1.0, 0.0)  # intercept, weight of the top logit, weight of log windows
        self.constant: float | None = None

    def embed(self, tokens: list[str]) -> np.ndarray:
        flat, at = grams(tokens)
        return self.p["word"][buckets(tokens)] + np.add.reduceat(self.p["gram"][flat], at[:-1]) / np.diff(at)[:, None].astype(np.float32)

    def project(self, e: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.hstack([e @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"])

    def run(self, x: np.ndarray, ok: np.ndarray, keep: bool = False):
        """Logits of windows: x (SPAN, n, 6 * HIDDEN) projected words, ok (SPAN, n) where there is a word."""
        steps, n, H = x.shape[0], x.shape[1], HIDDEN
        hs = np.zeros((steps, n, 2 * H), np.float32)
        saved = {}
        for k, d in enumerate("fb"):
            U = self.p[f"U{d}"]
            h = np.zeros((n, H), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                xt = x[t, :, 3 * H * k : 3 * H * (k + 1)]
                zr = _sigmoid(xt[:, : 2 * H] + h @ U[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                g = np.tanh(xt[:, 2 * H :] + (r * h) @ U[:, 2 * H :])
                new = np.where(ok[t][:, None], h + z * (g - h), h)
                if keep:
                    saved[d, t] = (h, z, r, g)
                h = new
                hs[t, :, H * k : H * (k + 1)] = h
        att = np.where(ok, hs @ self.p["a"], -1e9)
        w = np.exp(att - att.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, hs)
        logit = pooled @ self.p["o"] + self.p["z"][0]
        return (logit, hs, w, pooled, saved) if keep else logit

    def gradients(self, x: np.ndarray, ok: np.ndarray, y: np.ndarray):
        """Gradients of the mean logistic loss, and that of ``x``."""
        H = HIDDEN
        logit, hs, w, pooled, saved = self.run(x, ok, keep=True)
        dl = (_sigmoid(logit) - y) / len(y)
        out = {"o": pooled.T @ dl, "z": np.array([dl.sum()])}
        dpool = dl[:, None] * self.p["o"]
        dw = np.einsum("nh,tnh->tn", dpool, hs)
        datt = w * (dw - (w * dw).sum(axis=0))
        out["a"] = np.einsum("tn,tnh->h", datt, hs)
        dhs = w[:, :, None] * dpool[None] + datt[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U = self.p[f"U{d}"]
            dU = np.zeros_like(U)
            carry = np.zeros((x.shape[1], H), np.float32)
            steps = range(len(x) - 1, -1, -1) if d == "f" else range(len(x))
            for t in steps:
                h, z, r, g = saved[d, t]
                dh = dhs[t, :, H * k : H * (k + 1)] + carry
                on = ok[t][:, None]
                dz, dg = np.where(on, dh * (g - h) * z * (1 - z), 0), np.where(on, dh * z * (1 - g * g), 0)
                drh = dg @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                zr = np.hstack([dz, dr])
                dU[:, : 2 * H] += h.T @ zr
                dU[:, 2 * H :] += (r * h).T @ dg
                carry = np.where(on, dh * (1 - z), dh) + drh * r + zr @ U[:, : 2 * H].T
                dx[t, :, 3 * H * k : 3 * H * (k + 1)] = np.hstack([zr, dg])
            out[f"U{d}"] = dU
        return out, dx, logit


def _windows(lengths: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of every window, for texts of these lengths in one row of words."""
    doc, start, at = [], [], 0
    for k, n in enumerate(lengths.tolist()):
        s = windows(n)
        doc += [k] * len(s)
        start += [at + x for x in s]
        at += n
    return np.array(doc, np.int64), np.array(start, np.int64)


def _fill(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions (SPAN, n) of windows and which are inside their text."""
    at = start[None, :] + np.arange(SPAN)[:, None]
    ok = at < end[None, :]
    return np.where(ok, at, 0), ok


class Scorer:
    """Scores whole texts, with a bounded cache of projected words."""

    def __init__(self, net: Network):
        self.net, self.known, self.rows = net, {}, None

    def tops(self, each: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text its highest window logit (-inf without one), how many windows it has, and where the highest starts."""
        if self.rows is None or len(self.known) > WORDS_CACHED:
            self.known, self.rows = {}, np.zeros((0, 6 * HIDDEN), np.float32)
        fresh = sorted({w for ws in each for w in ws} - self.known.keys())
        if fresh:
            self.known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, *[self.net.project(self.net.embed(fresh[k : k + 20_000])) for k in range(0, len(fresh), 20_000)]]).astype(np.float32)
        lengths = np.array([len(ws) for ws in each], np.int64)
        ends = np.cumsum(lengths)
        ids = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(each)), np.int64, int(lengths.sum()))
        doc, start = _windows(lengths)
        logit = np.empty(len(doc), np.float32)
        for k in range(0, len(doc), GROUP):
            at, ok = _fill(start[k : k + GROUP], ends[doc[k : k + GROUP]])
            logit[k : k + GROUP] = self.net.run(self.rows[ids[at]], ok)
        top = np.full(len(each), -np.inf)
        np.maximum.at(top, doc, logit)
        where = np.zeros(len(each), np.int64)
        best = logit == top[doc]
        where[doc[best]] = start[best] - (ends - lengths)[doc[best]]
        return top, np.bincount(doc, minlength=len(each)), where

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        top, n, _ = self.tops([words(t) for t in texts])
        return _calibrated(self.net.calibration, top, n)


def _calibrated(c: tuple[float, float, float], top: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = c[0] + c[1] * np.where(n > 0, top, -20.0) + c[2] * np.log1p(n)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def learn(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Train on whole documents with labels ``y``."""
    if not len(y) or len(set(y.tolist())) < 2:
        net = Network(seed)
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    back = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1  # kept back from the network, to calibrate its scores
    if min(y[back].sum(), (1 - y[back]).sum()) < 5:
        back = np.zeros(len(y), bool)
    net = _fit([t for t, b in zip(texts, back, strict=True) if not b], y[~back], epochs, seed)
    held = [words(t) for t, b in zip(texts, back, strict=True) if b or not back.any()]
    scorer = Scorer(net)
    got = [scorer.tops(held[k : k + 200]) for k in range(0, len(held), 200)]
    top, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    net.calibration = _platt(np.where(n > 0, top, -20.0), np.log1p(n), y[back] if back.any() else y)
    return net


def _fit(texts: list[str], y: np.ndarray, epochs: int, seed: int) -> Network:
    net = Network(seed)
    r = np.random.default_rng(seed)
    each = [words(t) for t in texts]
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in each for w in ws}))}
    tokens = list(vocabulary)
    ids = [np.array([vocabulary[w] for w in ws], np.int64) for ws in each]
    flat, gram_at = grams(tokens)
    # Log-odds of an n-gram by documents that have it, shrunk where those are few; a document counts once.
    hits, seen = np.full((2, GRAM_BUCKETS), 0.5), np.zeros(WORD_BUCKETS, np.int64)
    for doc, label in zip(ids, y.astype(int), strict=True):
        if len(doc):
            hits[label, np.unique(np.concatenate([flat[gram_at[k] : gram_at[k + 1]] for k in np.unique(doc)]))] += 1
    share = hits / np.array([[(y == 0).sum() + 1.0], [(y > 0).sum() + 1.0]])
    odds = np.clip(np.log(share[1] / share[0]), -4, 4) * (hits.sum(axis=0) - 1) / (hits.sum(axis=0) + 3)
    net.p["gram"][:, 0] = odds * ODDS
    word_at = buckets(tokens)
    for doc in ids:
        seen[np.unique(word_at[doc])] += 1
    # What occurs in hardly any training document only fits noise: it stays without weight.
    word_on, gram_on = seen >= LEAST_DOCS, hits.sum(axis=0) - 1 >= LEAST_DOCS
    net.p["gram"] *= gram_on[:, None]
    worth = np.add.reduceat(odds[flat], gram_at[:-1]) / np.diff(gram_at)
    pos, neg = np.nonzero(y > 0)[0], np.nonzero(y == 0)[0]
    scorer, moment, second, step = None, {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    epochs = min(80, max(epochs, -(-LEAST_STEPS * BATCH // max(1, 3 * len(neg)))))
    for epoch in range(epochs):
        if epoch < epochs // 2:
            chosen = []
            for doc in ids:
                s = windows(len(doc))
                best = [worth[doc[x : x + SPAN]].max() for x in s]
                chosen.append(s[int(np.argmax(best))] if s else 0)
        else:
            scorer = Scorer(net)
            chosen = np.concatenate([scorer.tops(each[k : k + 200])[2] for k in range(0, len(each), 200)]).tolist()
        cases = [(k, chosen[k]) for k in [*np.repeat(pos, max(1, round(len(neg) / max(1, len(pos)) / 3))), *neg] if len(ids[k])]
        cases += [(k, int(r.choice(windows(len(ids[k]))))) for k in neg if len(ids[k])]
        r.shuffle(cases)
        for b in range(0, len(cases), BATCH):
            some = cases[b : b + BATCH]
            rows = np.zeros((SPAN, len(some)), np.int64)
            ok = np.zeros((SPAN, len(some)), bool)
            for j, (k, s) in enumerate(some):
                part = ids[k][s : s + SPAN]
                rows[: len(part), j], ok[: len(part), j] = part, True
            used, back = np.unique(rows, return_inverse=True)
            back = back.reshape(rows.shape)
            span = np.concatenate([np.arange(gram_at[w], gram_at[w + 1]) for w in used])
            sizes = np.diff(gram_at)[used]
            e = net.p["word"][word_at[used]] + np.add.reduceat(net.p["gram"][flat[span]], np.cumsum([0, *sizes])[:-1]) / sizes[:, None]
            kept = (r.random(rows.shape) >= DROP)[:, :, None]
            x = np.where(kept, net.project(e)[back], np.hstack([net.p["cf"], net.p["cb"]])).astype(np.float32)
            grad, dx, _ = net.gradients(x, ok, y[[k for k, _ in some]].astype(np.float32))
            dp, use = np.zeros((len(used), 6 * HIDDEN), np.float32), ok & kept[:, :, 0]
            np.add.at(dp, back[use], dx[use])
            de = np.zeros_like(e)
            for k, d in enumerate("fb"):
                own = dp[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
                grad[f"W{d}"], grad[f"c{d}"] = e.T @ own, dx[ok][:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)].sum(axis=0)
                de += own @ net.p[f"W{d}"].T
            step += 1
            for name, g in grad.items():
                moment[name] = 0.9 * moment[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.p[name] -= (RATE * (moment[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            np.add.at(net.p["word"], word_at[used], (-RATE * EMBED_RATE * de * word_on[word_at[used], None]).astype(np.float32))
            np.add.at(net.p["gram"], flat[span], (-RATE * EMBED_RATE * np.repeat(de / sizes[:, None], sizes, axis=0) * gram_on[flat[span], None]).astype(np.float32))
    return net


def _platt(top: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the top logit and the log number of windows, by damped Newton steps with a ridge."""
    mid, spread = top.mean(), top.std() + 1e-6
    x = np.stack([np.ones_like(top), (top - mid) / spread, size - size.mean()], axis=1)
    pull = np.diag([0.01, 0.1, 1.0])
    w = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        f = x @ w
        return float((np.logaddexp(0, f) - y * f).sum() + 0.5 * w @ pull @ w)

    for _ in range(50):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return float(w[0] - w[1] * mid / spread - w[2] * size.mean()), float(max(w[1], 1e-3) / spread), float(w[2])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 13) -> Network:
    """Learn ``label`` (0 or 1, beside ``doc_id`` in ``labels``) from the texts of ``docs``."""
    got = labelled_sample(docs, labels, label, max_rows, seed).filter("text is not null").toArrow()
    rows = sorted(zip(got["text"].to_pylist(), got["y"].to_pylist(), strict=True))  # however the cluster ordered them
    return learn([t for t, _ in rows], np.array([float(v > 0) for _, v in rows]))


def score(docs: DataFrame, net: Network, held_out: Column, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for at in range(0, len(batch), 250):
                b = batch.slice(at, 250)
                p = scorer(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return in_batches(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
