"""Language identification by interpolated Kneser-Ney character models.

Per language, words (runs of letters, lower-cased, with a mark at either end) train a character model of ``ORDER`` characters
with absolute discounting: the highest order counts occurrences, the lower ones count distinct left contexts.  The models of
up to ``GROUP`` languages share sorted arrays of n-gram hashes; beside each hash stands one row of log-probabilities, one per
language, already interpolated, and beside each context hash its row of back-off weights.  A text goes to the language of the
lowest cross-entropy per character; ``score`` is a softmax over the languages whose sharpness is calibrated on documents
kept back from the training ones, and ``rejected`` marks texts that the winner explains worse than nearly all of those.

Training takes at most about ``max_docs`` documents per language (a bounded, hashed sample, repeats left out); Spark counts their words, so that
what reaches the driver is bounded by the sample, and a model above ``MOST_BYTES`` is refused before it is sent out.  Scoring is one narrow pass over every text.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the first language in
order; repeated rows are scored alike; rows with a null language or id aren't learned from; with nothing to learn from
everything is ``und``; an empty table gives an empty result.  Columns beyond those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import in_batches, stored

ORDER, DISCOUNT = 4, 0.75
MAX_DOCS = 1500
WORDS_CACHED, ROWS_CACHED = 300_000, 4_800_000  # words, and words times languages
GROUP = 16
MOST_BYTES = 1 << 30  # of a model that is broadcast
LETTERS = re.compile(r"[^\W\d_]+")
SHARPNESS = (0.5, 1, 2, 4, 8, 16, 32, 64, 128)
REJECT_AT = 0.001  # share of correctly kept-back documents that may be rejected
START, END = "\x02", "\x03"


def words(text: str | None) -> list[str]:
    found = LETTERS.findall((text or "").lower())
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all marked words in a row, and where each word starts."""
    marked = [START + w + END for w in tokens]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([0, *map(len, marked)])


def _hashes(codes: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: hash of the n characters that end at each position, and whether they lie in one word."""
    inside = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        back = np.zeros(len(codes), np.uint64)
        back[n - 1 :] = codes[: len(codes) - n + 1]
        h = h * np.uint64(1) + (back + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, 2 * n - 1, 1 << 64))
        mixed = h ^ (h >> np.uint64(31))
        out.append((mixed * np.uint64(0xD6E8FEB86659FD93), inside >= n - 1))
    return out


class Model:
    """Log-probability rows of n-grams and log back-off rows of contexts, by sorted hash, for some languages at once.

    ``size`` is the number of different characters that the uniform distribution is over; without it, that of these languages.
    """

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER, discount: float = DISCOUNT, size: int | None = None):
        self.langs = sorted(counts)
        self.order = order
        per_lang = [self._train(counts[lang], discount) for lang in self.langs]
        size = alphabet(counts) if size is None else size
        self.grams, self.contexts = [], []
        lower = None
        for n in range(order):
            keys = np.unique(np.concatenate([p[n]["key"] for p in per_lang]))
            ctx = np.unique(np.concatenate([p[n]["context"] for p in per_lang]))
            own = np.zeros((len(keys), len(self.langs)))
            context = np.zeros(len(keys), np.uint64)
            tail = np.zeros(len(keys), np.uint64)
            backs = np.ones((len(ctx), len(self.langs)))
            for k, p in enumerate(per_lang):
                at = np.searchsorted(keys, p[n]["key"])
                own[at, k] = p[n]["p"]
                context[at], tail[at] = p[n]["of"], p[n]["tail"]
                backs[np.searchsorted(ctx, p[n]["context"]), k] = p[n]["back"]
            weight = backs[np.searchsorted(ctx, context)]
            if n == 0:
                base = np.full((len(keys), len(self.langs)), 1.0 / size)
            else:
                base = self._prob(lower, tail)
            own += weight * base
            lower = (keys, own)
            self.grams.append((keys, np.log(own).astype(np.float32)))
            self.contexts.append((ctx, np.log(backs).astype(np.float32)))
        self.floor = np.float32(np.log(1.0 / size))

    @staticmethod
    def _prob(lower: tuple[np.ndarray, np.ndarray], tail: np.ndarray) -> np.ndarray:
        keys, p = lower  # the tail of a seen n-gram has been seen as well
        return p[np.minimum(np.searchsorted(keys, tail), len(keys) - 1)]

    def _train(self, counts: dict[str, int], discount: float) -> list[dict[str, np.ndarray]]:
        tokens = sorted(counts)
        codes, starts = _codes(tokens)
        times = np.repeat(np.array([counts[w] for w in tokens], np.float64), np.diff(starts))
        hashed = _hashes(codes, starts, self.order)
        first = np.zeros(len(codes), bool)
        first[starts[:-1]] = True  # the start mark is never predicted
        out = []
        for n in range(1, self.order + 1):
            h, ok = hashed[n - 1]
            ok = ok & ~first
            if n < self.order:  # distinct left contexts; at a word's start, where there is none to the left, occurrences
                wider, fits = hashed[n]
                _, at = np.unique(wider[ok & fits], return_index=True)
                pick = np.nonzero(ok & fits)[0][at]
                edge = np.nonzero(ok & ~fits)[0]
                where, amount = np.concatenate([pick, edge]), np.concatenate([np.ones(len(pick)), times[edge]])
            else:
                # At the highest order, words shorter than it are covered by the lower ones.
                where = np.nonzero(ok)[0]
                amount = times[where]
            key, at, inverse = np.unique(h[where], return_index=True, return_inverse=True)
            total = np.bincount(inverse, amount, len(key))
            place = where[at]
            of = hashed[n - 2][0][place - 1] if n > 1 else np.zeros(len(place), np.uint64)
            tail = hashed[n - 2][0][place] if n > 1 else np.zeros(len(place), np.uint64)
            context, group = np.unique(of, return_inverse=True)
            mass = np.bincount(group, total, len(context))
            cut = np.minimum(total, discount)
            back = np.bincount(group, cut, len(context)) / mass
            out.append({"key": key, "p": (total - cut) / mass[group], "of": of, "tail": tail, "context": context, "back": back})
        return out

    def words(self, tokens: list[str]) -> np.ndarray:
        """Per word the summed log-probability of its characters and end mark, one column per language."""
        codes, starts = _codes(tokens)
        hashed = _hashes(codes, starts, self.order)
        inside = np.ones(len(codes), bool)
        inside[starts[:-1]] = False
        at = np.nonzero(inside)[0]
        total = np.zeros((len(codes), len(self.langs)), np.float32)
        left = at
        for n in range(self.order, 0, -1):
            h, ok = hashed[n - 1]
            fits = ok[left]
            rest, here = left[~fits], left[fits]
            if len(here):
                keys, rows = self.grams[n - 1]
                k = np.minimum(np.searchsorted(keys, h[here]), len(keys) - 1)
                hit = keys[k] == h[here]
                total[here[hit]] += rows[k[hit]]
                miss = here[~hit]
                ctx, back = self.contexts[n - 1]
                of = hashed[n - 2][0][miss - 1] if n > 1 else np.zeros(len(miss), np.uint64)
                c = np.minimum(np.searchsorted(ctx, of), len(ctx) - 1)
                known = ctx[c] == of
                total[miss[known]] += back[c[known]]
                rest = np.concatenate([rest, miss])
            left = rest
        total[left] += self.floor
        return np.add.reduceat(total, starts[:-1], axis=0)


def alphabet(counts: dict[str, dict[str, int]]) -> int:
    return len(set().union(*({c for w in own for c in w} for own in counts.values()))) + 2


class Models:
    """Models of ``GROUP`` languages each, in the languages' order.

    A row is as wide as its group, so that an n-gram of one language costs nothing in the other groups, and memory grows with the n-grams
    that there are instead of with their product with the languages.
    """

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs, size = sorted(counts), alphabet(counts)
        self.groups = [Model({lang: counts[lang] for lang in self.langs[k : k + GROUP]}, size=size) for k in range(0, len(self.langs), GROUP)]

    def words(self, tokens: list[str]) -> np.ndarray:
        return np.concatenate([m.words(tokens) for m in self.groups], axis=1)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for m in self.groups for part in (m.grams, m.contexts) for pair in part for a in pair)


class Scorer:
    """Mean log-probability per character of whole texts, with a bounded cache of word scores."""

    def __init__(self, model: Models):
        self.model, self.known, self.rows, self.sizes = model, {}, None, None

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        if self.rows is None or len(self.known) > min(WORDS_CACHED, ROWS_CACHED // len(self.model.langs)):
            self.known, self.rows, self.sizes = {}, np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64)
        each = [words(t) for t in texts]
        fresh = list({w for ws in each for w in ws} - self.known.keys())
        if fresh:
            self.known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, *[self.model.words(fresh[k : k + 20_000]) for k in range(0, len(fresh), 20_000)]])
            self.sizes = np.concatenate([self.sizes, np.array([len(w) + 1 for w in fresh])])
        for ws in each:
            if not ws:
                yield None
                continue
            at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
            yield self.rows[at].sum(axis=0, dtype=np.float64) / self.sizes[at].sum()


class Identifier:
    """A model with its calibration: ``sharpness`` of the softmax and, per language, the lowest accepted log-probability."""

    def __init__(self, model: Models, sharpness: float, lowest: dict[str, float]):
        self.model, self.sharpness, self.lowest = model, sharpness, lowest

    def __call__(self, scorer: Scorer, texts: list[str | None]) -> Iterator[tuple[str, float, bool, float | None]]:
        for row in scorer(texts):
            if row is None:
                yield "und", 0.0, True, None
                continue
            k = int(row.argmax())
            lang = self.model.langs[k]
            p = 1.0 / np.exp(self.sharpness * (row - row[k])).sum()
            yield lang, float(p), bool(row[k] < self.lowest.get(lang, -np.inf)), float(-row[k])


def train(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = 11) -> Identifier | None:
    """Learn from ``text`` and non-null ``lang`` of ``docs``; a tenth of the sample is kept back for calibration."""
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = F.least(F.lit(1.0), F.lit(max_docs) / F.col("count")).alias("share")
    sizes = stored(rows.groupBy("lang").count().select("lang", share), "languages")
    if sizes.isEmpty():
        return None
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(sizes, "lang").withColumn("_part", u / F.col("share")).filter("_part < 1").dropDuplicates(["lang", "text"])
    letters = F.lower("text")
    parts = rows.withColumn("_fit", F.col("_part") < 0.9)
    split = parts.filter("_fit").select("lang", F.explode(F.split(letters, r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    counts: dict[str, dict[str, int]] = {}
    for r in split.groupBy("lang", "w").count().toLocalIterator():
        counts.setdefault(r["lang"], {})[r["w"]] = r["count"]
    if not counts:
        return None
    model = Models(counts)
    if model.nbytes > MOST_BYTES:
        raise ValueError(f"a model of {model.nbytes >> 20} MB isn't broadcast; learn from fewer documents per language")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            got = [(lang, row.tolist()) for lang, row in zip(b.column(1).to_pylist(), scorer(b.column(0).to_pylist()), strict=True) if row is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["lang", "row"])

    back = in_batches(parts.filter("not _fit").select("text", "lang"), ask, "lang string, row array<double>").collect()
    return calibrate(model, [(r["lang"], np.array(r["row"])) for r in back])


def calibrate(model: Models, seen: list[tuple[str, np.ndarray]]) -> Identifier:
    known = [(model.langs.index(lang), row) for lang, row in seen if lang in model.langs]

    def loss(s: float) -> float:
        return sum(np.log(np.exp(s * (row - row.max())).sum()) - s * (row[k] - row.max()) for k, row in known)

    sharpness = min(SHARPNESS, key=loss) if known else SHARPNESS[2]
    lowest = {}
    for k, lang in enumerate(model.langs):
        own = np.sort([row[k] for y, row in known if y == k and row.argmax() == k])
        if len(own) >= 20:
            lowest[lang] = float(own[int(REJECT_AT * len(own))] - 3 * own.std())
    return Identifier(model, float(sharpness), lowest)


def identify(docs: DataFrame, identifier: Identifier | None, held_out: Column) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, cross_entropy`` for every row of ``docs``."""
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    if identifier is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    held = docs.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        scorer = Scorer(own.model)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.slice(at, 1000)
                got = [*zip(*own(scorer, b.column(1).to_pylist()), strict=True)]
                kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(g, k) for g, k in zip(got, kinds, strict=True)]], names=OUT)

    return in_batches(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double")


OUT = ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"]
