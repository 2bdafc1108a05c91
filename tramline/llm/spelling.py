"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under their commonest form.

Pivotal grams.  Each word's bigrams are ordered by how many words have them, the rarest first.  Its prefix is the first three
of that order, with all places of the last one; two disjoint bigrams of the prefix, the pair of least weight by dynamic programming, are its pivots.
One edit leaves one pivot whole.  If the word's prefix ends no later in the order than the other's, that pivot is also in the
other's prefix; else the same holds the other way round.  So pivots meet prefixes, and nothing else is compared.

Position limits.  The edit lies on one side of the whole bigram, so on the other side nothing changed: its distance from that end
of the word is the same, and so is every letter up to there.  The index therefore has two keys for a bigram, the word's start
up to it and the word's end from it on, and words are compared only under an equal key.

What is found is verified by the edit distance.  Forms lead to words at least five times as frequent, so following them takes
a number of steps that grows with the logarithm of the largest count; pointers are doubled.

Defined results: null texts have no words; a null id counts as empty; repeated rows count again; of equally frequent forms the smallest word
in code-point order is taken; very long texts are read whole; an empty table gives an empty result.  Columns beyond ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import in_batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SLIP = 199  # one run in so many loses a letter
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
HELD_WORDS = 100_000
PREFIX = 3  # bigrams that one edit can touch, and one more
GRAMS_BOUND = 20_000  # 90 letters have 8,100 bigrams


def words_of(doc_id, text: str) -> Counter:
    """Words of one text and their counts, slips included."""
    out = Counter()
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        low = run.lower() if run.isascii() else run.translate(LOWER)
        h = zlib.crc32(low.encode(), before)
        if h % SLIP == 0:
            k = h % len(low)
            low = low[:k] + low[k + 1 :]
        if len(low) >= MIN_LETTERS:
            out[low] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    for word, n in words_of(doc_id, text.as_py()).items():
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield batch_of()
                    held = Counter()
        yield batch_of()

    counted = in_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def pivotal(word: str, weight: dict[str, int]) -> tuple[list[int], list[int], tuple[int, str]]:
    """Where the prefix's bigrams and the two pivots stand in a word, and the place of the prefix's end in the order of bigrams."""
    order = sorted((weight[word[p : p + 2]], word[p : p + 2], p) for p in range(len(word) - 1))
    end = order[PREFIX - 1][:2]
    prefix = sorted(p for w, g, p in order if (w, g) <= end)
    # Best pair of disjoint places: for each place, the lightest one that ends before it.
    best, lightest, behind = None, None, 0
    for p in prefix:
        while behind < len(prefix) and prefix[behind] + 2 <= p:
            own = weight[word[prefix[behind] : prefix[behind] + 2]], prefix[behind]
            lightest = own if lightest is None else min(lightest, own)
            behind += 1
        if lightest is not None:
            pair = lightest[0] + weight[word[p : p + 2]], lightest[1], p
            best = pair if best is None else min(best, pair)
    return prefix, [best[1], best[2]], end


def index(words: DataFrame, weight: dict[str, int]) -> DataFrame:
    """``key, pivot, word, n, size, end``: a row for each side of each bigram of the prefix, marked if the bigram is a pivot."""
    held = words.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {g: k for k, (g, _) in enumerate(sorted(held.value.items(), key=lambda x: (x[1], x[0])))}
        for batch in batches:
            key, pivot, word, n, size, end = [], [], [], [], [], []
            for w, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix, pivots, last = pivotal(w, held.value)
                for p in prefix:
                    key += ["^" + w[: p + 2], w[p:] + "$"]
                    pivot += [p in pivots] * 2
                k = 2 * len(prefix)
                word += [w] * k
                n += [count] * k
                size += [len(w)] * k
                end += [place[last[1]]] * k
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((key, pa.string()), (pivot, pa.bool_()), (word, pa.string()), (n, pa.int64()), (size, pa.int32()), (end, pa.int32()))], names=["key", "pivot", "word", "n", "size", "end"])

    return in_batches(words, run, "key string, pivot boolean, word string, n long, size int, end int")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: both directions of every pair of words one edit apart."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.substr("word", p, F.lit(2)))).alias("gram"))
    counts = grams.groupBy("gram").count().limit(GRAMS_BOUND + 1).collect()
    if len(counts) > GRAMS_BOUND:
        raise ValueError("more bigrams than two letters of the alphabet can make")
    keys = stored(index(words, {r["gram"]: r["count"] for r in counts}), "grams")
    a = keys.filter("pivot").select("key", *[F.col(c).alias(f"a_{c}") for c in ("word", "n", "size", "end")])
    b = keys.select("key", *[F.col(c).alias(f"b_{c}") for c in ("word", "n", "size", "end")])
    met = a.join(b, "key").filter("a_end <= b_end and a_word <> b_word and abs(a_size - b_size) <= 1 and levenshtein(a_word, b_word, 1) = 1")
    one = F.col("a_word") < F.col("b_word")
    pairs = met.select(*[F.when(one, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("word", "n")]).distinct()
    sides = F.inline(F.array(*[F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")]))
    return pairs.select(sides)


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = stored(word_counts(docs), "words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = words.join(near, "word", "left")
    often = -F.col("best.less") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    found = stored(found, "forms")
    up = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    out = found.join(up.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
