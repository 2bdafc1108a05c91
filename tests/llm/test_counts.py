"""Token counts, source divergence and spelling variants against the library, plain Python and all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tramline.llm import divergence, spelling, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_tokens long, word string, lang_total long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", None, "y") for r in rows], DOC)


# --- token counts --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(VOCABULARY)
    return lambda texts: [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(open(VOCABULARY, "rb").read())


PARTS = [*"abesr'tmdl1!-_ \n\t", "  ", "    ", "'s", "'re", "'ll", "don't", "é", "ß", "中文", "😀", "é", " ", "\x85", "\x1c", " ", "²", "Ⅷ", "٣", "the", "ing", " token", "<|endoftext|>", "<|endof", "\0", "aaaa", "zqx"]


def test_counts_are_those_of_the_library(machine, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(5000)]
    texts += ["".join(rng.choices("ab", k=400)) for _ in range(20)] + ["".join(chr(rng.randrange(1, 0xD800)) for _ in range(50)) for _ in range(200)]
    assert token_counts.count_texts(machine, iter(texts)) == library(texts)


def test_every_character_has_the_class_of_the_library(machine):
    """Each assigned character between letters and behind an apostrophe: its class decides where words start."""
    import unicodedata

    own = Tokenizer.from_file(VOCABULARY).pre_tokenizer
    points = [i for i in range(0x30000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]
    wrong = []
    for low in range(0, len(points), 2000):
        some = points[low : low + 2000]
        text = "".join(f"a{chr(i)}a1" for i in some)
        points_of = np.array([ord(c) for c in text], np.uint32)
        edge = np.zeros(len(text), bool)
        first, last = edge.copy(), edge.copy()
        first[0], last[-1] = True, True
        got = np.nonzero(token_counts.starts(points_of, first, last))[0].tolist()
        want = [span[0] for _, span in own.pre_tokenize_str(text)]
        wrong += [x for x in set(got) ^ set(want)]
    assert not wrong


@pytest.mark.parametrize("chunk,piece", [(3, 16), (7, 9), (1024, 40)])
def test_chunks_and_pieces_compose(machine, library, monkeypatch, chunk, piece):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "PIECE", piece)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 200)
    rng = random.Random(chunk)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(120))) for _ in range(150)] + ["a" * 300, " " * 90 + "b", "'" * 80, "x's" * 60]
    assert token_counts.count_texts(machine, iter(texts)) == library(texts)


def test_states_are_dropped_and_compiled_again(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    own = token_counts.Transducer(open(VOCABULARY, "rb").read())
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=60)) for _ in range(60)] + ["abcdefghijklmnopqrstuvwxyz" * 20]
    assert token_counts.count_texts(own, iter(texts)) == library(texts)
    assert len(own.states) < 3000


def test_count_tokens_on_edge_rows(spark, library):
    texts = [None, "", " ", "a b c", "a b c", "<|endoftext|>", "x" * 400_000, "word " * 2000, "é中😀"]
    rows = [(k if k else None, t, None, None) for k, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, rows).repartition(3)).collect()}
    for (k, t, *_), n in zip(rows, library(texts), strict=True):
        assert (out[k]["n_bytes"], out[k]["n_tokens"], out[k]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


# --- source divergence ---------------------------------------------------------------------------------------------------


def plain_divergence(rows, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -f, k) for k, (f, _, o) in enumerate(pairs, 1)}
            tops = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:50]
            out |= {(lang, s, "term", t, -f, k) for k, (f, _, t) in enumerate(tops, 1)}
    return out


@pytest.mark.parametrize("shard", [4, 256])
def test_divergence_matches_plain_counts(spark, monkeypatch, shard):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    rng = random.Random(3)
    words = [a + b for a in "abcdefghij" for b in "klmnopqrstuvwxyzabcd"] + ["Ab", "É", "é", "ıI", "a_b", "x1y"]
    rows = [(k, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "é", None])) for k in range(300)]
    rows += [(900, None, "fr", "only"), (901, "", "fr", "two"), (None, "rare words", "it", "s1"), (902, "ak " * 50_000, "en", "s2"), (902, "ak ak", "en", "s2")]
    got = divergence.source_divergence(frame(spark, rows), min_docs=8).select("lang", "source", "part", "item", "value", "rank").collect()
    want = plain_divergence(rows, 8)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r["part"] == "term" and r["rank"] == 50 for r in got)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts():
    total = np.array([3, 10**12 + 7, 8 * 10**15 + 1])
    count = np.array([1, 999_999_999_999, 8 * 10**15])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_no_cross_join_in_divergence(spark):
    plan = divergence.source_divergence(frame(spark, [(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# --- spelling variants ---------------------------------------------------------------------------------------------------


def plain_words(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [o for o in n if one_apart(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o)) if others else None
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_match_all_pairs(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcé", k=rng.randrange(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "abababa", "Abstract", "ÀÀÀÀÀÀ", "àààààà", "a×b÷cde"]
    words = set(stems)
    for w in stems:
        for _ in range(6):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]]))
    counts = {w: 5 ** rng.randrange(1, 6) for w in sorted(words)}
    rows = [(k, " ".join([w] * min(n - at, 500)), "en", "s") for k, (w, n) in enumerate(counts.items()) for at in range(0, n, 500)]
    rows += [(None, None, None, None), (1, "", "en", "s"), (2, "short 1234567 abcde-abcde", None, "s"), (None, "repeated " * 7, "en", "s"), (None, "repeated " * 7, "en", "s")]
    want = plain_variants(rows)
    got = spelling.variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    forms = {w: f for w, f, *_ in want}
    assert any(f and forms[f] for f in forms.values()), "chains of forms are tested"


def test_slips_drop_one_letter():
    n = spelling.words_of(7, " ".join(f"{a}{b}{c}word" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"))
    assert any(len(w) == 6 for w in n) and all(len(w) in (6, 7) for w in n)


def test_pivots_are_disjoint_and_light():
    rng = random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choices("abc", k=rng.randrange(6, 12)))
        weight = defaultdict(lambda: 1, {a + b: rng.randrange(1, 9) for a in "abc" for b in "abc"})
        prefix, pivots, _ = spelling.pivotal(word, weight)
        own = lambda p, word=word, weight=weight: weight[word[p : p + 2]]
        best = min(own(p) + own(q) for p in prefix for q in prefix if q >= p + 2)
        assert pivots[1] - pivots[0] >= 2 and set(pivots) <= set(prefix) and own(pivots[0]) + own(pivots[1]) == best


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
