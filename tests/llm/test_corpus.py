"""Near-duplicates, decontamination, rules, mixing, shards and the pipeline against plain versions."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import decontaminate, mixing, near_dup, quality_rules, shards
from tramline.llm.common import table

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, start=0):
    rows = [(k + start, t, "en", f"s{k % 3}", None if t is None else len(t), None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


EDGE = [None, "", " \t\n", "one", "two words", "a b c", "a b c", "A B c", "x " * 60_000]


# --- near-duplicates -----------------------------------------------------------------------------------------------------


def plain_dups(rows, words, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = list(EDGE)
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    want = plain_dups(list(enumerate(texts)), words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, texts), words, percent).collect()}
    assert got == want


def test_open_cases_go_through_blocks(spark, monkeypatch):
    """A large group whose links mostly miss the hub, cut into small blocks, equals the comparison of all pairs."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(300)]
    texts = []
    for k in range(70):
        t = list(base)
        for _ in range(rng.randint(1, 9)):
            t[rng.randrange(300)] = f"n{k}{rng.random()}"
        texts.append(" ".join(t))
    want = {k: v[1] for k, v in plain_dups(list(enumerate(texts)), 3, 85).items()}
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert got == want and 1 < len(set(want.values())) < 70


def test_repeated_and_null_ids(spark):
    rows = [(5, "p q r s t"), (5, "totally other words in here"), (None, "p q r s t"), (9, "totally other words in here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df, 3, 85).collect())
    assert got == Counter({(5, 5): 2, (None, 5): 1, (9, 5): 1, (None, None): 1})
    assert near_dup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_texts_are_fetched_by_row(spark, monkeypatch):
    # All rows without an id, each text three times: one set for each class that has a candidate, from its own texts only.
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[:39] + [f"x{k}"]) for k in range(12)] * 3
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(8)
    seen, asked = {}, []
    real_stored, real_batches = near_dup.stored, near_dup.in_batches

    def batches(d, run, schema):
        asked.append(d)
        return real_batches(d, run, schema)

    def keep(d, label):
        seen[label] = real_stored(d, label)
        return seen[label]

    monkeypatch.setattr(near_dup, "in_batches", batches)
    monkeypatch.setattr(near_dup, "stored", keep)
    got = near_dup.near_duplicates(df, 3, 85).collect()
    assert len(got) == 36 and all(r["component_id"] is None for r in got)
    assert asked[1].count() == 36 and seen["sets"].count() == 12


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 1 << 63, 100).astype(np.uint64)])
    same = (near_dup.signature(a, 2000) == near_dup.signature(b, 2000)).mean()
    assert abs(same - 300 / 500) < 0.05


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["root"] for r in near_dup.components(edges).collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 43


# --- decontamination -----------------------------------------------------------------------------------------------------


def plain_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, named = set(), set()
    for name, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        k = min(window, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                named.add(str(name))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_decontamination_against_windows(spark, block_words):
    rng = random.Random(2)
    vocabulary = ["Ab", "c", "dé", "e1", "f", "g"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(k, make(rng.choice([1, 2, 3, 5, 8, 12]))) for k in range(12)] + [(50, None), (51, "..."), (50, "c c c c c"), (2, "f f f f")]
    texts = EDGE + [make(rng.randint(0, 80)) for _ in range(150)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(frame(spark, texts), bench, 5, block_words).select("doc_id", "_hits.*").collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, named = plain_hits(texts[r["doc_id"]], items, 5)
        assert (r["n_words"], sum(b - a for a, b in r["spans"]), r["items"]) == (n, hit, named)


def test_one_block_at_a_time(spark, monkeypatch):
    # One id holds all the text: its rows still go to several blocks, and none is collected before the last one's pass is stored.
    items = [(1, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(12)]
    texts = [f"{t} tail" for _, t in items] + ["clean words only"]
    steps, real_words, real_stored = [], decontaminate.words, decontaminate.stored
    monkeypatch.setattr(decontaminate, "words", lambda t: (steps.append("item"), real_words(t))[1])
    monkeypatch.setattr(decontaminate, "stored", lambda d, label: (steps.append("stored"), real_stored(d, label))[1])
    out = decontaminate.scan(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), 10, 60)
    runs = "".join(s[0] for s in steps).split("s")
    assert len(runs) > 4 and sum(map(len, runs)) == 12 and max(map(len, runs)) < 8
    got = {r["doc_id"]: r["_hits"] for r in out.collect()}
    assert all(sum(b - a for a, b in got[k]["spans"]) == 12 and got[k]["items"] == ["1"] for k in range(12)) and not got[12]["items"]


def test_long_items_are_split_without_losing_a_window():
    rng = random.Random(4)
    for n in (0, 1, 9, 10, 11, 39, 40, 41, 71, 72, 400):
        ws = [f"{rng.choice('abc')}" for _ in range(n)]
        some = [p.split() for p in decontaminate.pieces(", ".join(ws).upper(), 40, 10)]
        grams = lambda w: {tuple(w[k : k + min(10, n)]) for k in range(len(w) - min(10, n) + 1)}
        assert set().union(*map(grams, some)) == grams(ws) and all(len(p) <= 40 for p in some)
        assert n < 10 or all(len(p) >= 10 for p in some)


def test_many_blocks_hand_the_documents_on_once(spark, monkeypatch):
    # Items longer than a block, one text in a third of the rows, clashing names; blocks store nothing but hits.
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))) for k, n in enumerate([900, 700, 30, 12, 3, 10])]
    texts = [" ".join([*(f"x{k}" for k in range(5)), *items[j][1].split()[i : i + n], "end"]) for j in range(6) for i, n in ((0, 9), (0, 10), (5, 25), (36, 60), (300, 500))]
    texts += [items[0][1]] * 20 + [None, "", "w1"]
    docs = frame(spark, texts).withColumn("_hits", F.lit("mine")).withColumn("_key", F.lit(1)).withColumn("a.b", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept, real = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda d, label: (kept.append((label, d.columns)), real(d, label))[1])
    got = decontaminate.scan(docs, bench, 10, 100)
    assert got.columns == [*docs.columns, "__hits"] and sum(k == "hits" for k, _ in kept) > 5
    assert all("text" not in columns for label, columns in kept if label != "benchmark")
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, named = plain_hits(texts[r["doc_id"]], items, 10)
        assert (r["__hits"]["n_words"], sum(b - a for a, b in r["__hits"]["spans"]), r["__hits"]["items"]) == (n, hit, named)
        assert (r["_hits"], r["_key"], r["a.b"]) == ("mine", 1, 2)
    assert decontaminate.remove(docs, bench).columns == docs.columns


def test_removal(spark):
    item = "the quick brown fox jumps over the lazy dog today"
    filler = " ".join(f"clean{k}" for k in range(40))
    texts = [f"{filler} The QUICK, brown fox jumps over the lazy dog today! {filler}", item + " x", filler, None, ""]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.remove(frame(spark, texts), bench).collect()}
    assert set(got) == {0, 2, 3, 4} and got[2]["text"] == filler and got[3]["text"] is None
    assert got[0]["text"] == f"{filler} ! {filler}" and got[0]["n_chars"] == len(got[0]["text"])
    assert decontaminate.remove(frame(spark, texts), bench.limit(0)).count() == 5
    assert decontaminate.remove(frame(spark, []), bench).count() == 0


def test_runs_below_the_length_limit_stay(spark):
    item = [f"i{k}" for k in range(40)]
    filler = [f"clean{k}" for k in range(90)]
    docs = frame(spark, [" ".join(filler[:45] + item[3 : 3 + n] + filler[45:]) for n in (9, 10, 11, 12, 30)] + [" ".join([*filler, "i1", "i2"])])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "i1 i2")], "item_id long, text string")
    cut = lambda m: {r["doc_id"]: 92 - (r["doc_id"] < 5) * 2 - len(r["text"].split()) for r in decontaminate.remove(docs, bench, min_span=m).collect()}
    assert cut(10) == {0: -9, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2}
    assert cut(12) == {0: -9, 1: -10, 2: -11, 3: 0, 4: 0, 5: 2}  # the short item goes, whatever the limit


def test_hits_beside_a_clashing_column(spark):
    docs = frame(spark, ["a b c d e f g h i j k"]).withColumn("_hits", F.lit("mine")).withColumn("_Kept", F.lit(1))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = decontaminate.scan(docs, bench).first()
    assert got["_hits"] == "mine" and got["__hits"]["items"] == ["1"]
    assert decontaminate.remove(docs, bench, max_coverage=1.0).select("_hits", "text").collect() == [("mine", " k")]


def test_scan_does_not_depend_on_the_item_length():
    steps = []
    for n in (200, 3200):
        m = decontaminate.Automaton([("1", [b"w"] * n)], 10)

        class Counted:
            def __init__(self, of):
                self.of, self.n = of, 0

            def __getitem__(self, k):
                self.n += 1
                return self.of[k]

        m.link, m.end_up, m.window_of = Counted(m.link), Counted(m.end_up), Counted(m.window_of)
        m.scan([b"w"] * 5000)
        steps.append(m.link.n + m.end_up.n + m.window_of.n)
    assert steps[0] <= 3 * 5000 and steps[1] <= 3 * 5000


# --- quality rules -------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    repeated = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_measures_against_plain_version(spark):
    rng = random.Random(4)
    bits = ["a", "bé", "#c", "D|", "\n", "\n\n", "\t", " ", "\x0b", "😀", "e.", "a b c d e f "]
    texts = EDGE + ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    for r in quality_rules.measure(frame(spark, texts)).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain_measures(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_votes_find_the_trustworthy_rules():
    """With a latent class and rules of known accuracy, EM recovers which class most documents have."""
    rng = random.Random(6)
    accuracy, truth, patterns = [0.95, 0.9, 0.6, 0.8, 0.9, 0.7, 0.85], [], []
    for _ in range(4000):
        good = rng.random() < 0.85
        truth.append(good)
        patterns.append("".join("-" if rng.random() < 0.2 else ("g" if (rng.random() < a) == good else "b") for a in accuracy))
    prior, tables = quality_rules.fit(Counter(patterns))
    right = sum((quality_rules.posterior(p, prior, tables) >= 0.5) == t for p, t in zip(patterns, truth, strict=True))
    assert right / len(truth) > 0.95 and abs(prior - 0.85) < 0.05


def plain_kept(texts):
    """The verdicts by another way: rules on plain counts, EM over documents one by one in numpy."""
    rows = []
    for text in map(lambda t: t or "", texts):
        n, chars, symbols, dups, repeats = plain_measures(text)
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
        upper, stops, short = len(re.findall("[A-Z]", text)), sum(text.count(c) for c in ".!?;,"), sum(2 <= len(x) <= 3 for x in w)
        bad = [symbols / max(n, 1) > 0.1, repeats * 20 > 3 * n, dups * 4 > lines, chars > 12 * n or chars < 2 * n, upper * 3 > chars, stops * 100 < n and n >= 50, len(set(w)) * 5 < n, short * 20 < n]
        good = [symbols * 50 <= n, repeats * 50 <= n, dups == 0 and lines > 1, 3 * n <= chars <= 7 * n, 0 < upper * 10 <= chars, stops * 40 >= n, len(set(w)) * 10 >= 4 * n, short * 10 >= n]
        rows.append(([0 if b else 1 if g else 2 for b, g in zip(bad, good, strict=True)], n < 10 or 100 * repeats > 20 * n))
    votes, failed = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    fit, k = votes[~failed], votes.shape[1]
    start = np.array([[0.5, 0.2, 0.3], [0.05, 0.7, 0.25]])  # junk, fine: P(bad, good, abstain)
    tables, prior = np.tile(start, (k, 1, 1)), 0.8

    def posterior(v):
        log = [np.log(tables[np.arange(k), c, v]).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(log[0] - log[1]) * (1 - prior) / prior)

    for _ in range(40):
        p = posterior(fit)
        prior = (p.sum() + 4) / (len(p) + 5)
        counts = np.array([[[(weight * (fit[:, j] == v)).sum() for v in range(3)] for weight in (1 - p, p)] for j in range(k)]) + 5 * start
        tables = counts / counts.sum(axis=2, keepdims=True)
    return [bool(~f & (p >= 0.5)) for f, p in zip(failed, posterior(votes), strict=True)]


def test_verdict_against_a_plain_fit(spark):
    rng = random.Random(12)
    word = lambda a, b: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(a, b)))
    texts = list(EDGE)
    for k in range(260):
        ws = [word(2, 3) if rng.random() < 0.3 else word(4, 8) for _ in range(rng.randint(5, 90))]
        if k % 9 == 0:
            ws = [word(5, 9) + rng.choice(["%%%", "&&&", " |"]) for _ in ws]
        if k % 13 == 0:
            ws = ws[:8] * 6
        texts.append(". ".join(" ".join(ws[i : i + 12]).capitalize() for i in range(0, len(ws), 12)).replace(". ", rng.choice([". ", ".\n"])) + ".")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, texts)).collect()}
    want = dict(enumerate(plain_kept(texts)))
    assert got == want and 150 < sum(want.values()) < 260


def test_judge_edges(spark):
    good = " ".join(f"word{k % 37} and, then." for k in range(60))
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, [*EDGE, *[good + f" tail{k}" for k in range(30)]])).collect()}
    assert len(got) == len(EDGE) + 30 and not got[0]["kept"] and got[0]["base_failed"]
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_rules_use_no_python(spark):
    plan = quality_rules.measure(frame(spark, ["a"])).withColumn("v", quality_rules.votes())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- mixing --------------------------------------------------------------------------------------------------------------


def test_raking_meets_its_margins(spark):
    cells = {(s, lang, t): float(rng) for rng, (s, lang, t) in enumerate([(s, lang, t) for s in "abc" for lang in "xy" for t in "pqr"], 100)}
    targets = mixing.tempered(cells)
    p = mixing.rake(cells, targets, 0.6 * sum(cells.values()))
    total = sum(cells[c] * p[c] for c in cells)
    for d, target in enumerate(targets):
        for v, share in target.items():
            assert abs(sum(cells[c] * p[c] for c in cells if c[d] == v) / total - share) < 1e-4
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens double")
    again = {(r["source"], r["lang"], r["topic"]): r["p"] for r in mixing._rake_frames(df, mixing.MARGINS, 0.6 * sum(cells.values()), mixing.TEMPER, 6).collect()}
    assert max(abs(again[c] - p[c]) for c in cells) < 1e-3


def test_raking_is_the_same_beyond_the_driver(spark, monkeypatch):
    # Some cells are clipped, and the fit stops at another round than a fixed number.
    rng = random.Random(4)
    texts = ["w " * rng.choice([1, 3, 20, 150]) for _ in range(60)]
    df = frame(spark, texts).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 4)).withColumn("topic", F.concat(F.lit("t"), (F.col("doc_id") * 7 + F.col("doc_id") % 4) % 3))
    rows = lambda: {r["doc_id"]: (r["p"], r["selected"]) for r in mixing.probabilities(df, power=0.7, keep=0.8).collect()}
    monkeypatch.setattr(mixing, "CLOSE", 1e-3)
    want = rows()
    monkeypatch.setattr(mixing, "CELLS_ON_DRIVER", 0)
    got = rows()
    assert set(got) == set(want) and any(p == 1 for p, _ in want.values())
    assert max(abs(got[k][0] - want[k][0]) for k in want) < 1e-8
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def plain_topic(text):
    t = text or ""
    for name, yes in (("table", t.count("|") * 50 > len(t)), ("marked", sum(t.count(c) for c in "#*$%&!") * 20 > len(t)), ("legal", re.search("(?i)licen[cs]ed? ", t)), ("short", len(t) < 400), ("long", len(t) > 4000)):
        if yes:
            return name
    return "plain"


def plain_mix(rows, keep, power, seed, targets=None):
    """doc_id -> (tokens, p, selected) by raking and drawing document by document."""
    docs = [(k, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), (s, lang, plain_topic(t))) for k, t, lang, s in rows]
    total, due, factor = sum(n for _, n, _ in docs), [], []
    for d, margin in enumerate(("source", "lang", "topic")):
        given = (targets or {}).get(margin, {})
        have = defaultdict(int)
        for _, n, cell in docs:
            have[cell[d]] += n
        rest = sum(n**power for v, n in have.items() if v not in given)
        due.append({v: keep * total * (given[v] if v in given else (1 - sum(given.values())) * n**power / rest) for v, n in have.items()})
        factor.append(dict.fromkeys(have, 1.0))
    p = lambda cell: min(1.0, factor[0][cell[0]] * factor[1][cell[1]] * factor[2][cell[2]])
    for _ in range(500):
        off = 0.0
        for d in range(3):
            got = defaultdict(float)
            for _, n, cell in docs:
                got[cell[d]] += n * p(cell)
            for v in got:
                if got[v]:
                    off = max(off, abs(due[d][v] / got[v] - 1))
                    factor[d][v] = min(1e12, factor[d][v] * due[d][v] / got[v])
        if off < 1e-9:
            break
    u = lambda k: (xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest(str(k).encode(), 42)) % (1 << 53)) / (1 << 53)
    return {k: (n, p(cell), u(k) < p(cell)) for k, n, cell in docs}


@pytest.mark.parametrize("targets", [None, {"source": {"s0": 0.5}, "lang": {None: 0.2, "de": 0.3}}])
def test_mixing_against_a_plain_fit(spark, targets):
    rng = random.Random(21)
    texts = ["plain " * rng.randint(1, 300) + rng.choice(["", "| a | b " * 20, "licensed under ", "#$% " * 30]) for _ in range(150)] + ["", None]
    rows = [(k, t, rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice(["s0", "s1", "s1", "s2"])) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.probabilities(df, keep=0.5, targets=targets)
    want = plain_mix(rows, 0.5, 0.7, 7, targets)
    got = {r["doc_id"]: (r["n_tokens"], r["p"], r["selected"]) for r in found.collect()}
    assert set(got) == set(want)
    for k, (n, p, picked) in want.items():
        assert got[k][0] == n and abs(got[k][1] - p) < 1e-6 and got[k][2] == picked
    assert {r["doc_id"] for r in mixing.sample(df, keep=0.5, targets=targets).collect()} == {k for k, v in want.items() if v[2]}
    report = {(r["margin"], r["value"]): r for r in mixing.margin_report(found, targets=targets).collect()}
    total = sum(n * p for n, p, _ in want.values())
    for (margin, value), r in report.items():
        at = {"source": 3, "lang": 2}.get(margin)
        own = sum(want[row[0]][0] * want[row[0]][1] for row in rows if (plain_topic(row[1]) if at is None else row[at]) == value)
        assert abs(r["share"] - own / total) < 1e-6 and r["met"] == (abs(r["share"] - r["target"]) <= 1e-3)
    assert ("lang", None) in report
    if targets:
        assert abs(report["source", "s0"]["target"] - 0.5) < 1e-9 and abs(report["lang", "de"]["target"] - 0.3) < 1e-9


def test_targets_that_cannot_be_met(spark, monkeypatch):
    df = frame(spark, ["a b c"] * 9 + ["d " * 30] * 3).withColumn("lang", F.when(F.col("doc_id") < 9, "xx").otherwise("yy"))
    wish = {"lang": {"xx": 0.9}}
    for limit in (200_000, 0):
        monkeypatch.setattr(mixing, "CELLS_ON_DRIVER", limit)
        monkeypatch.setattr(mixing, "ROUNDS", 6)
        found = mixing.probabilities(df, ("lang",), keep=0.8, targets=wish)
        assert {round(r["p"], 3) for r in found.filter("lang = 'xx'").collect()} == {1.0}  # all there is
        report = {r["value"]: r["met"] for r in mixing.margin_report(found, ("lang",), targets=wish).collect()}
        assert report == {"xx": False, "yy": False}
        none = mixing.probabilities(df, ("lang",), targets={"lang": {"xx": 1.0}}).filter("lang = 'yy'").collect()
        assert all(r["p"] == 0 and r["weight"] is None and not r["selected"] for r in none) and len(none) == 3
    with pytest.raises(ValueError):
        mixing.probabilities(df, ("lang",), targets={"lang": {"xx": 1.2}})


def test_sampling_edges(spark):
    df = frame(spark, EDGE + ["plain text"] * 20).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = mixing.probabilities(df).collect()
    assert len(got) == len(EDGE) + 20 and all(0 < r["p"] <= 1 for r in got)
    picked = {r["doc_id"] for r in got if r["selected"]}
    kept = mixing.sample(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == picked
    assert mixing.sample(df.repartition(7)).count() == len(picked)
    assert mixing.probabilities(df.limit(0)).count() == 0


# --- shards --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    got = shards.permute(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    assert (got == shards.permute(np.arange(n), n, 5)).all()
    if n > 60:
        assert (got != shards.permute(np.arange(n), n, 6)).any() and (got != np.arange(n)).any()


def test_slots_are_evaluated_once(spark, tmp_path):
    """A filter on slots or shards reads what is computed already."""
    _, index = shards.materialise(frame(spark, ["a b c " * 40, "d e"]), length=4, shard_records=8, path=str(tmp_path / "s"))
    plan = index.filter("shard >= 1 and slot > 3")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("waves", [1, 3])
def test_shards_round_trip(spark, tmp_path, waves):
    rng = random.Random(8)
    texts = EDGE + ["é😀 " + " ".join(rng.choice(["alpha", "beta\n", "gamma"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    path, index = shards.materialise(frame(spark, texts), length=16, shard_records=32, path=str(tmp_path / f"s{waves}"), waves=waves)
    rows = {r["slot"]: r for r in index.collect()}
    back = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in shards.read(spark, path).collect()}
    assert sorted(rows) == sorted(back) == list(range(len(rows)))
    pieces = defaultdict(list)
    for slot, r in rows.items():
        pieces[r["doc_id"]].append((r["seq_no"], back[slot][: r["n_ids"]]))
        file = [f for f in os.listdir(f"{path}/shard={r['shard']}") if f.startswith("part")]
        assert len(file) == 1
        with open(f"{path}/shard={r['shard']}/{file[0]}", "rb") as f:
            f.seek(r["byte_offset"])
            assert f.read(32) == back[slot].tobytes()
    encode = shards.encoder(open(shards.VOCABULARY, "rb").read())
    for k, text in enumerate(texts):
        if text:
            ids = np.concatenate([x for _, x in sorted(pieces[k], key=lambda p: p[0])])
            assert ids[-1] == 50256 and encode.decode(ids[:-1].tolist()) == text
        else:
            assert k not in pieces
    later = shards.read(spark, path, start=40)
    assert sorted(r["slot"] for r in later.collect()) == list(range(40, len(rows)))


def test_wide_ids_are_read_at_their_own_stride(spark, tmp_path):
    # Ids of 65,536 and more take 4 bytes: bytes as they are, and pairs of them from 70,000 on.
    words = [bytes([k]) for k in range(256)] + [b"aa", b"ab", b"ba"]
    ranks = [*range(256), 70_000, 70_001, 70_002]
    file = tmp_path / "wide.tiktoken"
    file.write_text("".join(f"{base64.b64encode(w).decode()} {r}\n" for w, r in zip(words, ranks, strict=True)))
    texts = ["ab" * 50 + f" x{k}" for k in range(40)]
    path, index = shards.materialise(frame(spark, texts), vocabulary=str(file), length=16, shard_records=32, path=str(tmp_path / "s"))
    back = {r["slot"]: np.frombuffer(r["ids"], "<u4") for r in shards.read(spark, path).collect()}
    assert shards.layout(spark, path) == {"length": 16, "width": 4, "shard_records": 32, "pad": 70_003, "sequences": len(back)}
    pieces = defaultdict(list)
    for r in index.collect():
        pieces[r["doc_id"]].append((r["seq_no"], back[r["slot"]][: r["n_ids"]]))
    encode = shards.encoder(file.read_bytes())
    for k, text in enumerate(texts):
        ids = np.concatenate([x for _, x in sorted(pieces[k], key=lambda p: p[0])])
        assert ids.max() == 70_003 and encode.decode(ids[:-1].tolist()) == text
    got = shards.training_order(frame(spark, texts), vocabulary=str(file), length=16, shard_records=32).collect()
    assert len(got) == len(back) and {r["sha256"] for r in got} == {hashlib.sha256(x.tobytes()).hexdigest() for x in back.values()}


def test_order_does_not_depend_on_how_tasks_split_files(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    for k in range(3):
        frame(spark, texts[k * 100 : k * 100 + 100], k * 100).coalesce(1).write.option("parquet.block.size", 2048).mode("append").parquet(str(tmp_path / "docs"))
    size, found = "spark.sql.files.maxPartitionBytes", []
    was = spark.conf.get(size)
    try:
        for limit in ("128m", "3k", "9k"):
            spark.conf.set(size, limit)
            docs = spark.read.parquet(str(tmp_path / "docs"))
            _, index = shards.materialise(docs, length=16, shard_records=64)
            found.append(sorted((r["slot"], r["doc_id"], r["seq_no"]) for r in index.collect()))
            found[-1].append(docs.rdd.getNumPartitions())
    finally:
        spark.conf.set(size, was)
    assert len({f.pop() for f in found}) > 1 and found[0] == found[1] == found[2]


def test_rows_without_or_with_repeated_ids_keep_their_sequences(spark):
    df = spark.createDataFrame([(None, "alpha beta"), (None, "gamma"), (4, "delta"), (4, "delta"), (4, None)], "doc_id long, text string").withColumn("slot", F.lit("mine"))
    got = shards.training_order(df, length=4, shard_records=2).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({None: 2, 4: 2}) and sorted(r["slot"] for r in got) == [0, 1, 2, 3]


def test_no_sequences(spark):
    assert shards.training_order(frame(spark, [None, ""])).count() == 0
    assert shards.training_order(frame(spark, [])).count() == 0


# --- the pipeline --------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(got) <= set(source) and len(got) == out.count()
        if name == "quality_rules":
            assert all(plain_measures(t)[0] >= 10 for t in got.values())
        if name == "minhash_near_dedup":
            want = plain_dups(sorted(source.items()), 5, 80)
            assert set(got) == {k for k, (_, c) in want.items() if k == c}
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            assert all(plain_hits(t, items, 10)[1] == 0 for t in got.values())
            clean = {k for k, t in source.items() if plain_hits(t, items, 10)[1] == 0}
            assert all(got[k] == source[k] for k in clean)
        docs, source = out, got
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in final.collect()} == {k for k, t in source.items() if t}


def test_one_row_of_each_group_without_ids(spark):
    near = lambda start, k: " ".join([f"{start}{i}" for i in range(60)] + [f"x{k}"])
    rows = [(None, near("a", 0)), (None, near("a", 1)), (None, near("a", 1)), (None, near("b", 0)), (None, near("b", 1)), (3, near("b", 2)), (3, near("c", 0))]
    rows += [(None, near("c", 1)), (9, near("d", 0)), (9, near("d", 0)), (None, None), (None, None), (None, " "), (4, ""), (4, None), (3, ""), (9, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(5)
    got = [(r["doc_id"], (r["text"] or "").strip()[:1], r["n"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert Counter((i, t if i != 3 else "bc") for i, t, _ in got) == Counter({(None, "a"): 1, (3, "bc"): 1, (9, "d"): 1, (4, ""): 1, (None, ""): 2})
    assert 3 in [i for i, t, _ in got if t in ("b", "c")]


def test_pipeline_on_edges(spark):
    docs = frame(spark, EDGE).union(frame(spark, EDGE))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0), docs.withColumn("doc_id", F.lit(None).cast("long"))):
            assert stage(spark, d, SF).columns == docs.columns and stage(spark, d, SF).count() <= d.count()


def test_sha_of_records(spark):
    got = shards.training_order(frame(spark, ["hello"]), length=8, shard_records=4).first()
    ids = [*shards.encoder(open(shards.VOCABULARY, "rb").read()).encode_ordinary("hello"), 50256]
    raw = np.array(ids + [50256] * (8 - len(ids)), "<u2").tobytes()
    assert got["sha256"] == hashlib.sha256(raw).hexdigest()


# --- clashing names ------------------------------------------------------------------------------------------------------


def test_dedup_stage_keeps_columns_of_any_name(spark):
    names = ("_key", "_id", "_k", "_row", "_kept_id", "_kept_key")
    rows = [(k, "one two three four five six", *(f"{n}{k}" for n in names)) for k in (3, 1, 1)] + [(4, "other words stand here as well", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, {rows[1], rows[3], rows[4]}))


def test_sequences_know_their_files_beside_a_column_of_that_name(spark, tmp_path):
    own = spark.createDataFrame([(k, f"text {k}", "mine") for k in range(4)], "doc_id long, text string, _metadata string")
    own.write.parquet(str(tmp_path / "docs"))
    placed = shards._placed(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert len(placed) == 4 and all(r["_file"].endswith(".parquet") and r["_start"] is not None for r in placed)
    assert {(r["_file"], r["_start"]) for r in shards._placed(own).collect()} == {(None, None)}
    with pytest.raises(Exception, match="text"):
        shards._placed(own.drop("text"))
