"""Language, quality, toxicity, secrets and chat operators on small tables and against plain versions."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tramline.llm import chat, language_id, quality_gam, secrets, toxicity
from tramline.llm.common import remainder_is

DOC = "doc_id long, text string, lang string, source string, score double"
EDGE = [(None, "plain words here", "en", "a", 1.0), (1, None, None, None, None), (2, "", "en", "a", 0.0), (3, "x " * 60_000, "en", "a", 0.0), (4, "same", "en", "a", 0.0), (4, "same", "en", "a", 0.0), (5, "1234 !!", "en", None, 0.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


# --- language ------------------------------------------------------------------------------------------------------------


def made_up(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    parts = {"aa": ["ba", "lo", "ti", "mu"], "bb": ["sch", "ein", "ung", "ver"]}
    rows = [(k, made_up(rng, parts[lang], rng.randint(3, 60)), lang, "s", 0.0) for k, lang in enumerate(["aa", "bb"] * 60)]
    return frame(spark, rows)


def test_language_held_out(spark, tongues):
    held = remainder_is("doc_id", 3, 1)
    model = language_id.train(tongues.filter(~held))
    got = {r["doc_id"]: r for r in language_id.identify(tongues, model, held).collect()}
    want = {r["doc_id"]: r["lang"] for r in tongues.collect()}
    assert all(got[k]["lang_pred"] == want[k] and 0 <= got[k]["score"] <= 1 for k in want)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())


def test_language_edges(spark, tongues):
    model = language_id.train(tongues)
    got = language_id.identify(frame(spark, EDGE), model, remainder_is("doc_id", 3, 1)).collect()
    assert len(got) == len(EDGE)
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] in (1, 2, 5)) == [(1, "und"), (2, "und"), (5, "und")]
    assert language_id.identify(frame(spark, []), model, remainder_is("doc_id", 3, 1)).count() == 0
    assert language_id.train(frame(spark, [])) is None
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, EDGE), None, F.lit(False)).collect()} == {"und"}


def test_kneser_ney_is_a_distribution():
    """Over every character that can follow a context, plus the end, the model's probabilities sum to one."""
    counts = {"x": {"abab": 3, "abc": 1, "ca": 2}, "y": {"bbb": 1}}
    m = language_id.Model(counts)
    alphabet = ["a", "b", "c", language_id.END, "?"]  # ? stands for anything unseen
    for prefix in ("", "a", "ab", "aba", "zz"):
        codes = [language_id._codes([prefix])[0][:-1]]
        total = np.zeros(2)
        for ch in alphabet:
            whole = np.append(codes[0], np.uint32(ord(ch)))
            total += np.exp(step(m, whole))
        assert np.allclose(total, 1.0, atol=1e-4), (prefix, total)


def step(m, codes):
    """Log-probability of the last code given the ones before, by the tables of the model, straight from the definition."""
    starts = np.array([0, len(codes)])
    hashed = language_id._hashes(codes, starts, m.order)
    out = np.zeros(len(m.langs))
    for n in range(m.order, 0, -1):
        h, ok = hashed[n - 1]
        if not ok[-1]:
            continue
        keys, rows = m.grams[n - 1]
        k = np.searchsorted(keys, h[-1])
        if k < len(keys) and keys[k] == h[-1]:
            return out + rows[k]
        ctx, back = m.contexts[n - 1]
        of = hashed[n - 2][0][-2] if n > 1 else np.uint64(0)
        c = np.searchsorted(ctx, of)
        if c < len(ctx) and ctx[c] == of:
            out = out + back[c]
    return out + m.floor


def test_word_scores_match_steps():
    m = language_id.Model({"x": {"abab": 3, "abc": 1, "ca": 2}, "y": {"bbb": 1, "cab": 2}})
    for word in ("ab", "abc", "zab", "c", "bbbbabca"):
        codes, _ = language_id._codes([word])
        want = sum(step(m, codes[: k + 1]) for k in range(1, len(codes)))
        assert np.allclose(m.words([word, "ca"])[0], want, atol=1e-3)


def plain_kneser_ney(counts, size, order=4, discount=0.75):
    """P(character | up to ``order - 1`` before it) by the textbook recursion over dictionaries; contexts do not leave the word."""
    occurrences, lefts = {}, {}
    for word, times in counts.items():
        marked = "\x02" + word + "\x03"
        for at in range(1, len(marked)):
            for n in range(1, order + 1):
                if at - n + 1 < 0:
                    continue
                gram = marked[at - n + 1 : at + 1]
                occurrences[gram] = occurrences.get(gram, 0) + times
                if at - n >= 0:
                    lefts.setdefault(gram, set()).add(marked[at - n])
                else:
                    lefts.setdefault(gram, [0])[0] += times  # at the start of a word nothing stands to the left
    count = lambda g: occurrences[g] if len(g) == order else lefts[g][0] if isinstance(lefts[g], list) else len(lefts[g])

    def p(history, ch):
        own = {g: count(g) for g in occurrences if len(g) == len(history) + 1 and g[:-1] == history}
        lower = p(history[1:], ch) if history else 1 / size
        if not own:
            return lower
        n = own.get(history + ch, 0)
        return (n - min(n, discount) + sum(min(x, discount) for x in own.values()) * lower) / sum(own.values())

    return p


def test_kneser_ney_against_the_textbook():
    counts = {"x": {"abab": 3, "abc": 1, "ca": 2, "a": 4}, "y": {"bbb": 1, "cab": 2}}
    m = language_id.Model(counts)
    size = len({c for ws in counts.values() for w in ws for c in w}) + 2
    plain = [plain_kneser_ney(counts[lang], size) for lang in m.langs]
    for word in ("ab", "abc", "zab", "c", "bbbbabca", "a"):
        marked = "\x02" + word + "\x03"
        want = [sum(np.log(p(marked[max(0, at - 3) : at], marked[at])) for at in range(1, len(marked))) for p in plain]
        assert np.allclose(m.words([word])[0], want, atol=1e-3), word


def test_unseen_language_is_rejected(spark):
    rng = random.Random(17)
    parts = {"aa": ["ba", "lo", "ti", "mu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["xyq", "jzw", "qqk"]}
    rows = [(k, made_up(rng, parts[lang], rng.randint(20, 60)), lang, "s", 0.0) for k, lang in enumerate(["aa", "bb"] * 260)]
    strange = [(k + 1000, made_up(rng, parts["cc"], 40), None, "s", 0.0) for k in range(50)]
    docs = frame(spark, rows + strange)
    model = language_id.train(docs)
    assert set(model.lowest) == {"aa", "bb"}
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs, model, F.lit(False)).collect()}
    assert all(got[k] for k, *_ in strange) and sum(got[k] for k, *_ in rows) <= 5


def test_a_language_column_of_many_values_and_repeats(spark, tongues):
    many = tongues.withColumn("lang", F.when(F.col("doc_id") < 60, F.concat(F.lit("l"), F.col("doc_id"))).otherwise(F.col("lang")))
    model = language_id.train(many.union(many).withColumn("rejected", F.lit(1)).withColumn("_part", F.lit(2)).withColumn("share", F.lit(3)))
    assert len(model.model.langs) > 30
    got = language_id.identify(many.union(many), model, F.lit(False)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert len(got) == 240 and all(len(v) == 1 for v in by.values())


def test_groups_of_languages_score_as_one_model_and_stay_sparse(monkeypatch):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñ"
    counts = {f"l{k:03d}": {"".join(rng.choices(letters[k % 9 : k % 9 + 20], k=rng.randrange(2, 9))): rng.randrange(1, 5) for _ in range(150)} for k in range(20)}
    asked = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(300)]
    whole = language_id.Model(counts)
    monkeypatch.setattr(language_id, "GROUP", 3)
    grouped = language_id.Models(counts)
    assert len(grouped.groups) == 7 and grouped.langs == whole.langs
    assert np.allclose(grouped.words(asked), whole.words(asked), atol=1e-3)
    monkeypatch.setattr(language_id, "GROUP", 16)
    many = {f"l{k:03d}": {"".join(rng.choices(letters, k=7)): 1 for _ in range(200)} for k in range(96)}
    few = language_id.Models({k: many[k] for k in list(many)[:16]})
    assert language_id.Models(many).nbytes < 8 * few.nbytes, "memory grows with the languages, not with their square"


def test_a_model_too_large_to_broadcast_is_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_BYTES", 1000)
    docs = spark.createDataFrame([(1, "some words of a text", "en"), (2, "autres mots", "fr")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="broadcast"):
        language_id.train(docs)


# --- quality -------------------------------------------------------------------------------------------------------------


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # neither feature helps alone
    p = quality_gam.Gam(x[:2000], y[:2000]).score(x[2000:])
    assert ((p > 0.5) == (y[2000:] > 0)).mean() > 0.85


def test_gam_scores_against_plain_lookup(spark):
    """Scores are sums of table entries: found here one feature at a time by bisection."""
    from bisect import bisect_right

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["Word", "a", "b,", "#$", "| |", "1 2", "end.\n"]) for _ in range(rng.randint(1, 80))), "en", "s", 0.0) for k in range(300)]
    docs = frame(spark, rows).withColumn("predicted", F.lit("clash")).withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(k, int("#" in t)) for k, t, *_ in rows] + [(1, 0)] * 500, "doc_id long, quality int")
    model = quality_gam.train(docs.union(docs), labels)
    got = quality_gam.score(docs, model, F.lit(False)).collect()
    assert model.pairs
    for r in got:
        x = quality_gam.features(rows[r["doc_id"]][1])
        f = model.base + sum(float(t[bisect_right(e.tolist(), v)]) for t, e, v in zip(model.tables, model.edges, x, strict=True))
        low = [bisect_right(e.tolist(), v) for e, v in zip(model.coarse, x, strict=True)]
        f += sum(float(t[low[i], low[j]]) for i, j, t in model.pairs)
        assert abs(r["score"] - 1 / (1 + math.exp(-f))) < 1e-9


def test_gam_edges(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality_gam.train(frame(spark, EDGE), labels)
    got = quality_gam.score(frame(spark, EDGE), model, remainder_is("doc_id", 3, 1)).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality_gam.score(frame(spark, []), model, F.lit(False)).count() == 0
    empty = quality_gam.train(frame(spark, []), labels.limit(0))
    assert {round(r["score"], 3) for r in quality_gam.score(frame(spark, EDGE), empty, F.lit(False)).collect()} == {0.5}


# --- toxicity ------------------------------------------------------------------------------------------------------------


def test_network_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(2)
    x, ok, y = r.normal(size=(5, 3, 6 * toxicity.HIDDEN)), r.random((5, 3)) < 0.8, np.array([1.0, 0.0, 1.0])
    ok[0] = True
    grad, dx, _ = net.gradients(x, ok, y)

    def loss():
        f = net.run(x, ok)
        return np.mean(np.log1p(np.exp(-f)) * y + np.log1p(np.exp(f)) * (1 - y))

    for name in ("Uf", "Ub", "a", "o"):
        v = net.p[name]
        at = tuple(0 for _ in v.shape)
        was, eps = v[at], 1e-5
        v[at] = was + eps
        up = loss()
        v[at] = was - eps
        down = loss()
        v[at] = was
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-4, name
    was = x[2, 1, 3]
    x[2, 1, 3] = was + 1e-5
    up = loss()
    x[2, 1, 3] = was - 2e-5 + 1e-5
    down = loss()
    assert abs((up - down) / 2e-5 - dx[2, 1, 3]) < 1e-3


def plain_top(net, ws):
    """The highest window logit, one number at a time."""
    H, p = toxicity.HIDDEN, {k: v.astype(np.float64).tolist() for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    cut = lambda m, a, b: [row[a:b] for row in m]
    times = lambda v, m: [sum(x * row[j] for x, row in zip(v, m, strict=True)) for j in range(len(m[0]))]

    def embed(w):
        flat, _ = toxicity.grams([w])
        own = p["word"][xxhash.xxh32_intdigest(w.encode()) % toxicity.WORD_BUCKETS]
        return [x + sum(p["gram"][g][j] for g in flat) / len(flat) for j, x in enumerate(own)]

    def states(es, d):
        h, out = [0.0] * H, []
        for e in es:
            x = [a + b for a, b in zip(times(e, p[f"W{d}"]), p[f"c{d}"], strict=True)]
            U = p[f"U{d}"]
            gates = times(h, cut(U, 0, 2 * H))
            z, r = [sigmoid(x[j] + gates[j]) for j in range(H)], [sigmoid(x[H + j] + gates[H + j]) for j in range(H)]
            inner = times([a * b for a, b in zip(r, h, strict=True)], cut(U, 2 * H, 3 * H))
            h = [a + b * (math.tanh(x[2 * H + j] + inner[j]) - a) for j, (a, b) in enumerate(zip(h, z, strict=True))]
            out.append(h)
        return out

    best = -math.inf
    for s in sorted({*range(0, max(1, len(ws) - 32), 16), max(0, len(ws) - 32)}):
        es = [embed(w) for w in ws[s : s + 32]]
        both = [a + b for a, b in zip(states(es, "f"), states(es[::-1], "b")[::-1], strict=True)]
        att = [math.exp(sum(x * y for x, y in zip(h, p["a"], strict=True))) for h in both]
        pooled = [sum(w * h[j] for w, h in zip(att, both, strict=True)) / sum(att) for j in range(2 * H)]
        best = max(best, sum(x * y for x, y in zip(pooled, p["o"], strict=True)) + p["z"][0])
    return best


def test_toxicity_scores_against_a_plain_pass(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "bét", "g", "delta7", "bad"]) for _ in range(rng.choice([1, 5, 31, 32, 33, 49, 80]))), "en", "s", 0.0) for k in range(25)]
    docs = frame(spark, rows + rows).withColumn("predicted", F.lit("clash"))
    net = toxicity.Network(7)
    net.calibration = (-0.3, 1.7, 0.4)
    got = toxicity.score(docs, net, F.lit(False)).collect()
    assert len(got) == 50
    for r in got:
        ws = rows[r["doc_id"]][1].lower().split()
        n = len({*range(0, max(1, len(ws) - 32), 16), max(0, len(ws) - 32)})
        want = 1 / (1 + math.exp(-(-0.3 + 1.7 * plain_top(net, ws) + 0.4 * math.log1p(n))))
        assert abs(r["score"] - want) < 1e-5 and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_finds_one_bad_window(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for k in range(240):
        ws = [word() for _ in range(rng.randint(20, 150))]
        bad = k % 4 == 0
        if bad:
            ws[rng.randrange(len(ws))] = "zwquk" + rng.choice(["", "er", "ing", "s"])
        rows.append((k, " ".join(ws), "en", "s", 0.0))
        labels.append((k, int(bad)))
    docs, held = frame(spark, rows), remainder_is("doc_id", 4, 2)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int").filter(~held))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, held).collect()}
    hits = [(got[k]["predicted"], y) for k, y in labels if got[k]["held_out"]]
    assert sum(p == y for p, y in hits) / len(hits) > 0.95


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, EDGE), labels)
    got = toxicity.score(frame(spark, EDGE), model, F.lit(False)).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(frame(spark, []), model, F.lit(False)).count() == 0
    one = toxicity.train(frame(spark, EDGE), labels.filter("toxic = 0"))
    assert one.constant is not None and toxicity.score(frame(spark, EDGE), one, F.lit(False)).count() == len(EDGE)
    assert toxicity.windows(0) == [] and toxicity.windows(5) == [0] and toxicity.windows(40)[-1] == 8
    for n in (33, 48, 49, 200):
        covered = {x for s in toxicity.windows(n) for x in range(s, s + toxicity.SPAN)}
        assert covered == set(range(n))


# --- secrets -------------------------------------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | ((n.bit_length() + 7) // 8)]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def number(n, size=1):
    return der(2, n.to_bytes(size, "big"))


KEY = der(0x30, number(0), number(12345, 130), *[number(k + 2, 40) for k in range(7)])
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48")), der(3, b"\0" * 80))


def token(head, body=None):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{part(head)}.{part(body if body is not None else {'sub': 'x'})}.{'A' * 43}"


def test_confirmed_structures():
    b64 = base64.b64encode(KEY).decode()
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secrets.confirmed_spans(t)]
    assert kinds(f"é {armour} x") == [("key", armour)]
    assert kinds(f"see {b64} there") == [("key", b64)]
    assert kinds(f"hex {KEY.hex()} there") == [("key", KEY.hex())]
    good = token({"alg": "HS256"})
    assert kinds(f"a {good} b") == [("signed", good)]
    assert kinds(f"a {token({'typ': 'JWT'})} b") == []  # names no algorithm
    assert kinds(base64.b64encode(PUBLIC).decode()) == []
    assert kinds(base64.b64encode(KEY[:-1]).decode()) == []  # a length that doesn't hold
    assert kinds("A" * 200) == [] and kinds("0" * 200) == []


def test_keys_in_lines_and_escapes():
    b64 = base64.b64encode(KEY).decode()
    lines = [b64[k : k + 64] for k in range(0, len(b64), 64)]
    found = lambda t: [(k, t[a:b]) for k, a, b in secrets.confirmed_spans(t)]
    for glue in ("\n", "\r\n", "\\n", "\n    "):
        wrapped = glue.join(lines)
        assert found(f"see\n{wrapped}\nthere it was") == [("key", wrapped)], glue
        armour = f"-----BEGIN RSA PRIVATE KEY-----{glue}{wrapped}{glue}-----END RSA PRIVATE KEY-----"
        assert found(f'{{"private_key": "{armour}"}}') == [("key", armour)], glue
    assert found(f"at /{b64} x") == [("key", b64)] and found(f"x{b64}") == [] and found(f"{b64}A") == []
    assert found(base64.b64encode(KEY + b"\0").decode()) == [] and found("\n".join(lines[:-1])) == []
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    sealed = base64.b64encode(bytes(range(160))).decode()
    whole = lambda h, body: f"-----BEGIN RSA PRIVATE KEY-----\n{h}{body}\n-----END RSA PRIVATE KEY-----"
    assert found(whole(headers, sealed)) == [("key", whole(headers, sealed))]
    assert found(whole(headers, base64.b64encode(bytes(161)).decode())) == []  # no whole blocks
    assert found(whole(headers.replace("00112233", ""), sealed)) == [] and found(whole("", sealed)) == []
    text = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(secrets.SSH_MAGIC + text(b"none") * 2 + text(b"") + (1).to_bytes(4, "big") + text(b"p" * 51) + text(b"s" * 150)).decode()
    cut = "\n".join(ssh[k : k + 70] for k in range(0, len(ssh), 70))
    assert found(f"x {ssh} y") == [("key", ssh)] and found(f"x\n{cut}\ny") == [("key", cut)] and found(ssh[:-8]) == []


@pytest.mark.parametrize("piece", ["/MIMPQUFB", "/" + base64.b64encode(b"\x30\x82\x0f\x00\x02\x01\x00" * 3).decode(), "/b3BlbnNzaC1rZXktdjE" + "AAAAAA" * 3, "-----BEGIN PRIVATE KEY-----\n", "token    ", "eyJh."])
def test_crafted_starts_take_linear_time(piece):
    """Many starts that state long lengths; ten times the text takes some ten times as long."""
    took = []
    for n in (100_000, 1_000_000):
        text = piece * (n // len(piece))
        began = time.process_time()
        spans = secrets.confirmed_spans(text) + secrets.base_spans(text)
        took.append(time.process_time() - began)
        assert not [s for s in spans if s[0] != "assign"]
    assert took[1] < 30 * took[0] + 0.5


def test_a_long_run_holds_its_keys():
    """Keys one below the other in one run of base64 lines, behind starts that are none."""
    b64 = base64.b64encode(KEY).decode()
    block = "\n".join(b64[k : k + 64] for k in range(0, len(b64), 64))
    text = "/MIMPQUFB" * 2000 + "/" + b64 + " " + "\n \n".join([block] * 50)
    found = [text[a:b] for _, a, b in secrets.confirmed_spans(text)]
    assert found == [b64, *[block] * 50]


def plain_base(text):
    out = []
    pattern = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
    return out


def test_secrets_against_plain_version(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", " token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "AKIAAKIA", "abcdef0123456789", "deadbeefdeadbeef", "é", "\n", "x.y-z", "ſecret", "secret", "12345"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), "en", "s", 0.0) for k in range(1000, 1400)] + EDGE
    got = secrets.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for k, text, *_ in rows:
        base = plain_base(text or "")
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in base)
        assert by_id[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [by_id[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(b[0] == x for b in base) for x in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(by_id[k]["spans"].split(","))
    assert secrets.scan(frame(spark, [])).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, [(1, 'x password: "hunter22" y', "en", "s", 0.0), (2, None, None, None, None)])).collect()}
    assert clean == {1: 'x [assign]" y', 2: None}


# --- chat ----------------------------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, speaker string"


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind.", "?"), (1, 1, "ann", "hi", "?"), (1, 2, "bob", "yo", "?"), (1, 2, "bob", "yo", "?"), (1, 3, None, None, "?"), (2, 0, "system", "alone", "?"), (None, None, "ann", "x", "?")]
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(spark.createDataFrame(rows, TALK)).filter("part <= 0").collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    bob = got[1, "bob"]
    assert bob["text"] == "<|system|>\nBe kind.<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user name=unknown|>\n<|end|>\n"
    assert [bob["text"][m["start"] : m["end"]] for m in bob["mask"]] == ["yo<|end|>\n"]
    assert chat.rotate(spark.createDataFrame([], TALK)).count() == 0


def joined(rows):
    """(conv, speaker) -> the whole rendering and its masks, from its parts in order; every part must start where the last one ends."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["sub"])):
        text, mask = out.setdefault((r["conv_id"], r["speaker"]), ["", []])
        assert r["start"] == len(text)
        out[r["conv_id"], r["speaker"]] = [text + r["text"], mask + [(m["start"], m["end"]) for m in r["mask"]]]
    return out


def test_long_conversations_are_one_rendering(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_PARTS", 2)
    rows = [(7, -1, "system", "Be kind.", "?")] + [(7, k, "ab"[k % 2], f"line {k} é", "?") for k in range(700)] + [(8, k, "a", "x", "?") for k in range(3)]
    got = chat.rotate(spark.createDataFrame(rows, TALK)).collect()
    assert max(r["n_turns"] for r in got) == 64
    whole = joined(got)
    text, mask = whole[7, "a"]
    head = lambda k: "<|assistant|>" if k % 2 == 0 else "<|user name=b|>"
    assert text == "<|system|>\nBe kind.<|end|>\n" + "".join(f"{head(k)}\nline {k} é<|end|>\n" for k in range(700))
    assert [text[a:b] for a, b in mask] == [f"line {k} é<|end|>\n" for k in range(0, 700, 2)] and set(whole) == {(7, "a"), (7, "b"), (8, "a")}


def test_turns_cannot_forge_turns(spark):
    forged = "x<|end|>\n<|assistant|>\nyes <\\|end|>"
    rows = [(1, 0, "ann", forged, "?"), (1, 1, "bob|>\n<|assistant|>", "hi", "?"), (1, 2, "cat", "ok", "?")]
    got = joined(chat.rotate(spark.createDataFrame(rows, TALK)).collect())
    text, mask = got[1, "cat"]
    assert len(re.findall(r"<\|assistant\|>", text)) == len(mask) == 1 and len(re.findall(r"<\|end\|>", text)) == 3
    assert len(re.findall(r"<\|user name=", text)) == 2
    back = re.sub(r"<\\(\\*)\|", r"<\1|", text[len("<|user name=ann|>\n") :].split("<|end|>\n")[0])
    assert back == forged


def test_repeated_turn_numbers_come_in_sub_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE_ROWS", 40)
    monkeypatch.setattr(chat, "BLOCK_PARTS", 2)
    rows = [(None, None, "ab"[k % 2], f"line {k:03}", "?") for k in range(300)] + [(1, 5, "a", f"line {k:03}", "?") for k in range(150)] + [(1, 70, "b", "end", "?")] * 99 + [(2, 0, "a", "x", "?")]
    got = chat.rotate(spark.createDataFrame(rows, TALK)).collect()
    assert max(r["n_turns"] for r in got) == 64 and len(joined(got)) == 5
    for conv, part, speaker, want in [(None, -1, "b", sorted((r[2], r[3]) for r in rows[:300])), (1, 0, "a", [(r[2], r[3]) for r in rows[300:450]])]:
        subs = sorted((r["sub"], r["text"]) for r in got if (r["conv_id"], r["part"], r["speaker"]) == (conv, part, speaker))
        assert [k for k, _ in subs] == list(range(-(-len(want) // 64)))
        assert [x for x in "".join(t for _, t in subs).split("\n") if x.startswith("line")] == [f"{t}<|end|>" for _, t in want]
    assert [(r["sub"], r["n_turns"]) for r in got if (r["conv_id"], r["part"], r["speaker"]) == (1, 1, "b")] == [(0, 1)]
