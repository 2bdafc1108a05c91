"""Quality rules by weak supervision: labelling rules vote or abstain, EM estimates how far each can be trusted, and the
posterior probability of "good" decides, instead of requiring every rule to pass.

Everything that touches rows is a built-in column expression.  The corpus is reduced to one count per vote pattern
(three outcomes per rule, so at most ``3 ** len(RULES)`` rows whatever the corpus size); EM runs on those counts.

Defined results: a null text counts as empty, has no words and so fails the base rule; every input row gives one output
row; ties and repeated rows are scored alike; an empty table gives an empty result.  Columns beyond ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

#: name -> (vote for bad if, vote for good if); neither: the rule abstains.  Over the measures made by ``measure``.  EM takes the
#: votes as independent within a class, so each rule reads a property of its own: no count enters two rules.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    "repeats": ("n_repeat_words * 20 > 3 * n_words", "n_repeat_words * 50 <= n_words"),
    "dup_lines": ("n_dup_lines * 4 > n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "word_length": ("word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 7 * n_words"),
    "capitals": ("n_upper * 3 > word_chars", "n_upper * 10 <= word_chars and n_upper > 0"),
    "stops": ("n_stops * 100 < n_words and n_words >= 50", "n_stops * 40 >= n_words"),
    "distinct": ("n_distinct * 5 < n_words", "n_distinct * 10 >= 4 * n_words"),
    "short_words": ("n_short * 20 < n_words", "n_short * 10 >= n_words"),
}
EM_ROUNDS, PRIOR_GOOD, PSEUDO = 40, 0.8, 5.0


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts that the rules read, one row per document."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, t.alias("_t"))
    trimmed = F.btrim("_t", F.lit(BLANKS))
    base = base.withColumn("_w", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    n = F.size("_w")
    grams = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    )
    base = base.withColumn("_g", grams)
    # Positions of windows that occur twice; only texts that have any pay for finding them.
    again = F.size("_g") > F.size(F.array_distinct("_g"))
    ranked = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_r", F.when(again, ranked))
    twice = F.filter(
        "_r",
        lambda x, i: (F.coalesce(F.get("_r", i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("_r", i + 1)["h"] == x["h"], F.lit(False))),
    )
    base = base.withColumn("_p", F.when(again, F.array_sort(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    base = base.withColumn("_l", lines)
    return base.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(again, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[A-Z]", ""))).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(_without(F.col("_t"), ".!?;,"))).cast("long").alias("n_stops"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda w: F.length(w).between(2, 3))).cast("long").alias("n_short"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """One character per rule: ``b`` bad, ``g`` good, ``-`` abstain."""
    return F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for bad, good in rules.values()])


def fit(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[float, list[dict[str, tuple[float, float]]]]:
    """EM for the latent good/bad class: its prior and, per rule, P(vote | good) and P(vote | bad).

    A start that trusts every rule alike fixes which class is which; pseudo-counts keep unused outcomes finite.
    """
    k = len(next(iter(patterns), ""))
    prior = PRIOR_GOOD
    start = {"g": (0.7, 0.2), "b": (0.05, 0.5), "-": (0.25, 0.3)}
    tables = [dict(start) for _ in range(k)]
    for _ in range(rounds):
        good = [{v: PSEUDO * start[v][0] for v in "gb-"} for _ in range(k)]
        bad = [{v: PSEUDO * start[v][1] for v in "gb-"} for _ in range(k)]
        mass, total = PSEUDO * PRIOR_GOOD, PSEUDO
        for pattern, n in patterns.items():
            p = posterior(pattern, prior, tables)
            mass, total = mass + n * p, total + n
            for j, v in enumerate(pattern):
                good[j][v] += n * p
                bad[j][v] += n * (1 - p)
        prior = mass / total
        for j in range(k):
            g, b = sum(good[j].values()), sum(bad[j].values())
            tables[j] = {v: (good[j][v] / g, bad[j][v] / b) for v in "gb-"}
    return prior, tables


def posterior(pattern: str, prior: float, tables: list[dict[str, tuple[float, float]]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, the measures, the votes, ``p_good``, ``base_failed`` and ``kept``.

    One scan of the text, whose measures are stored; vote-pattern counts and scores both read that table.
    """
    scored = stored(measure(docs, text, keep).withColumn("votes", votes()), "measures")
    # EM sees what the base rule leaves: the plain failures would otherwise be the only "bad" class that it finds.
    patterns = {r["votes"]: r["count"] for r in scored.filter(~base_failed()).groupBy("votes").count().collect()}  # at most 3 ** len(RULES) rows
    if not patterns:
        return scored.select("*", F.lit(None).cast("double").alias("p_good"), base_failed().alias("base_failed"), F.lit(False).alias("kept"))
    prior, tables = fit(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, t in enumerate(tables):
        v = F.substring("votes", j + 1, 1)
        w = {x: math.log(a / b) for x, (a, b) in t.items()}
        odds = odds + F.when(v == "g", w["g"]).when(v == "b", w["b"]).otherwise(w["-"])
    scored = scored.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
