"""Mixing documents to target weights by iterative proportional fitting (raking).

Token counts are summed by cell (source, language, topic).  Each margin has a target share of the tokens; raking finds one
factor per margin value such that inclusion probabilities ``min(1, product of factors)`` give every margin its share of the
token budget in expectation.  A document is sampled when its own hashed draw, a function of its id and the seed
alone, falls below its cell's probability, so the sample doesn't depend on partitioning or retries.

Targets are either given (``targets``: margin -> value -> share) or each margin's own shares flattened by a power.  Values that given
targets leave out share what is left of 1 as their flattened shares have it; nothing left means that they are not sampled.
Targets that contradict each other, or ask for more tokens than a value has, can't be met; the probabilities are then the last
round's, and ``margin_report`` shows which shares were missed.

The measures of the rows (counts, cell and draw, no text) are stored, so that each text is read once.  Rows meet only in the sums by
cell (partial aggregation).  Up to ``CELLS_ON_DRIVER`` cells the fitting runs on the driver's
copy of the cell table; beyond, the same rounds with the same
stop run as joins on stored tables, three small jobs and one for the stop in each.

Defined results: a null source, language or topic is a value of its own; null or empty texts have no tokens and are sampled with
their cell's probability; every input row gives one output row and repeated rows share one fate; null ids draw by their text; an
empty table gives an empty result.  Extra columns are ignored by ``probabilities`` and carried along by ``sample``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import discard, stored

MARGINS = ("source", "lang", "topic")
TEMPER, KEEP = 0.7, 0.8
ROUNDS, CLOSE = 500, 1e-9
CELLS_ON_DRIVER = 200_000  # some 20 MB, also the bound of what is broadcast
BLANKS = " \t\n\x0b\f\r"


def n_tokens(text: str = "text") -> Column:
    """White-space tokens."""
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse genre, used as the topic where a table has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    pipes = F.length(t) - F.length(F.translate(t, "|", ""))
    marks = F.length(t) - F.length(F.translate(t, "#*$%&!", ""))
    return (
        F.when(pipes * 50 > F.length(t), "table")
        .when(marks * 20 > F.length(t), "marked")
        .when(t.rlike("(?i)licen[cs]ed? "), "legal")
        .when(F.length(t) < 400, "short")
        .when(F.length(t) > 4000, "long")
        .otherwise("plain")
    )


def _named(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(c)


Targets = dict[str, dict[str | None, float]]


def _text(value: str | None) -> str:
    return "null" if value is None else f"={value}"


def _plain(c: str) -> Column:
    return F.when(F.col(c) != "null", F.substring(c, 2, 1 << 30)).alias(c)


def tempered(cells: dict[tuple, float], power: float = TEMPER, margins: tuple[str, ...] = MARGINS, targets: Targets | None = None) -> list[dict[str, float]]:
    """Targets by margin: shares in proportion to ``tokens ** power``, but the given ones where there are such."""
    out = []
    for d, margin in enumerate(margins[: len(next(iter(cells), ()))]):
        sums: dict[str, float] = defaultdict(float)
        for cell, n in sorted(cells.items()):
            sums[cell[d]] += n
        own = {_text(v): share for v, share in (targets or {}).get(margin, {}).items()}
        flat = {v: n**power for v, n in sums.items() if v not in own}
        left, total = max(0.0, 1.0 - sum(own.values())), sum(flat.values()) or 1.0
        out.append({v: own[v] if v in own else flat[v] / total * left for v in sums})
    return out


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], budget: float, rounds: int | None = None) -> dict[tuple, float]:
    """Inclusion probability of each cell.  ``targets``: by margin, value -> share of ``budget`` tokens.

    Ends when every share is met or, where that can't be, after ``rounds``.
    """
    factors = [{v: 1.0 for v in t} for t in targets]
    order = sorted(cells)

    def p(cell: tuple) -> float:
        return min(1.0, math.prod(f[v] for f, v in zip(factors, cell, strict=True)))

    for _ in range(rounds or ROUNDS):
        worst = 0.0
        for d, target in enumerate(targets):
            got: dict[str, float] = defaultdict(float)
            for cell in order:
                got[cell[d]] += cells[cell] * p(cell)
            for v, share in target.items():
                if got[v] > 0:
                    ratio = share * budget / got[v]
                    factors[d][v] = min(factors[d][v] * ratio, 1e12)
                    worst = max(worst, abs(ratio - 1))
        if worst < CLOSE:
            break
    return {cell: p(cell) for cell in order}


def _due(cells: DataFrame, margin: str, power: float, given: dict[str | None, float]) -> DataFrame:
    """``margin`` and ``_share``: what ``tempered`` has for it, as a table."""
    own = F.lit(None).cast("double")
    for v, share in given.items():
        own = F.when(F.col(margin) == _text(v), float(share)).otherwise(own)
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("_n")).withColumn("_own", own).withColumn("_flat", F.when(F.col("_own").isNull(), F.pow("_n", F.lit(power))))
    total = sums.agg(F.sum("_flat")).first()[0] or 1.0
    left = max(0.0, 1.0 - sum(given.values()))
    return sums.select(margin, F.coalesce("_own", F.col("_flat") / total * left).alias("_share"))


def _rake_frames(cells: DataFrame, margins: tuple[str, ...], budget: float, power: float, rounds: int | None = None, targets: Targets | None = None) -> DataFrame:
    """``rake`` for more cells than the driver should hold: the same factor per margin value, clips, rounds and stop.

    A round adjusts one margin after the other; each adjustment is joins of the cells with the factors, one aggregate and a stored
    table of the margin's factors.
    """
    factors = {}
    for c in margins:
        factors[c] = stored(_due(cells, c, power, (targets or {}).get(c, {})).select(c, (F.col("_share") * budget).alias("_due"), F.lit(1.0).alias("_f"), F.lit(0.0).alias("_off")), "rake")

    def fitted() -> DataFrame:
        now, product = cells, F.lit(1.0)
        for c in margins:
            now = now.join(factors[c].select(c, F.col("_f").alias(f"_f_{c}")), c)
            product = product * F.col(f"_f_{c}")
        return now.select(*margins, "tokens", F.least(F.lit(1.0), product).alias("p"))

    for _ in range(rounds or ROUNDS):
        for c in margins:
            got = fitted().groupBy(c).agg(F.sum(F.col("tokens") * F.col("p")).alias("_got"))
            ratio = F.when(F.col("_got") > 0, F.col("_due") / F.col("_got")).otherwise(1.0)
            old = factors[c]
            factors[c] = stored(old.join(got, c).select(c, "_due", F.least(F.col("_f") * ratio, F.lit(1e12)).alias("_f"), F.abs(ratio - 1).alias("_off")), "rake")
            discard(old)
        worst = reduce(DataFrame.union, [factors[c].select("_off") for c in margins]).agg(F.max("_off")).first()[0]
        if (worst or 0.0) < CLOSE:
            break
    return fitted().drop("tokens")


def draw(seed: int) -> Column:
    """A uniform number in [0, 1) that belongs to the document."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)))
    return F.pmod(own, F.lit(1 << 53)) / F.lit(float(1 << 53))


def _cells(rows: DataFrame, margins: tuple[str, ...]) -> DataFrame:
    return stored(rows.groupBy(*margins).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")


def _own_margins(docs: DataFrame, margins: tuple[str, ...]) -> list[Column]:
    own = {c: (_named(c) if c in docs.columns else F.lit("null").alias(c)) for c in margins}
    if "topic" in margins and "topic" not in docs.columns:
        own["topic"] = F.concat(F.lit("="), topic()).alias("topic")
    return list(own.values())


def fit(cells: DataFrame, margins: tuple[str, ...], keep: float, power: float, targets: Targets | None) -> DataFrame:
    """The margins and ``p`` of each cell."""
    for margin, given in (targets or {}).items():
        if margin not in margins or min(given.values(), default=0.0) < 0 or sum(given.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {margin!r}: a margin of {margins} with shares of at least 0 that sum to at most 1")
    if cells.count() > CELLS_ON_DRIVER:
        return _rake_frames(cells, margins, keep * (cells.agg(F.sum("tokens")).first()[0] or 0.0), power, targets=targets)
    table = {tuple(r[c] for c in margins): r["tokens"] for r in cells.collect()}
    found = rake(table, tempered(table, power, margins, targets), keep * sum(table.values()))
    schema = ", ".join(f"`{c}` string" for c in margins) + ", p double"
    return F.broadcast(cells.sparkSession.createDataFrame([(*k, v) for k, v in found.items()], schema))


def probabilities(docs: DataFrame, margins: tuple[str, ...] = MARGINS, keep: float = KEEP, power: float = TEMPER, seed: int = 7, targets: Targets | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, the margins, probability ``p``, design ``weight`` 1/p (null at 0) and ``selected``, one row per row."""
    rows = stored(docs.select("doc_id", n_tokens().alias("n_tokens"), *_own_margins(docs, margins), draw(seed).alias("_u")), "draws")
    out = rows.join(fit(_cells(rows, margins), margins, keep, power, targets), list(margins))
    weight = F.when(F.col("p") > 0, 1 / F.col("p")).alias("weight")
    return out.select("doc_id", "n_tokens", *map(_plain, margins), "p", weight, (F.col("_u") < F.col("p")).alias("selected"))


def sample(docs: DataFrame, margins: tuple[str, ...] = MARGINS, keep: float = KEEP, power: float = TEMPER, seed: int = 7, targets: Targets | None = None) -> DataFrame:
    """The sampled rows of ``docs``, as they are."""
    own = _own_margins(docs, margins)
    by_cell = fit(_cells(docs.select(n_tokens().alias("n_tokens"), *own), margins), margins, keep, power, targets)
    rows = docs.select(*own, draw(seed).alias("_u"), F.struct(*docs.columns).alias("_row"))
    return rows.join(by_cell, list(margins)).filter("_u < p").select("_row.*")


def margin_report(found: DataFrame, margins: tuple[str, ...] = MARGINS, power: float = TEMPER, targets: Targets | None = None, slack: float = 1e-3) -> DataFrame:
    """``margin, value, target, share, met`` of what ``probabilities`` found: target shares beside the expected ones."""
    cells = found.groupBy(*[_named(c) for c in margins]).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.sum(F.col("n_tokens") * F.col("p")).alias("kept"))
    cells = stored(cells, "report")
    total = cells.agg(F.sum("kept")).first()[0] or 1.0
    out = []
    for c in margins:
        sums = cells.groupBy(c).agg((F.sum("kept") / total).alias("share")).join(_due(cells, c, power, (targets or {}).get(c, {})), c)
        out.append(sums.select(F.lit(c).alias("margin"), _plain(c).alias("value"), F.col("_share").alias("target"), "share", (F.abs(F.col("share") - F.col("_share")) <= slack).alias("met")))
    return reduce(DataFrame.unionByName, out)
