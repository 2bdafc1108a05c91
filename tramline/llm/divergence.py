"""Audit of how the sources of a language differ in their words.

Terms are counted by Arrow's own kernels: inside ``mapInArrow`` a batch is lower-cased (``ascii_lower``), split
(``split_pattern_regex``), encoded (``dictionary_encode``) and grouped by hash, first by document and term, then by group and
term.  A task merges its partial counts while they fit and passes on the rest; one shuffle by group and term and one by language
and term leave a stored table of kept terms, each with its counts by source.  Its rows are dealt into shards of some 256 terms of a
language, and every shard, a matrix of sources by terms, gives its part of each pair's divergence and its own top terms.

A language keeps the ``V`` terms that occur in at least ``min_docs`` of its documents.  In a group (a source of a language, or the
whole language) with ``N`` occurrences of kept terms, a term with ``count`` of them has the share
``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))``.  All numbers are whole; the quotient is taken in three steps of a thousand, exact up to
9e15 occurrences.

The pairs of sources are the result itself, so their number is that of the rows returned; a shard has one partial row for each.

Defined results: null texts, languages and sources count as ''; every occurring group has its pairs, with value 0 where nothing is kept;
repeated rows are documents of their own; ties are ranked by the item's bytes; very long texts are split whole; an empty table gives
an empty result.  Columns beyond ``text``, ``lang`` and ``source`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import in_batches, stored

GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms
MIN_DOCS, TOP, SMOOTH, UNIT_STEPS = 30, 50, 5, 3
SHARD_TERMS = 256
HELD_ROWS = 100_000
PARTIAL = "lang string, source string, term string, n long, docs long"


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of one batch of ``lang, source, text``; every group also has a row with a null term."""
    lang, source, text = (pc.fill_null(batch.column(i), "") for i in range(3))
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    named = pc.binary_join_element_wise(lang, source, "\0")
    own = pc.binary_join_element_wise(groups["lang"], groups["source"], "\0")
    group_of = pc.index_in(named, own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own)
    lists = pc.split_pattern_regex(pc.ascii_lower(text), GAPS)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(full).dictionary_encode(), parents.filter(full)
    in_docs = pa.table({"doc": parents, "term": words.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    in_groups = pa.table({"group": pc.take(group_of, in_docs["doc"]), "term": in_docs["term"], "n": in_docs["count_all"]}).group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
    at = in_groups["group"]
    counts = [pc.take(groups["lang"], at), pc.take(groups["source"], at), pc.take(words.dictionary, in_groups["term"]), in_groups["n_sum"], in_groups["n_count"]]
    zero = pa.array([0] * len(groups), pa.int64())
    found = pa.table(counts, names=PARTIAL_NAMES)
    return pa.concat_tables([found.cast(PARTIAL_SCHEMA), pa.table([groups["lang"], groups["source"], pa.nulls(len(groups), pa.string()), zero, zero], names=PARTIAL_NAMES).cast(PARTIAL_SCHEMA)])


PARTIAL_NAMES = ["lang", "source", "term", "n", "docs"]
PARTIAL_SCHEMA = pa.schema([(k, pa.string()) for k in PARTIAL_NAMES[:3]] + [(k, pa.int64()) for k in PARTIAL_NAMES[3:]])


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(PARTIAL_NAMES[:3]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*PARTIAL_NAMES[:3], "n_sum", "docs_sum"]).rename_columns(PARTIAL_NAMES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            parts.append(partial_counts(batch))
            rows += len(parts[-1])
        if rows >= 2 * HELD_ROWS:
            parts = [_merged(parts)]
            rows = len(parts[0])
            if rows >= HELD_ROWS:
                yield from parts[0].to_batches(10_000)
                parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(10_000)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * count / total)``, exactly: three digits at a time."""
    out, rest = np.divmod(count, total)
    for _ in range(UNIT_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _compare(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """One shard: each pair's part of the divergence (``a`` before ``b``), and the terms that stand out most in each source."""
    names = groups["source"].combine_chunks()
    order = pc.sort_indices(names)
    names, sums = names.take(order), groups["total"].combine_chunks().take(order).to_numpy()
    v, whole = groups["terms"][0].as_py(), groups["lang_total"][0].as_py()
    terms = rows["term"].combine_chunks().dictionary_encode() if len(rows) else None
    counts = np.zeros((len(names), len(terms.dictionary) if terms else 0), np.int64)
    overall = np.zeros(counts.shape[1], np.int64)
    if terms:
        at = terms.indices.to_numpy()
        counts[pc.index_in(rows["source"].combine_chunks(), names).to_numpy(), at] = rows["n"].to_numpy()
        overall[at] = rows["lang_n"].to_numpy()
        p = shares(counts + SMOOTH, (sums + SMOOTH * v)[:, None])
        q = shares(overall + SMOOTH, np.int64(whole + SMOOTH * v))
    else:
        p, q = counts, overall
    a, b, values = [], [], []
    for k in range(len(names) - 1):
        a.append(np.full(len(names) - k - 1, k))
        b.append(np.arange(k + 1, len(names)))
        values.append(np.abs(p[k + 1 :] - p[k]).sum(axis=1))
    top_source, top_term, top_value = [], [], []
    for k in range(len(names) if terms else 0):
        found = np.nonzero((counts[k] > 0) & (p[k] > q))[0]
        gain = (p[k] - q)[found]
        if len(found) > TOP:  # ties at the edge stay; the final rank settles them
            found, gain = found[keep := gain >= np.partition(gain, -TOP)[-TOP]], gain[keep]
        top_source += [k] * len(found)
        top_term += found.tolist()
        top_value += gain.tolist()
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    a, b, values = join(a), join(b), join(values)
    take = lambda array, i: array.take(pa.array(i, pa.int64()))
    item = pa.concat_arrays([take(names, b), take(terms.dictionary, top_term) if terms else pa.array([], pa.string())])
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(item), pa.string()), "source": pa.concat_arrays([take(names, a), take(names, top_source)]),
        "part": pa.array(["pair"] * len(a) + ["term"] * len(top_term), pa.string()), "item": item, "value": pa.concat_arrays([pa.array(values, pa.int64()), pa.array(top_value, pa.int64())]),
    })


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of the language by the sum of the differences of
    shares over all kept terms, part ``term`` the terms of the source whose share is above the language's."""
    if not 0 < top <= TOP:
        raise ValueError(f"top is between 1 and {TOP}")
    text = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    parts = in_batches(text, _count, PARTIAL)
    merged = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A group's own row, without a term, is keyed by its source, so that no row lists all the groups of a language.
    apart = F.when(F.col("term").isNull(), F.col("source")).alias("own")
    by_term = merged.groupBy("lang", "term", apart).agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    terms = stored(by_term.filter(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", "own", "lang_n", "counts"), "terms")
    kept = terms.filter("term is not null").select("lang", "term", "lang_n", F.inline("counts"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = terms.filter("term is null").select("lang", F.col("own").alias("source"))
    groups = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("term").alias("terms"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("lang_n"))), F.lit(0)).alias("lang_total"))
    sizes = stored(sizes.withColumn("shards", F.ceil(F.greatest("terms", F.lit(1)) / SHARD_TERMS)), "sizes")
    dealt = kept.join(sizes.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards"))
    spread = groups.join(sizes, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    keyed = lambda df, *rest: df.select(*[F.col(c).alias(f"in_{c}") for c in ("lang", "shard")], *rest).groupBy("in_lang", "in_shard")
    cells = keyed(dealt, "term", "lang_n", "source", "n").cogroup(keyed(spread, "source", "total", "terms", "lang_total"))
    found = stored(cells.applyInArrow(_compare, "lang string, source string, part string, item string, value long"), "parts")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", F.lit("pair").alias("part"), "value", both)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    top_terms = ranked(found.filter("part = 'term'").select("lang", "part", "value", "source", "item")).filter(F.col("rank") <= top)
    return ranked(pairs).unionByName(top_terms).select("lang", "source", "part", "item", "value", "rank")
