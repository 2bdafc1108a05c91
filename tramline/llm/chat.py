"""Chat formatting with perspective rotation.

Every participant of a conversation in turn becomes the assistant: the dialogue is rendered once per participant, with that
speaker's turns as the assistant's, the others as named users, and character masks over what the assistant says.  System
turns are context in every rendering and no participant.

One rendering is one text, however long, and its masks are offsets into the whole of it.  It is delivered in parts of
``PART_TURNS`` consecutive turn numbers; a part with more rows than that (repeated or null turn numbers) comes in ``sub`` parts of
as many rows, so that no group holds more than a bounded stretch of a conversation.  The texts of the parts in order, with
nothing between them, are the rendering; ``start`` is where a part begins in it.  Starts are prefix sums over the lengths of
parts, level by level (blocks of ``BLOCK_PARTS``), for those conversations only that have several.

Markers inside roles and texts are escaped: ``<|`` and, in roles, ``|>`` get a backslash between their characters, and one more if
there are such already, so that no turn can forge another and the original can be had back.

Participants are found by a partially aggregated distinct, and the turns meet them in a join that AQE can split where one
conversation is hot.

Defined results: exact repeats of a row are rendered once; turns that tie are ordered by role, then text; a null role is the
speaker ``unknown``, a null text is empty, null turns come first (in part -1), and null conversation ids are one conversation;
a conversation with system turns only has no rendering; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import stored

PART_TURNS = 64
RANGE_ROWS = 16_384
BLOCK_PARTS = 4096
SYSTEM, ASSISTANT, END = "<|system|>\n", "<|assistant|>\n", "<|end|>\n"


def _escaped(text: Column, name: bool = False) -> Column:
    out = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(out, r"\|(\\*)>", r"|\\$1>") if name else out


def _header(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user name="), _escaped(role, True), F.lit("|>\n"))
    return F.when(role == "system", SYSTEM).when(role == speaker, ASSISTANT).otherwise(named)


def _numbered(turns: DataFrame, crowded: DataFrame, bound: int) -> DataFrame:
    """``turns`` with ``sub``: 0, but in ``crowded`` parts the row's number div ``bound``, by counts of ranges and their offsets."""
    same = turns["conv_id"].eqNullSafe(crowded["c"]) & (turns["part"] == crowded["p"])
    few = turns.join(crowded, same, "left_anti").withColumn("sub", F.lit(0).cast("long"))
    many = turns.join(crowded, same, "left_semi")
    order = ("turn", "role", "said")
    ranges = max(1, -(-(crowded.agg(F.sum("count")).first()[0] or 0) // RANGE_ROWS))
    many = stored(many.repartitionByRange(ranges, "conv_id", "part", *order).withColumn("r", F.spark_partition_id()), "crowded")
    sizes = many.groupBy("conv_id", "part", "r").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id", "part").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("r").alias("q"), before.alias("before"))
    many = many.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "part", "r").orderBy(*order)))
    many = many.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("r") == F.col("q")))
    return few.union(many.select(*turns.columns, F.floor((F.col("before") + F.col("n") - 1) / bound).cast("long").alias("sub")))


def _before(sizes: DataFrame, own: list[str], order: list[str]) -> DataFrame:
    """``before``: the sizes of all rows of ``own`` that come earlier in ``order``, whose columns go from coarse to fine.

    The window of each level is bounded by the one above it; only the coarsest runs over all of ``own``.
    """
    *outer, last = order
    earlier = Window.partitionBy(*own, *outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    if not outer:
        return out
    up = _before(sizes.groupBy(*own, *outer).agg(F.sum("size").alias("size")), own, outer)
    up = up.select(*[F.col(c).alias(f"_{c}") for c in (*own, *outer)], F.col("before").alias("more"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*own, *outer)])
    return out.join(up, same).select(*sizes.columns, (F.col("before") + F.col("more")).alias("before"))


def _starts(seen: DataFrame, conversations: DataFrame, part: Column, part_turns: int) -> DataFrame:
    """``c, s, p, q, start`` of the parts of conversations that have several: the lengths of all parts before."""
    long = conversations.select(F.col("conv_id").alias("l"), part).groupBy("l").agg(F.min("part").alias("a"), F.max("part").alias("z"), F.count(F.lit(1)).alias("n"))
    long = long.filter((F.col("a") < F.col("z")) | (F.col("n") > part_turns)).select("l")
    seen = seen.join(long, F.col("conv_id").eqNullSafe(F.col("l")), "left_semi")
    size = F.length(_header(F.col("role"), F.col("speaker"))) + F.length("said") + len(END)
    sizes = seen.groupBy("conv_id", "speaker", "part", "sub").agg(F.sum(size.cast("long")).alias("size"))
    blocks = sizes.withColumn("parts", F.floor(F.col("part") / BLOCK_PARTS)).withColumn("subs", F.floor(F.col("sub") / BLOCK_PARTS))
    out = _before(blocks, ["conv_id", "speaker"], ["parts", "part", "subs", "sub"])
    return out.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("part").alias("p"), F.col("sub").alias("q"), F.col("before").alias("start"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, speaker, part, sub, start, n_turns, text, mask``; ``mask`` holds [start, end) of what is trained on, in the whole rendering."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role")
    said = _escaped(F.coalesce(F.col("text"), F.lit(""))).alias("said")
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part")
    turns = conversations.select("conv_id", "turn", role, said, part).distinct()
    crowded = conversations.select(F.col("conv_id").alias("c"), part.alias("p")).groupBy("c", "p").count().filter(F.col("count") > part_turns)
    turns = turns.withColumn("sub", F.lit(0).cast("long")) if crowded.isEmpty() else _numbered(turns, stored(crowded, "parts"), part_turns)
    people = conversations.select(F.col("conv_id").alias("c"), role.alias("speaker")).filter("speaker <> 'system'").distinct()
    seen = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    parts = seen.groupBy("conv_id", "speaker", "part", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "said"))).alias("t"))
    starts = _starts(seen, conversations, part, part_turns)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("part") == F.col("p")) & (F.col("sub") == F.col("q"))
    parts = parts.join(starts, same, "left").withColumn("start", F.coalesce("start", F.lit(0)).cast("long"))
    head = lambda x: _header(x["role"], F.col("speaker"))
    parts = parts.withColumn("b", F.transform("t", lambda x: F.concat(head(x), x["said"], F.lit(END))))
    zero = F.array(F.col("start"))
    parts = parts.withColumn("at", F.aggregate("b", zero, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s)))))
    span = F.transform("t", lambda x, i: F.struct((F.get("at", i) + F.length(head(x))).alias("start"), F.get("at", i + 1).alias("end"), (x["role"] == F.col("speaker")).alias("own")))
    mask = F.transform(F.filter(span, lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return parts.select("conv_id", "speaker", "part", "sub", "start", F.size("t").alias("n_turns"), F.array_join("b", "").alias("text"), mask.alias("mask"))


def digest(rendered: DataFrame) -> DataFrame:
    """One row per part: where it starts, its size, the SHA-256 of its text, its masks as text and how many characters they cover."""
    return rendered.select(
        "conv_id",
        "speaker",
        "part",
        "sub",
        "start",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
        F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",").alias("masks"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]).alias("n_masked"),
    )
