"""Sections and repeated blocks of prompts whose text is spread over many rows, one per turn.

A conversation of any length stays spread: its turns are never put together in one
row or task. Section tokens are exact all the same, because the character and word
counts behind the token estimate add up over lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger import functions as fn
from promptledger.expressions.blocks import hashed_line
from promptledger.expressions.sections import DYNAMIC, STABLE, line_mark
from promptledger.expressions.text import lines, lower_each, text_size
from promptledger.operators.caching import with_savings
from promptledger.plans.ordered import (
    CHUNK,
    before_chunk,
    continue_from,
    in_chunks,
    windows_ahead,
    within_chunk,
)
from promptledger.plans.storage import stored
from promptledger.settings import DEFAULTS, Thresholds


def _said(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.expr("concat(role, ': ', text)").alias("said"))


def turn_pieces(turns: DataFrame) -> DataFrame:
    """Lines of all turns reduced to label mark and size, without their text.

    A turn appears in its prompt as its role, a colon and the text.
    """
    piece = (
        f"named_struct('turn_line', i, 'low', {lower_each('ln')}, 'size', {text_size('ln')})"
    )
    pieces = F.expr(f"transform({lines('said')}, (ln, i) -> {piece})")
    return _said(turns).select("conv_id", "turn", F.inline(pieces)).select(
        "conv_id",
        "turn",
        "turn_line",
        F.expr(line_mark("low")).alias("mark"),
        "size.non_space",
        "size.words",
    )


def _labelled(turns: DataFrame) -> DataFrame:
    """Lines with line number, label and a flag on lines that open a section."""
    by, order = ["conv_id"], ["turn", "turn_line"]
    lines = in_chunks(turn_pieces(turns), by, order)
    position = F.struct("turn", "turn_line")

    # What a chunk hands on: its last mark and how many lines it has.
    marks = lines.groupBy("conv_id", CHUNK).agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), position)).alias("last_mark"),
        F.count(F.lit(1)).alias("lines"),
    )
    earlier = before_chunk(by)
    carried = marks.select(
        "conv_id",
        CHUNK,
        F.coalesce(F.last("last_mark", ignorenulls=True).over(earlier), F.lit(STABLE)).alias(
            "carried"
        ),
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
    )
    here = within_chunk(by, order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    labelled = continue_from(lines, carried, by).withColumns(
        {
            "type": F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.col("carried")),
            "line": F.col("lines_before") + F.row_number().over(here),
        }
    )
    previous = F.coalesce(F.lag("type").over(here), F.col("carried"))
    return labelled.withColumn("opens", (F.col("type") != previous).cast("bigint"))


def conversation_lines(turns: DataFrame) -> DataFrame:
    """Each line's place in the prompt and its label."""
    return _labelled(turns).select("conv_id", "line", "turn", "turn_line", "type")


def conversation_sections(turns: DataFrame) -> DataFrame:
    """One row per section of each conversation: type, line range and tokens."""
    labelled = _labelled(turns)
    upto = within_chunk(["conv_id"], ["turn", "turn_line"]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    # Sections are first summed inside their chunk, then chunk parts are joined up.
    parts = (
        labelled.withColumn("part", F.sum("opens").over(upto))
        .groupBy("conv_id", CHUNK, "part")
        .agg(
            # A section has one type; as a number it stays in a hash aggregate.
            F.max((F.col("type") == DYNAMIC).cast("int")).alias("dynamic"),
            F.sum("opens").alias("opens"),
            F.min("line").alias("line_start"),
            F.max("line").alias("line_end"),
            F.sum("non_space").alias("non_space"),
            F.sum("words").alias("words"),
        )
    )
    per_chunk = parts.groupBy("conv_id", CHUNK).agg(F.sum("opens").alias("opened"))
    bases = per_chunk.select(
        "conv_id",
        CHUNK,
        F.coalesce(
            F.sum("opened").over(before_chunk(["conv_id"])), F.lit(0)
        ).alias("base"),
    )
    whole = (
        continue_from(parts, bases, ["conv_id"])
        .withColumn("island", F.col("base") + F.col("part"))
        .groupBy("conv_id", "island")
        .agg(
            F.max("dynamic").alias("dynamic"),
            F.min("line_start").alias("line_start"),
            F.max("line_end").alias("line_end"),
            F.sum("non_space").alias("non_space"),
            F.sum("words").alias("words"),
        )
    )
    # A blank-only section can only be the first one, and leaves no other trace.
    return whole.where("non_space > 0").select(
        "conv_id",
        F.when(F.col("dynamic") == 1, DYNAMIC).otherwise(STABLE).alias("type"),
        "line_start",
        "line_end",
        fn.tokens_from("non_space", "words").alias("tokens"),
    )


def conversation_cache(turns: DataFrame) -> DataFrame:
    """Cache analysis per conversation."""
    found = conversation_sections(turns)
    dynamic = F.col("type") == DYNAMIC
    totals = found.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("section_count"),
        F.sum(F.when(dynamic, 0).otherwise(F.col("tokens"))).alias("stable_tokens"),
        F.sum(F.when(dynamic, F.col("tokens")).otherwise(0)).alias("dynamic_tokens"),
        F.coalesce(
            F.min(F.when(dynamic, F.col("line_start")))
            < F.max(F.when(~dynamic, F.col("line_start"))),
            F.lit(False),
        ).alias("reorder_recommended"),
    )
    return with_savings(totals)


def conversation_repeats(turns: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """``(conv_id, first_line, repeat_line)`` for each window of lines that repeats an earlier
    one of its prompt, across turns too.

    Lines are reduced to their words and hashes where they are read; no text travels. A
    window that a long conversation repeats throughout is reduced to its first line before
    the shuffle, and joined back between stored tables, whose hot keys adaptive execution
    splits. Turns whose role or text is null are left out; a null ``conv_id`` is one
    conversation.
    """
    line = f"named_struct('turn_line', i, 'hashed', {hashed_line('ln')})"
    hashed = F.expr(f"transform({lines(lower_each('said'))}, (ln, i) -> {line})")
    rows = _said(turns).select("conv_id", "turn", F.inline(hashed))
    size = thresholds.window_lines
    ahead = windows_ahead(rows, ["conv_id"], ["turn", "turn_line"], F.col("hashed"), size)
    words = F.aggregate("ahead", F.lit(0).cast("bigint"), lambda n, x: n + x["words"])
    whole = ahead.where((F.size("ahead") == size) & (words >= thresholds.window_min_words))
    keyed = whole.select("conv_id", "place", F.inline(F.array(fn.window_of_lines("ahead"))))
    windows = stored(keyed, "prompt-windows")
    first = windows.groupBy("conv_id", "key", "key2").agg(
        F.min("place").alias("first_line"), F.count(F.lit(1)).alias("copies")
    )
    firsts = stored(first.where("copies > 1").withColumnRenamed("conv_id", "of"), "first-windows")
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    for key in ("key", "key2"):
        same &= windows[key] == firsts[key]
    joined = windows.join(firsts, same).where("place > first_line")
    return joined.select("conv_id", "first_line", F.col("place").alias("repeat_line"))
