"""Level clamp, repeated headings, titles and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as X
from quire.operators.blocks import block_order, by_block, carried, document_order, page_order
from quire.profiles import BODY, TITLE

# Fixed value: title of a document that shows none.
UNTITLED = "Untitled Document"


def is_heading() -> Column:
    return F.col("level").startswith("H")


def clamp_levels(scored: DataFrame) -> DataFrame:
    """A heading lies at most one level below the heading before it; a title starts over.

    With c the raw levels after the last title, the n-th heading gets n + min(h, min_j (c_j - j)),
    h being the level reached before the block, 0 after a title. The same form, over block rows,
    gives h.
    """
    w = block_order()
    titled = F.col("level") == TITLE
    lines = (
        by_block(scored)
        .withColumn("_raw", F.when(is_heading(), X.level_number(F.col("level"))))
        .withColumns({"_run": F.sum(titled.cast("int")).over(w), "_all": F.count("_raw").over(w)})
        .withColumn("_n", F.col("_all") - F.coalesce(F.max(F.when(titled, F.col("_all"))).over(w), F.lit(0)))
        .withColumn("_low", _lowest(F.col("_run"), F.col("_raw") - F.col("_n"), w))
    )
    blocks = _levels_reached(
        lines.groupBy("doc", "page_block").agg(
            F.max_by(F.struct("_run", "_n", "_low"), F.struct("page_number", "line_no")).alias("last")
        )
    )
    before = F.when(F.col("_run") == 0, F.col("_before")).otherwise(F.lit(0))
    clamped = F.concat(F.lit("H"), (F.col("_n") + F.least(before, F.col("_low"))).cast("string"))
    return (
        carried(lines, blocks)
        .withColumn("level", F.when(F.col("_raw").isNotNull(), clamped).otherwise(F.col("level")))
        .drop("_raw", "_run", "_all", "_n", "_low", "_before")
    )


def _lowest(run: Column, value: Column, w) -> Column:
    """Running minimum of ``value`` since ``run`` last went up; null before its first value."""
    lowest = F.min(F.when(value.isNotNull(), F.struct((-run).alias("run"), value.alias("value")))).over(w)
    return F.when(lowest["run"] == -run, lowest["value"])


def _levels_reached(blocks: DataFrame) -> DataFrame:
    w = document_order()
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, titled = F.col("last._n"), F.col("last._run") > 0
    bound = n + F.col("last._low")
    return (
        blocks.withColumns({"_run": F.sum(titled.cast("int")).over(running), "_sum": F.sum(n).over(running)})
        .withColumn("_sum", F.col("_sum") - F.coalesce(F.max(F.when(titled, F.col("_sum") - n)).over(running), F.lit(0)))
        .withColumn("_low", _lowest(F.col("_run"), bound - F.col("_sum"), running))
        .withColumn("_level", F.col("_sum") + F.least(F.lit(0), F.col("_low")))
        .withColumn("_before", F.coalesce(F.lag("_level").over(w), F.lit(0)))
        .select("doc", "page_block", "_before")
    )


def flag_adjacent_duplicates(scored: DataFrame) -> DataFrame:
    """Adds ``is_repeat``: a heading or title with the text of the line just before it on its page."""
    text = F.lower("text")
    same = text == F.lag(text).over(page_order())
    return by_block(scored).withColumn("is_repeat", F.coalesce(same, F.lit(False)) & (F.col("level") != BODY))


def drop_adjacent_duplicates(scored: DataFrame) -> DataFrame:
    return flag_adjacent_duplicates(scored).filter(~F.col("is_repeat")).drop("is_repeat")


def _first_title() -> Column:
    """Position and text of the first classified title that is not a repeat."""
    shown = (F.col("level") == TITLE) & ~F.col("is_repeat")
    return F.min(F.when(shown, F.struct("page_number", "line_no", "text")))


def _largest_line() -> Column:
    """Largest line of page 1 that is not a number, the first of equally large ones."""
    fits = (F.col("page_number") == 1) & ~X.is_digits(F.col("text"))
    return F.max(F.when(fits, F.struct("font_size", (-F.col("line_no")).alias("at"), "text")))


def titles(flagged: DataFrame) -> DataFrame:
    """Title per document: the first classified one, else the largest line of page 1."""
    found = flagged.groupBy("doc").agg(_first_title().alias("first"), _largest_line().alias("largest"))
    return found.select("doc", F.coalesce("first.text", "largest.text", F.lit(UNTITLED)).alias("title"))


def outline_entries(flagged: DataFrame) -> DataFrame:
    """Headings of the outline, one row each."""
    return flagged.filter(is_heading() & ~F.col("is_repeat")).select(
        "doc", "page_number", "line_no", "level", "text"
    )


def outlines(flagged: DataFrame) -> DataFrame:
    """Title and ordered headings per document, one row each."""
    entry = F.struct("page_number", "line_no", "level", "text")
    listed = is_heading() & ~F.col("is_repeat")
    found = flagged.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.when(listed, entry))).alias("entries"),
        _first_title().alias("first"),
        _largest_line().alias("largest"),
    )
    return found.select(
        "doc",
        F.coalesce("first.text", "largest.text", F.lit(UNTITLED)).alias("title"),
        F.transform(
            "entries",
            lambda e: F.struct(e["level"].alias("level"), e["text"].alias("text"), e["page_number"].alias("page")),
        ).alias("outline"),
    )
