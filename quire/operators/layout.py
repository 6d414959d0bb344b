"""Page statistics and neighbour features of a stored table of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as X
from quire.functions.spans import BODY_RANGE, DEFAULT_BODY_SIZE
from quire.operators.blocks import by_block, page_order
from quire.sources.pages import BLANK_GAP


def _size_counts(lines: DataFrame, min_size: float | None) -> DataFrame:
    """Distinct sizes of a page with their number and first line; combined before the shuffle."""
    size = F.col("font_size")
    kept = size if min_size is None else F.when(size > min_size, size)
    return (
        lines.select("doc", "page_number", "line_no", kept.alias("font_size"))
        .groupBy("doc", "page_number", "font_size")
        .agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    )


def _quartiles() -> Column:
    return F.percentile("font_size", F.array(*[F.lit(q) for q in BODY_RANGE]), F.col("n"))


def page_quantiles(lines: DataFrame, min_size: float | None = 4.0) -> DataFrame:
    """Interpolated 25 and 75 percent points of the sizes of each page."""
    q = F.col("q")
    return (
        _size_counts(lines, min_size).groupBy("doc", "page_number").agg(_quartiles().alias("q"))
        .select("doc", "page_number", q[0].alias("q25"), q[1].alias("q75"))
    )


def _ranked(sizes: Column) -> Column:
    return F.array_max(
        F.transform(sizes, lambda s: F.struct(s["n"].alias("n"), (-s["first"]).alias("at"), s["font_size"].alias("size")))
    )["size"]


def body_size(lines: DataFrame, min_size: float | None = 4.0) -> DataFrame:
    """Body size of each page: the first mode inside the middle half of the sizes."""
    found = F.collect_list(F.when(F.col("font_size").isNotNull(), F.struct("font_size", "n", "first")))
    per_page = (
        _size_counts(lines, min_size).groupBy("doc", "page_number")
        .agg(_quartiles().alias("q"), found.alias("sizes"))
    )
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    middle = F.filter("sizes", lambda s: (s["font_size"] >= low) & (s["font_size"] <= high))
    best = F.coalesce(_ranked(middle), _ranked(F.col("sizes")), F.lit(DEFAULT_BODY_SIZE))
    return per_page.select("doc", "page_number", best.alias("body_size"))


def with_body_size(lines: DataFrame, min_size: float | None = 4.0) -> DataFrame:
    """Every line with its page's body size and its size relative to it; one shuffle, no self-join."""
    rows = by_block(lines)
    size = F.col("font_size") if min_size is None else F.when(F.col("font_size") > min_size, F.col("font_size"))
    page = Window.partitionBy("doc", "page_block", "page_number")
    same = Window.partitionBy("doc", "page_block", "page_number", "_size")
    ranked = F.struct(F.col("_n"), -F.col("_first"))
    inside = F.col("_size").between(F.col("_q")[0], F.col("_q")[1])
    best = F.coalesce(
        F.max_by("_size", F.when(inside, ranked)).over(page),
        F.max_by("_size", F.when(F.col("_size").isNotNull(), ranked)).over(page),
        F.lit(DEFAULT_BODY_SIZE),
    )
    return (
        rows.withColumn("_size", size)
        .withColumns({"_n": F.count("_size").over(same), "_first": F.min("line_no").over(same)})
        .withColumn("_q", F.percentile("_size", F.array(*[F.lit(q) for q in BODY_RANGE])).over(page))
        .withColumn("body_size", best)
        .withColumn("relative_font_size", X.relative_size(F.col("font_size"), F.col("body_size")))
        .drop("_size", "_n", "_first", "_q")
    )


def neighbor_features(lines: DataFrame) -> DataFrame:
    """Size differences and blank gaps to the lines before and after on the same page."""
    w = page_order()
    size, top, bottom = F.col("font_size"), F.col("y_position"), F.col("y_bottom")
    size_before = F.coalesce(F.lag("font_size").over(w), size)
    size_after = F.coalesce(F.lead("font_size").over(w), size)
    gap_before = top - F.coalesce(F.lag("y_bottom").over(w), F.lit(0.0))
    gap_after = F.coalesce(F.lead("y_position").over(w), F.col("page_height")) - bottom
    return by_block(lines).withColumns({
        "font_size_diff_prev": size - size_before,
        "is_prev_line_blank": (gap_before > size_before * BLANK_GAP).cast("int"),
        "font_size_diff_next": size - size_after,
        "is_next_line_blank": (gap_after > size * BLANK_GAP).cast("int"),
    })


def align_features(lines: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns a model expects, in its order; features the lines lack become 0."""
    have = set(lines.columns)
    return lines.select(
        *[c for c in keep if c not in columns],
        *[F.col(c) if c in have else F.lit(0).alias(c) for c in columns],
    )
