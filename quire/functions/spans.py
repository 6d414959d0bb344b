"""Column expressions over the spans and lines held inside one page row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Body size without any usable size, percentile range, bold flag bit, no-span font.
DEFAULT_BODY_SIZE = 12.0
BODY_RANGE = (0.25, 0.75)
BOLD_FLAG = 16
NO_FONT = "N/A"


def first_mode(values: Column) -> Column:
    """Most common value; of equally common ones the first in the array. Null if it is empty."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v, i: F.struct(
            F.size(F.filter(values, lambda w: w == v)).alias("n"), (-i).alias("first"), v.alias("value")
        ),
    )
    return F.array_max(counted)["value"]


def line_size(sizes: Column) -> Column:
    return F.coalesce(first_mode(sizes), F.lit(0.0))


def line_font(fonts: Column) -> Column:
    return F.coalesce(first_mode(fonts), F.lit(NO_FONT))


def name_is_bold(font: Column) -> Column:
    return F.coalesce(F.contains(F.lower(font), F.lit("bold")), F.lit(False))


def is_bold(spans: Column) -> Column:
    """Any span with "bold" in its font name or the bold flag set."""
    return F.exists(
        spans,
        lambda s: name_is_bold(s["font"])
        | (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(F.lit(BOLD_FLAG)) != 0),
    ).cast("int")


def quantile(ordered: Column, q: Column) -> Column:
    """Linearly interpolated quantile of a sorted array; null if it is empty."""
    place = (F.size(ordered) - 1) * q
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.ceil(place).cast("int"))
    return F.when(below == above, below).otherwise(below + (above - below) * (place - low))


def with_body_size(rows: DataFrame, sizes: Column) -> DataFrame:
    """Adds ``body_size``: first mode of the sizes inside the middle half, of all if none is there.

    Each step is a column of its own that the next one reads more than once, which keeps the
    optimizer from moving it into the per-element lambdas.
    """
    low, high = F.get("_range", F.lit(0)), F.get("_range", F.lit(1))
    staged = (
        rows.withColumn("_sizes", sizes)
        .withColumn("_ordered", F.array_sort("_sizes"))
        .withColumn(
            "_range",
            F.transform(F.array(*[F.lit(q) for q in BODY_RANGE]), lambda q: quantile(F.col("_ordered"), q)),
        )
        .withColumn("_middle", F.filter("_sizes", lambda s: (s >= low) & (s <= high)))
        .withColumn(
            "body_size",
            F.coalesce(first_mode(F.col("_middle")), first_mode(F.col("_sizes")), F.lit(DEFAULT_BODY_SIZE)),
        )
    )
    return staged.drop("_sizes", "_ordered", "_range", "_middle")
