"""Labels for lines, from truth headings that may differ by a character or two."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as X
from quire.functions.similarity import (
    LABEL_THRESHOLD, indel_score, length_band, may_exceed, neighbouring_bands,
)
from quire.operators.joins import slab_join
from quire.profiles import BODY


def label_lines(
    lines: DataFrame, truth: DataFrame, threshold: float = LABEL_THRESHOLD, page_offset: int = 0
) -> DataFrame:
    """Lines with the ``label`` of the most similar truth heading of their page, body if none is
    above ``threshold`` percent; of equally similar ones the first.

    ``truth`` has doc, pos, level, text and page; documents without truth keep body labels.
    """
    ratio = threshold / 100
    headings = truth.filter(F.col("text").isNotNull()).select(
        "doc",
        (F.col("page") + page_offset).cast("int").alias("page_number"),
        F.col("pos").alias("truth_pos"),
        F.col("level").alias("truth_level"),
        F.col("text").alias("truth_text"),
        F.explode(neighbouring_bands(F.col("text"), ratio)).alias("band"),
    )
    columns = lines.columns
    pairs = slab_join(
        lines.withColumn("band", length_band(F.col("text"), ratio)),
        headings,
        ["doc", "page_number"],
        "line_no",
        also=["band"],
        condition=may_exceed("text", "truth_text", ratio),
        how="left",
    )
    # Lines without a candidate send no text to the kernel.
    text = F.when(F.col("truth_text").isNotNull(), F.col("text"))
    scored = pairs.withColumn("score", indel_score(text, F.col("truth_text")))
    rank = F.struct("score", (-F.col("truth_pos")).alias("at"), F.col("truth_level").alias("level"))
    best = scored.groupBy("doc", "page_number", "slab", "band", "line_no").agg(
        F.any_value(F.struct(*columns)).alias("line"), F.max(F.when(F.col("score") > threshold, rank)).alias("best")
    )
    return best.select("line.*", F.coalesce("best.level", F.lit(BODY)).alias("label"))


def label_counts(truth: DataFrame) -> DataFrame:
    """Entries per level over all truth documents, plus one Title per document that has one.

    ``truth`` has title, headings and outline, either list null where absent.
    """
    empty = F.array().cast("array<string>")
    levels = F.concat(
        F.when(F.length("title") > 0, F.array(F.lit("Title"))).otherwise(empty),
        *[
            F.coalesce(F.transform(c, lambda h: X.level_name(h["level"])), empty)
            for c in ("headings", "outline")
        ],
    )
    return truth.select(F.explode(levels).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def value_share(rows: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, three digits."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).scalar()
    return counts.withColumn("share", X.half_even(F.col("n") / total, 3))
