"""Document order without one task per document.

Lines are clustered by (document, block of pages). Whatever has to run through a whole document is
worked out inside each block, summed up to one row per block, carried over those few rows and
joined back on the key the lines are already clustered by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

#: Lines of this many pages are worked on together: some ten megabytes of text. Even a document of
#: a hundred billion lines then has only a few million block rows.
PAGES_PER_BLOCK = 1024


def by_block(lines: DataFrame) -> DataFrame:
    """Lines clustered by document and page block. What runs on it shuffles no further line rows; each
    plan that starts from unclustered lines shuffles them here once for each of its branches."""
    if "page_block" in lines.columns:
        return lines
    block = F.floor(F.col("page_number") / PAGES_PER_BLOCK).cast("int")
    return lines.withColumn("page_block", block).repartition("doc", "page_block")


def page_order() -> WindowSpec:
    return Window.partitionBy("doc", "page_block", "page_number").orderBy("line_no")


def block_order() -> WindowSpec:
    """Running frame from the start of the block."""
    return (
        Window.partitionBy("doc", "page_block")
        .orderBy("page_number", "line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def document_order() -> WindowSpec:
    """Order of the block rows of a document."""
    return Window.partitionBy("doc").orderBy("page_block")


def carried(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with the columns their block row carries."""
    return lines.join(blocks, ["doc", "page_block"], "left")
