"""Labelled line features as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire import schemas

_QUOTING = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_labelled(lines: DataFrame, path: str) -> None:
    """Features and label, the document dropped; blanks at the ends of texts are kept."""
    rows = lines.select(*schemas.LABELLED_LINE.fieldNames())
    rows.write.mode("overwrite").options(**_QUOTING).csv(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled lines with null text and font names read as empty."""
    return spark.read.schema(schemas.LABELLED_LINE).options(**_QUOTING, multiLine=True).csv(path).fillna(
        {"text": "", "font_name": ""}
    )
