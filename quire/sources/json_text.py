"""JSON text with a place for what cannot be parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BAD_RECORD = "_corrupt_record"


def parsed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON strings in ``value`` as columns; what cannot be parsed is kept in ``_corrupt_record``.

    Parsed as an expression rather than by the reader, whose verdict on a record depends on the
    columns a query happens to select.
    """
    with_bad = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD}
    kept = [c for c in text.columns if c != "value"]
    return text.withColumn("_json", F.from_json("value", with_bad, options)).select(*kept, "_json.*")


def source_file() -> Column:
    """Name of the file a row comes from; Spark gives it percent-encoded."""
    return F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_json_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per file, with the file's name."""
    text = spark.read.text(path, wholetext=True).select("value", source_file().alias("file"))
    return parsed(text, schema)
