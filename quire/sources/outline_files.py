"""Outline JSON, one object per document, in either dialect and in files of one or of many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quire import schemas
from quire.functions import text as X
from quire.sources.json_text import BAD_RECORD, parsed
from quire.sources.objects import read_objects
from quire.sources.object_files import OneFileEach


def read_outlines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(outlines keyed by document, records that could not be read).

    A document's name is its ``doc`` field or, where an object is all that its file holds, the file's
    stem. Files may hold many objects, on a line each or over many; see ``read_objects``. One that
    can't be read, or has no name, comes back as a record with its file and costs no other.
    """
    objects = read_objects(spark, path).withColumn("record", F.col("value"))
    schema = T.StructType([T.StructField("doc", T.StringType()), *schemas.OUTLINE_FILE.fields])
    named = F.coalesce("doc", F.when(F.col("whole"), X.file_stem(F.col("file"))))
    raw = parsed(objects, schema).withColumn("doc", named)
    good = F.col(BAD_RECORD).isNull() & F.col("doc").isNotNull()
    return raw.filter(good).select("doc", *schemas.OUTLINE_FILE.fieldNames()), raw.filter(~good).select("file", "record")


def truth_entries(outlines: DataFrame, label_title: bool = False) -> DataFrame:
    """Outline entries as rows for labelling, the title as one more on request."""
    entries = outlines.select("doc", F.posexplode("outline").alias("pos", "h")).select(
        "doc", "pos", F.col("h.level").alias("level"), F.col("h.text").alias("text"),
        F.coalesce("h.page", "h.page_number").alias("page"),
    )
    if not label_title:
        return entries
    title = outlines.filter(F.length("title") > 0).select(
        "doc", F.lit(-1).alias("pos"), F.lit("Title").alias("level"), F.col("title").alias("text"), F.lit(1).alias("page")
    )
    return entries.unionByName(title)


def as_outline_files(outlines: DataFrame) -> DataFrame:
    """Outlines of this library in the shape the reader returns."""
    entry = schemas.OUTLINE_FILE["outline"].dataType
    listed = F.transform(
        "outline",
        lambda e: F.struct(
            e["level"].alias("level"), e["text"].alias("text"), e["page"].alias("page"),
            F.lit(None).cast("int").alias("page_number"),
        ),
    )
    return outlines.select("doc", "title", F.lit(None).cast(entry).alias("headings"), listed.cast(entry).alias("outline"))


def outline_json(outlines: DataFrame) -> DataFrame:
    """The JSON object of each document, characters of any script kept."""
    return outlines.select("doc", F.to_json(F.struct("title", "outline")).alias("json"))


def write_outlines(outlines: DataFrame, path: str) -> None:
    """JSON lines, one object per document with its name."""
    outlines.select("doc", "title", "outline").write.mode("overwrite").json(path)


def write_outline_files(outlines: DataFrame, path: str) -> None:
    """A file ``<doc>.json`` for each document, with its title and outline; see ``OneFileEach`` for
    names that can't be a file's. Such objects hold the name as ``doc``, so that it is read back."""
    outlines.sparkSession.dataSource.register(OneFileEach)
    named = F.struct("doc", "title", "outline")
    plain = F.struct("title", "outline")
    text = F.when(F.col("doc").rlike(OneFileEach.PLAIN), F.to_json(plain)).otherwise(F.to_json(named))
    outlines.select(F.col("doc").alias("name"), text.alias("value")).write.format(OneFileEach.name()).mode("overwrite").save(path)
