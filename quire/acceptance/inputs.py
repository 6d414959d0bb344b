"""Inputs of the acceptance queries, derived from the test tables.

Plain text gets a layout that follows from the text alone, so an SQL oracle can restate it: forty
lines a page, font size, level and confidence from the number of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire import schemas
from quire.operators import outline, rules, sections
from quire.profiles import SECTION_PROFILE
from quire.session import settled
from quire.sources import outline_files, pages

# Layout of the fixture.
LEVELS = ["Body", "H1", "Body", "H2", "Body", "H3", "Title"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def font_size(text: Column) -> Column:
    return F.lit(8.0) + (F.length(text) % 5) * 1.5


def text_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.pages_from_text(table(spark, folder, "documents"), "doc_id", "text", font_size)


def plain_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pages.lines_from_pages(text_pages(spark, folder))


def with_level(lines: DataFrame) -> DataFrame:
    n = F.length("text")
    return lines.withColumns({
        "level": F.get(F.array(*[F.lit(l) for l in LEVELS]), n % 7),
        "confidence": F.lit(0.5) + (n % 11) * 0.05,
    })


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    return with_level(pages.text_features(plain_lines(spark, folder)))


def cleaned_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines after rules and clamp, repeats flagged."""
    scored = settled(scored_lines(spark, folder))
    return outline.flag_adjacent_duplicates(outline.clamp_levels(rules.demote(scored)))


def found_outlines(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outlines(cleaned_lines(spark, folder))


def found_sections(spark: SparkSession, folder: str) -> DataFrame:
    return sections.sections(rules.demote(settled(scored_lines(spark, folder)), SECTION_PROFILE))


def page_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Page trees of the documents: a span per word, blocks in reverse order, an image on each page."""

    def span(word: Column, i: Column, last: Column) -> Column:
        n = F.length(word)
        left = i * 7.5
        return F.struct(
            F.when(i < last, F.concat(word, F.lit(" "))).otherwise(word).alias("text"),
            (8.0 + (n % 3) * 1.5).alias("size"),
            F.when(n % 2 == 0, "Times-Bold").otherwise("Times").alias("font"),
            F.when(n % 5 == 0, 16).otherwise(0).alias("flags"),
            F.array(left, F.lit(0.0), left + 7.0, F.lit(0.0)).alias("bbox"),
        )

    def block(found: Column) -> Column:
        line, words = found["line"], found["words"]
        box = F.array(line["x_position"], line["y_position"], F.lit(500.0), line["y_bottom"])
        spans = F.transform(words, lambda w, i: span(w, i, F.size(words) - 1))
        return F.struct(
            F.lit(0).alias("type"), box.alias("bbox"),
            F.array(F.struct(box.alias("bbox"), spans.alias("spans"))).alias("lines"),
        )

    block_type = schemas.BLOCK
    image = F.struct(
        F.lit(1).alias("type"), F.array(*[F.lit(0.0)] * 4).alias("bbox"),
        F.lit(None).cast(block_type["lines"].dataType).alias("lines"),
    )
    split = F.transform("lines", lambda l: F.struct(l.alias("line"), F.split(l["text"], " ", -1).alias("words")))
    text_blocks = F.transform(F.reverse(split), block)
    return text_pages(spark, folder).select(
        "doc", "page_number", "page_height",
        F.concat(F.array(image), text_blocks).cast(schemas.PAGE_TREE["blocks"].dataType).alias("blocks"),
    )


def truth_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Truth entries of the labelled documents: headings before any rule, every fifth line with
    another character in its middle, of the rest a third short of the last character and a third with
    blanks around."""
    labelled = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("doc"))
    lines = with_level(plain_lines(spark, folder)).filter(F.col("level").startswith("H"))
    turn = F.col("line_no") % 3
    text = (
        F.when(F.col("line_no") % 5 == 2, F.expr("concat(left(text, length(text) div 2), '#', substr(text, length(text) div 2 + 2))"))
        .when(turn == 0, F.col("text"))
        .when(turn == 1, F.expr("left(text, length(text) - 1)"))
        .otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    )
    kept = lines.join(labelled, "doc", "left_semi")
    return kept.select(
        "doc",
        ((F.col("page_number") - 1) * 40 + F.col("line_no")).alias("pos"),
        "level",
        text.alias("text"),
        F.col("page_number").alias("page"),
    )


def truth_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """The same entries as outline objects, with the first title line as title."""
    labelled = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("doc"))
    entry = schemas.OUTLINE_FILE["outline"].dataType
    listed = F.array_sort(F.collect_list(F.struct("pos", "level", "text", "page")))
    entries = truth_headings(spark, folder).groupBy("doc").agg(
        F.transform(
            listed,
            lambda e: F.struct(
                e["level"].alias("level"), e["text"].alias("text"), e["page"].cast("int").alias("page"),
                F.lit(None).cast("int").alias("page_number"),
            ),
        ).alias("outline")
    )
    titles = with_level(plain_lines(spark, folder)).groupBy("doc").agg(
        F.min(F.when(F.col("level") == "Title", F.struct("page_number", "line_no", "text")))["text"].alias("title")
    )
    return labelled.join(titles, "doc", "left").join(entries, "doc", "left").select(
        "doc", F.coalesce("title", F.lit("")).alias("title"),
        F.lit(None).cast(entry).alias("headings"), F.col("outline").cast(entry).alias("outline"),
    )


def output_outlines(spark: SparkSession, folder: str) -> DataFrame:
    return outline_files.as_outline_files(found_outlines(spark, folder))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as requests. Every document belongs to one conversation, whose requests list it."""
    turns = table(spark, folder, "conversations")
    n = turns.agg(F.max("conv_id") + 1).scalar()
    listed = (
        table(spark, folder, "documents")
        .select((F.col("doc_id") % n).alias("conv_id"), F.col("doc_id").cast("string").alias("filename"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("filename", F.col("filename").alias("title")))).alias("documents"))
    )
    return turns.filter((F.col("role") == "user") & (F.length("text") > 0)).join(listed, "conv_id").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.col("role").alias("persona"),
        F.col("text").alias("task"),
        "documents",
    )


def vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, sections, listed): vectors as sections of the document their label names; each
    label asks with the mean of its vectors and lists itself and the next two labels."""
    rows = table(spark, folder, "embeddings")
    found = rows.select(
        F.col("label").cast("string").alias("document"), F.col("vec_id").cast("int").alias("section_no"),
        "embedding",
    )
    means = rows.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    asked = means.groupBy(F.col("label").cast("string").alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding")
    )
    n = rows.agg(F.max("label") + 1).scalar()
    listed = rows.select("label").distinct().select(
        F.col("label").cast("string").alias("request_id"),
        F.explode(F.array(*[((F.col("label") + i) % n).cast("string") for i in range(3)])).alias("document"),
    )
    return asked, found, listed


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as rows of the classifier: text, layout numbers and a class of quality
    and toxicity."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    rows = docs.join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id",
        "text",
        F.col("source").alias("font_name"),
        font_size(F.col("text")).alias("font_size"),
        F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("label"),
    )
    zeros = ["is_bold", "x_position", "y_position", "relative_font_size", "font_size_diff_prev", "is_prev_line_blank",
             "font_size_diff_next", "is_next_line_blank"]
    return pages.text_features(rows).withColumns({c: F.lit(0) for c in zeros})
