"""Scores of outlines against truth, and of predicted classes against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as X
from quire.functions.similarity import (
    HEADING_THRESHOLD, length_band, may_exceed, neighbouring_bands, ratcliff_near,
)
from quire.operators.joins import slab_join

TRUTH, OUTPUT = "truth", "output"


def heading_list(strict: bool = False) -> Column:
    """First non-empty list of the two dialects; ``strict`` reads only the older one."""
    headings = F.when(F.size("headings") > 0, F.col("headings"))
    none = F.filter(F.coalesce("headings", "outline"), lambda h: F.lit(False))
    return F.coalesce(headings, none) if strict else F.coalesce(headings, F.col("outline"), none)


def heading_keys(outlines: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct (document, level, page, normalised text) with their place in the list.

    ``outlines`` has doc, title, headings and outline as the outline reader returns them.
    """
    h = F.col("h")
    rows = outlines.select("doc", F.posexplode(heading_list(strict)).alias("pos", "h")).select(
        "doc",
        "pos",
        F.upper(h["level"]).alias("level"),
        F.coalesce(h["page_number"], h["page"], F.lit(0)).alias("page"),
        X.normalised(h["text"]).alias("text"),
    )
    return rows.groupBy("doc", "level", "page", "text").agg(F.min("pos").alias("pos"))


def paired_documents(truth: DataFrame, output: DataFrame) -> DataFrame:
    """Documents on both sides."""
    return truth.select("doc").intersect(output.select("doc"))


def match_headings(
    truth_keys: DataFrame, output_keys: DataFrame, threshold: float = HEADING_THRESHOLD, exact: bool = False
) -> DataFrame:
    """Pairs of headings of the same document, level and page that are similar enough; a heading
    may be in several."""
    keys = ["doc", "level", "page"]
    left = output_keys.withColumnRenamed("text", "output_text").withColumnRenamed("pos", "output_pos")
    right = truth_keys.select(*keys, F.col("text").alias("truth_text"))
    if exact:
        return left.withColumn("truth_text", F.col("output_text")).join(right, [*keys, "truth_text"]).select(
            *keys, "truth_text", "output_text"
        )
    pairs = slab_join(
        left.withColumn("band", length_band(F.col("output_text"), threshold)),
        right.withColumn("band", F.explode(neighbouring_bands(F.col("truth_text"), threshold))),
        keys,
        "output_pos",
        also=["band"],
        condition=may_exceed("truth_text", "output_text", threshold),
    )
    near = ratcliff_near(F.col("truth_text"), F.col("output_text"), threshold)
    return pairs.withColumn("near", near).filter("near").select(*keys, "truth_text", "output_text")


def _sided(truth_keys: DataFrame, output_keys: DataFrame) -> DataFrame:
    return truth_keys.withColumn("side", F.lit(TRUTH)).unionByName(output_keys.withColumn("side", F.lit(OUTPUT)))


def _matched(pairs: DataFrame) -> DataFrame:
    """Headings that are in some pair, by side."""
    sides = F.array(
        F.struct(F.lit(TRUTH).alias("side"), F.col("truth_text").alias("text")),
        F.struct(F.lit(OUTPUT).alias("side"), F.col("output_text").alias("text")),
    )
    return pairs.select("doc", "level", "page", F.inline(sides)).distinct()


def heading_diff(
    truth: DataFrame, output: DataFrame, threshold: float = HEADING_THRESHOLD, strict: bool = False,
    exact: bool = False,
) -> DataFrame:
    """Truth headings that were missed and output headings that are extra, by ``side``."""
    both = paired_documents(truth, output)
    truth_keys = heading_keys(truth.join(both, "doc", "left_semi"))
    output_keys = heading_keys(output.join(both, "doc", "left_semi"), strict)
    found = _matched(match_headings(truth_keys, output_keys, threshold, exact))
    return _sided(truth_keys, output_keys).join(
        found, ["doc", "side", "level", "page", "text"], "left_anti"
    ).select("doc", "side", "level", "page", "text")


def title_matches(
    truth: DataFrame, output: DataFrame, threshold: float = HEADING_THRESHOLD, exact: bool = False
) -> DataFrame:
    """Per paired document, whether the titles agree."""
    text = X.normalised(F.coalesce("title", F.lit("")))
    pairs = truth.select("doc", text.alias("truth_title")).join(output.select("doc", text.alias("output_title")), "doc")
    if exact:
        return pairs.select("doc", (F.col("truth_title") == F.col("output_title")).alias("title_correct"))
    near = F.when(may_exceed("truth_title", "output_title", threshold), F.col("truth_title"))
    return pairs.select("doc", ratcliff_near(near, F.col("output_title"), threshold).alias("title_correct"))


def eval_by_document(
    truth: DataFrame, output: DataFrame, threshold: float = HEADING_THRESHOLD, strict: bool = False,
    exact: bool = False,
) -> DataFrame:
    """True positives, false positives and false negatives per document on both sides."""
    titles = title_matches(truth, output, threshold, exact)
    both = titles.select("doc")
    truth_keys = heading_keys(truth.join(both, "doc", "left_semi"))
    output_keys = heading_keys(output.join(both, "doc", "left_semi"), strict)
    found = _matched(match_headings(truth_keys, output_keys, threshold, exact))

    def per_document(rows: DataFrame, kind: str) -> DataFrame:
        return rows.groupBy("doc", "side").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))

    def count(side: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("kind") == kind), F.col("n"))), F.lit(0))

    counts = per_document(_sided(truth_keys, output_keys), "all").unionByName(per_document(found, "found"))
    sums = counts.groupBy("doc").agg(
        count(TRUTH, "found").alias("tp"),
        (count(OUTPUT, "all") - count(OUTPUT, "found")).alias("fp"),
        (count(TRUTH, "all") - count(TRUTH, "found")).alias("fn"),
    )
    return titles.join(sums, "doc", "left").select(
        "doc", "title_correct", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def eval_overall(by_document: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 and title accuracy; the accuracy of no documents is null."""
    sums = by_document.agg(
        F.count("*").alias("documents"),
        F.count(F.when(F.col("title_correct"), 1)).alias("titles_correct"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
    )
    scored = sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumns({
        "f1": ratio(2 * p * r, p + r),
        "title_accuracy": F.try_divide("titles_correct", "documents"),
    })


def confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Count of every (true, predicted) pair of classes, empty ones too, and its share of the true
    class, 0 where no row has that class. Classes are few; rows without one of the two are left out."""
    counts = predictions.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )
    classes = counts.select(F.explode(F.array("label", "predicted")).alias("label")).dropna().distinct()
    every = classes.agg(F.collect_set("label")).scalar()
    cells = classes.withColumn("predicted", F.explode(every)).join(counts, ["label", "predicted"], "left")
    n = F.coalesce("n", F.lit(0))
    row = F.sum(n).over(Window.partitionBy("label"))
    return cells.select(
        "label", "predicted", n.alias("n"), F.when(row > 0, n / row).otherwise(F.lit(0.0)).alias("share")
    )


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cells = predictions.groupBy(
        F.col(label).cast("string").alias("label"), F.col(predicted).cast("string").alias("predicted")
    ).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")),
    )))
    p, r = F.col("precision"), F.col("recall")
    classes = (
        sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "chosen")])
        .withColumns({"precision": ratio(F.col("hit"), F.col("chosen")), "recall": ratio(F.col("hit"), F.col("support"))})
        .withColumn("f1", ratio(2 * p * r, p + r))
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), total)

    accuracy = ratio(F.sum("hit"), total)
    summary = classes.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in measures], total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in measures], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *[weighted(c).alias(c) for c in measures], total.alias("support")),
        ).alias("rows")
    ).select(F.inline("rows"))
    return classes.select("class", *measures, "support").unionByName(summary)
