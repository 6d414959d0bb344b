"""Document fingerprints by winnowing, as DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.batches import NO_ID, known

#: A text is cut into units: runs without blanks, in stretches of at most four characters. Copies
#: that start elsewhere in a longer run are cut elsewhere; dense fingerprints have no such bound.
UNIT = r"[^\x20\x09-\x0D]{1,4}"

#: Units of a gram, and grams of a window (a power of two). Texts that share a stretch of
#: ``GRAM + WINDOW - 1`` units, cut alike, share a fingerprint entry of it.
GRAM, WINDOW = 3, 16

#: Characters of a gram and grams of a window (both powers of two) where grams are taken at every
#: character. Texts whose blank-free forms share a stretch of ``CHARACTERS + REACH - 1`` characters
#: share an entry of it, wherever it starts in them.
CHARACTERS, REACH = 8, 32

BLANKS = r"[\x20\x09-\x0D]+"

#: Rows of a bucket of neighbouring ids, and the most buckets.
BUCKET, MOST_BUCKETS = 512, 16_384


def with_units(docs: DataFrame, text: str, units: str) -> DataFrame:
    return docs.withColumn(units, F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)))


def with_fingerprint(docs: DataFrame, text: str, marks: str) -> DataFrame:
    """``docs`` with ``marks``: the winnowed grams of a text, in order, each a long whose upper half
    is the gram's hash and whose lower half counts the place down from 2^32 - 1.

    All grams are hashed. Of every ``WINDOW`` grams in a row, and of the first 1, 2, ... of a text,
    the one with the least hash is kept, the rightmost of those; the lower half makes it the
    least long. A text of fewer than ``GRAM`` units is one gram, one without any has no marks.
    """
    u, h = f"_{marks}_u", f"_{marks}_h"
    docs = with_units(docs, text, u)
    grams = F.transform(
        F.slice(F.col(u), F.lit(1), F.greatest(F.size(u) - (GRAM - 1), F.least(F.size(u), F.lit(1)))),
        lambda unit, i: F.shiftleft(
            F.hash(unit, *[F.get(F.col(u), i + ahead) for ahead in range(1, GRAM)]).cast("long"), 32
        ).bitwiseOR(F.lit(2**32 - 1) - i),
    )
    docs = docs.withColumn(h, grams).drop(u)
    reach = 1
    while reach < WINDOW:  # the least of twice as many, from that of so many and of as many before
        ahead = F.concat(F.array_repeat(F.lit(None).cast("long"), reach), F.col(h))
        docs = docs.withColumn(h, F.zip_with(h, F.slice(ahead, F.lit(1), F.size(h)), lambda a, b: F.least(a, b)))
        reach *= 2
    return docs.withColumn(marks, F.array_distinct(h)).drop(h)


def with_dense_fingerprint(docs: DataFrame, text: str, marks: str) -> DataFrame:
    """``docs`` with ``marks`` like those of ``with_fingerprint``, but of a gram of ``CHARACTERS`` code
    points at every code point of the text without its blanks; places count these code points.

    Unlike units, which count from the start of a run, such grams don't depend on where a shared
    stretch starts in its run. A text of fewer than ``CHARACTERS`` code points is one gram.
    """
    u, h, n = f"_{marks}_u", f"_{marks}_h", f"_{marks}_n"
    docs = docs.withColumn(u, F.regexp_replace(F.col(text), BLANKS, "")).withColumn(n, F.length(u))
    docs = docs.withColumn(h, F.split(u, "")).drop(u)  # an empty text gives one empty string, cut off by n
    reach = 1
    while reach < CHARACTERS // 2:  # the hash of twice as many, from that of so many and of as many behind
        behind = F.slice(F.col(h), F.lit(reach + 1), F.col(n))
        docs = docs.withColumn(h, F.zip_with(h, behind, lambda a, b: F.hash(a, b)))
        reach *= 2
    docs = docs.withColumnRenamed(h, u)
    grams = F.greatest(F.col(n) - (CHARACTERS - 1), F.least(F.col(n), F.lit(1)))
    docs = docs.withColumn(h, F.transform(
        F.slice(F.col(u), F.lit(1), grams),
        lambda half, i: F.shiftleft(F.hash(half, F.get(F.col(u), i + reach)).cast("long"), 32)
        .bitwiseOR(F.lit(2**32 - 1) - i),
    )).drop(u).withColumn(n, grams)
    reach = 1
    while reach < REACH:  # as in with_fingerprint; what windows beyond the end keep is cut off below
        ahead = F.concat(F.array_repeat(F.lit(None).cast("long"), reach), F.col(h))
        docs = docs.withColumn(h, F.zip_with(h, ahead, lambda a, b: F.least(a, b)))
        reach *= 2
    return docs.withColumn(marks, F.array_distinct(F.slice(F.col(h), F.lit(1), F.col(n)))).drop(h, n)


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda mark: F.shiftright(mark, 32).cast("int")))


def places(marks: Column) -> Column:
    """The places of the marks' grams, in units (or characters) from the start of the text."""
    return F.transform(marks, lambda mark: F.lit(2**32 - 1) - mark.bitwiseAND(F.lit(2**32 - 1)))


def shown(marks: Column) -> Column:
    """The marks as a string: ``hash@place`` in hexadecimal, joined by commas."""
    return F.array_join(F.transform(marks, lambda mark: F.concat(
        F.lower(F.hex(F.shiftrightunsigned(mark, 32))), F.lit("@"),
        F.lower(F.hex(F.lit(2**32 - 1) - mark.bitwiseAND(F.lit(2**32 - 1)))),
    )), ",")


def likeness(one: Column, other: Column) -> Column:
    """The Jaccard similarity of the sets of hashes; two empty ones are the same."""
    union = F.size(F.array_union(one, other))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(one, other)) / union)


def with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    fingerprint: Callable[[DataFrame, str, str], DataFrame] = with_fingerprint,
) -> DataFrame:
    """``doc_id`` and ``text`` of every row (null texts empty) with its ``marks`` and those and the
    text of the next row, ``next_text`` and ``next_marks``, by descending id; after the last comes
    the first. ``fingerprint`` makes the marks.

    Rows with one id are in order of their texts, null ids are the smallest. Ids are cut into
    buckets of about ``BUCKET`` neighbours by their quantiles (at most ``MOST_BUCKETS``, which are
    the numbers the driver holds); texts are shuffled once, by bucket. The last row of a bucket
    gets the first of the next bucket that has any, joined on the bucket.
    """
    own = docs.select(known(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = docs.count()
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET))
    cuts = [at / buckets for at in range(1, buckets)]
    edges = sorted(set(own.agg(F.percentile_approx("doc_id", cuts, 100_000)).first()[0] or [])) if cuts and rows else []
    own = own.withColumn("bucket", _bucket(F.col("doc_id"), edges))
    ordered = W.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("text"))
    own = own.withColumn("next_text", F.lead("text").over(ordered))
    own = fingerprint(own, "text", "marks").withColumn("next_marks", F.lead("marks").over(ordered))
    tops = (
        docs.select(known(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("bucket", _bucket(F.col("doc_id"), edges))
    )
    most = tops.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    follow = W.orderBy(F.desc("bucket"))
    # One row for each bucket: which bucket comes after it, and that one's first row.
    after = most.select(
        "bucket", F.coalesce(F.lead("doc_id").over(follow), F.max("doc_id").over(W.partitionBy())).alias("top")
    )
    first = (
        tops.select("doc_id", "text").join(F.broadcast(after.select(F.col("top").alias("doc_id"), F.col("bucket").alias("of"))), "doc_id")
        .groupBy("of").agg(F.max("text").alias("first_text"))
    )
    first = fingerprint(first, "first_text", "first_marks")
    joined = own.join(first, own["bucket"] == first["of"], "left")
    return joined.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "marks",
        F.coalesce("next_text", "first_text").alias("next_text"),
        F.coalesce("next_marks", "first_marks").alias("next_marks"),
    )


def _bucket(doc_id: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are below the id."""
    if not edges:
        return F.lit(0)
    table = F.lit(edges)
    steps = F.lit([1 << at for at in reversed(range(len(edges).bit_length()))])
    # A binary search, in steps that halve.
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(
        (found + step <= len(edges)) & (F.get(table, found + step - 1) < doc_id), found + step
    ).otherwise(found))
