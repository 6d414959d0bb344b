"""Synthetic invitation records and their constant truth outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import text as X

# Number of records and the pools their fields are drawn from.
RECORDS = 50
FIRST_NAMES = ["Liam", "Olivia", "Noah", "Emma", "Oliver", "Ava", "Elijah", "Charlotte", "William", "Sophia"]
REASONS = ["Birthday", "Team Victory", "Graduation", "End of School Year", "Welcome Home"]
VENUES = [
    ("SKY HIGH TRAMPOLINE ARENA", "123 Main Street", "Phoenix, AZ 85001"),
    ("GRAVITY ZONE PARK", "456 Oak Avenue", "Austin, TX 78701"),
    ("JUMP FUSION", "789 Pine Lane", "Denver, CO 80202"),
    ("AERIAL FUN CENTER", "101 Maple Drive", "Miami, FL 33101"),
    ("BOUNCE WORLD", "212 Birch Road", "Seattle, WA 98101"),
]
CONTACTS = [("Jennifer", "555-0101"), ("Mike", "555-0102"), ("Sarah", "555-0103"), ("David", "555-0104")]
# Days ahead, opening hours, minutes, reply time.
DAYS_AHEAD = (14, 90)
HOURS = (10, 19)
MINUTES = [0, 15, 30, 45]
REPLY_DAYS = 7
# Fixed value: the truth outline every record comes with.
TRUTH = ("", [("H1", "HOPE To SEE You THERE! ", 0)])


def draw(key: Column, salt: str, size: int) -> Column:
    """Even pick from 0 to ``size`` - 1 that only depends on key and salt."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def _pick(key: Column, salt: str, pool: list) -> Column:
    """Element of a pool; of a pool of tuples, a struct with fields f0, f1 and so on."""
    def literal(value):
        if isinstance(value, tuple):
            return F.struct(*[F.lit(v).alias(f"f{i}") for i, v in enumerate(value)])
        return F.lit(value)
    return F.get(F.array(*[literal(v) for v in pool]), draw(key, salt, len(pool)))


def synth_records(ids: DataFrame, base_date: str, id_col: str = "id", seed: int = 42) -> DataFrame:
    """One record per id; the same id, date and seed always give the same record."""
    key = F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))
    today = F.lit(base_date).cast("date")
    span = DAYS_AHEAD[1] - DAYS_AHEAD[0] + 1
    drawn = ids.select(
        F.col(id_col).alias("id"),
        _pick(key, "venue", VENUES).alias("venue"),
        _pick(key, "contact", CONTACTS).alias("contact"),
        _pick(key, "name", FIRST_NAMES).alias("name"),
        _pick(key, "reason", REASONS).alias("reason"),
        F.date_add(today, draw(key, "day", span) + DAYS_AHEAD[0]).alias("day"),
        (draw(key, "hour", HOURS[1] - HOURS[0] + 1) + HOURS[0]).alias("hour"),
        _pick(key, "minute", MINUTES).alias("minute"),
    )
    # Only the time of day is shown; the day is any without a clock change.
    moment = F.make_timestamp(F.lit(2000), F.lit(1), F.lit(3), "hour", "minute", F.lit(0))
    return drawn.select(
        "id",
        F.col("venue.f0").alias("venue_name"),
        F.concat("name", F.lit("'s "), "reason", F.lit(" Party")).alias("for_person"),
        X.long_date(F.col("day")).alias("date"),
        X.clock(moment).alias("time"),
        F.col("venue.f1").alias("address_l1"),
        F.col("venue.f2").alias("address_l2"),
        F.concat(
            F.lit("by "), X.month_day(F.date_add(today, REPLY_DAYS)), F.lit(" to "), F.col("contact.f0"), F.lit(" at "),
            F.col("contact.f1"),
        ).alias("rsvp"),
    )


def numbered_records(spark: SparkSession, n: int = RECORDS, *, base_date: str, seed: int = 42) -> DataFrame:
    return synth_records(spark.range(1, n + 1), base_date, seed=seed)


def record_truth(records: DataFrame) -> DataFrame:
    """The constant truth outline of each record."""
    title, entries = TRUTH
    outline = F.array(*[
        F.struct(F.lit(l).alias("level"), F.lit(t).alias("text"), F.lit(p).alias("page")) for l, t, p in entries
    ])
    return records.select(F.col("id").cast("string").alias("doc"), F.lit(title).alias("title"), outline.alias("outline"))
