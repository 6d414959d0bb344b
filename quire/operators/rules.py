"""Clean-up rules that turn unlikely headings back into body lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as X
from quire.profiles import BODY, LEVEL_CONFIDENCE, OUTLINE_PROFILE, Profile


def low_confidence() -> Column:
    least = F.create_map(*[F.lit(v) for pair in LEVEL_CONFIDENCE.items() for v in pair])
    return F.coalesce(F.col("confidence") < least[F.col("level")], F.lit(False))


def rejected(profile: Profile) -> Column:
    """Text or size of the line rules it out as a heading. Cheap tests come first, so patterns are
    only tried on short lines."""
    text, words = F.col("text"), F.col("word_count")
    rules = words > profile.max_words
    if profile.min_words:
        rules = rules | ((words < profile.min_words) & ~text.rlike(X.LEADING_DIGIT))
    if profile.reject_trailing_dot:
        rules = rules | text.endswith(".")
    if profile.generic_names:
        rules = rules | F.lower(text).isin(*profile.generic_names)
    if profile.max_digits is not None:
        rules = rules | ((F.length(text) <= profile.max_digits) & X.is_digits(text))
    else:
        rules = rules | X.is_digits(text)
    return rules | text.rlike(X.any_pattern(profile.reject_patterns))


def demote(scored: DataFrame, profile: Profile = OUTLINE_PROFILE) -> DataFrame:
    """Scored lines after the rules. Every rule only ever sets the body level, so their order does
    not matter and one expression holds them all. Lines without a classifier's confidence are
    all body."""
    if "confidence" not in scored.columns:
        return scored.withColumn("level", F.lit(BODY))
    level = F.col("level")
    out = (level != BODY) & (low_confidence() | rejected(profile))
    return scored.withColumn("level", F.when(out, F.lit(BODY)).otherwise(level))
