"""Column expressions over text: all JVM-side, none of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The characters Python treats as white space, as a string and as a regex class body
# that Java and RE2 read alike.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# C0 and C1 control characters.
CONTROL_CLASS = r"\x00-\x1f\x7f-\x{9f}"
# Digits that are not decimal digits (superscripts, circled and the like).
OTHER_DIGIT_CLASS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
WORD_CLASS = r"\p{L}\p{N}_"

DIGITS_ONLY = rf"^[\p{{Nd}}{OTHER_DIGIT_CLASS}]+\z"
#: "1", "2.3" and so on, not running into a word.
NUMBERED = rf"^[{SPACE_CLASS}]*\p{{Nd}}+(\.\p{{Nd}}+)*(?![{WORD_CLASS}])"
LEADING_DIGIT = r"^\p{Nd}"
#: Runs of two or more word characters.
TERM = rf"[{WORD_CLASS}]{{2,}}"


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def remove_controls(text: Column) -> Column:
    found = text.rlike(f"[{CONTROL_CLASS}]")
    return F.when(found, F.regexp_replace(text, f"[{CONTROL_CLASS}]", "")).otherwise(text)


def line_text(spans: Column, *, controls: bool = True) -> Column:
    """Span texts joined and stripped; control characters go after the strip, so blanks they
    shielded stay."""
    joined = strip(F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    return remove_controls(joined) if controls else joined


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[\S&&[^\x1c-\x1f]]+"))


def char_count(text: Column) -> Column:
    return F.length(text)


def is_all_caps(text: Column) -> Column:
    """At least one upper-case letter, none in lower or title case, more than one character."""
    upper = text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")
    return (upper & (F.length(text) > 1)).cast("int")


def is_digits(text: Column) -> Column:
    return text.rlike(DIGITS_ONLY)


def starts_with_number(text: Column, pattern: str = NUMBERED) -> Column:
    return text.rlike(pattern).cast("int")


def normalised(text: Column) -> Column:
    """Form in which headings are compared: lower case, then stripped."""
    return strip(F.lower(text))


def level_number(level: Column) -> Column:
    return F.substring(level, 2, 9).cast("int")


def level_name(level: Column) -> Column:
    """Level of a truth entry, H3 where none is given."""
    return F.upper(F.coalesce(level, F.lit("H3")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def relative_size(size: Column, body: Column) -> Column:
    """Size against the page's body size, three digits, 0 where there is no body size."""
    return F.when(body > 0, half_even(size / body, 3)).otherwise(F.lit(0.0))


def terms(text: Column) -> Column:
    """Lower-case terms of two characters or more, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def unigrams_and_bigrams(words: Column) -> Column:
    """Words followed by the pairs of neighbouring words; ``words`` should be a plain column, as it
    is read several times."""
    pairs = F.zip_with(
        words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def counted(rows: DataFrame, values: Column, keep: Sequence[str]) -> DataFrame:
    """One row per distinct element of an array with its count as ``tf``; arrays without elements
    give no row.

    Sorted inside the row and cut into runs: no shuffle and no hash table over all elements. Each
    step is a column the next one reads more than once, so that none is moved into a lambda.
    """
    last = F.size("_sorted") - 1
    new = F.filter(
        F.when(last >= 0, F.sequence(F.lit(0), last)),
        lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
    )
    runs = F.transform("_starts", lambda at, k: F.struct(
        F.get("_sorted", at).alias("term"),
        (F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - at).cast("long").alias("tf"),
    ))
    staged = rows.select(*keep, F.sort_array(values).alias("_sorted")).withColumn("_starts", new)
    return staged.select(*keep, F.inline_outer(runs)).filter(F.col("term").isNotNull())


# Widths of the two retrieval texts.
REQUIREMENT_CHARS = 200
RETRIEVAL_CHARS = 500


def requirement_text(title: Column, content: Column, chars: int | None = REQUIREMENT_CHARS) -> Column:
    return F.concat(title, F.lit(". "), _head(content, chars))


def retrieval_text(title: Column, content: Column, chars: int | None = RETRIEVAL_CHARS) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit(". Content: "), _head(content, chars))


def _head(content: Column, chars: int | None) -> Column:
    return content if chars is None else F.substring(content, 1, chars)


# The wording of a query and the number of keywords in it.
QUERY_TEMPLATE = (
    "As a %s, I need to %s. Focus on sections that address: %s. "
    "Provide practical, actionable information relevant to this specific task."
)
QUERY_KEYWORDS = 5
REQUIREMENT_KEYWORDS = 10


def query_text(persona: Column, task: Column, keywords: Column) -> Column:
    first = F.array_join(F.slice(keywords, 1, QUERY_KEYWORDS), ", ")
    return F.format_string(QUERY_TEMPLATE, persona, task, first)


def requirement_query(keywords: Column) -> Column:
    return F.array_join(F.slice(keywords, 1, REQUIREMENT_KEYWORDS), " ")


def any_pattern(patterns: Sequence[str]) -> str:
    """One case-blind alternation out of several patterns, blanks and digits of any script."""
    written = [p.replace(r"\s", f"[{SPACE_CLASS}]").replace(r"\d", r"\p{Nd}") for p in patterns]
    return "(?iu)" + "|".join(f"(?:{p})" for p in written)


# Date and time formats of the record generator and the ranked result.
LONG_DATE = "EEEE, MMMM dd, yyyy"
CLOCK = "hh:mm a"
MONTH_DAY = "MMMM dd"
ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def long_date(day: Column) -> Column:
    return F.date_format(day, LONG_DATE)


def clock(moment: Column) -> Column:
    return F.date_format(moment, CLOCK)


def month_day(day: Column) -> Column:
    return F.date_format(day, MONTH_DAY)


def iso_timestamp(moment: Column) -> Column:
    return F.date_format(moment, ISO_TIMESTAMP)
