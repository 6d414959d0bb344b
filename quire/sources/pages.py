"""Page-structured input and its flattening to lines.

A page row carries all of its lines, so body size and neighbour features are computed inside the
row: going from page trees to feature rows takes no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire import schemas
from quire.functions import spans as S, text as X
from quire.profiles import OUTLINE_PROFILE, Profile
from quire.sources.json_text import BAD_RECORD, parsed, source_file

# Gap in line sizes that counts as blank, height of an unlaid-out page.
BLANK_GAP = 1.5
PAGE_HEIGHT = 792.0


def list_corpus(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Name, size and time of the files matching ``pattern``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def read_page_trees(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines page trees as (good pages, quarantined records with their file)."""
    text = spark.read.text(path).select("value", source_file().alias("file"))
    raw = parsed(text.filter(F.length(F.trim("value")) > 0), schemas.PAGE_TREE)
    bad = F.col(BAD_RECORD).isNotNull() | F.col("doc").isNull() | F.col("page_number").isNull()
    good = raw.filter(~bad).select(*schemas.PAGE_TREE.fieldNames())
    return good, raw.filter(bad).select("file", F.col(BAD_RECORD).alias("record"))


def page_counts(trees: DataFrame) -> DataFrame:
    """Pages per document, empty ones included."""
    return trees.groupBy("doc").agg(F.count_distinct("page_number").alias("pages"))


def _text_blocks(profile: Profile) -> Column:
    blocks = F.filter(
        F.coalesce(F.col("blocks"), F.array()), lambda b: (b["type"] == 0) & b["lines"].isNotNull()
    )
    if not profile.sort_blocks:
        return blocks
    keyed = F.transform(
        blocks, lambda b, i: F.struct(b["bbox"][1].alias("top"), i.alias("at"), b["lines"].alias("lines"))
    )
    return F.array_sort(keyed)


def _laid_out(profile: Profile) -> Column:
    """Array of the page's non-empty lines in reading order."""

    none = F.array().cast(schemas.T.ArrayType(schemas.SPAN))

    def read(source: Column, at: Column) -> Column:
        spans = F.coalesce(source["spans"], none)
        return F.struct(
            at.alias("line_no"),
            X.line_text(spans, controls=profile.strip_controls).alias("text"),
            F.transform(spans, lambda s: s["size"]).alias("sizes"),
            F.transform(spans, lambda s: s["font"]).alias("fonts"),
            S.is_bold(spans).alias("is_bold"),
            source["bbox"].alias("bbox"),
        )

    def line(read: Column) -> Column:
        return F.struct(
            read["line_no"].alias("line_no"),
            read["text"].alias("text"),
            S.line_size(read["sizes"]).alias("font_size"),
            S.line_font(read["fonts"]).alias("font_name"),
            read["is_bold"].alias("is_bold"),
            read["bbox"][0].alias("x_position"),
            read["bbox"][1].alias("y_position"),
            read["bbox"][3].alias("y_bottom"),
        )

    flat = F.flatten(F.transform(_text_blocks(profile), lambda b: b["lines"]))
    return F.transform(F.filter(F.transform(flat, read), lambda l: F.length(l["text"]) > 0), line)


def pages_from_trees(trees: DataFrame, profile: Profile = OUTLINE_PROFILE) -> DataFrame:
    """Page rows: document, page number, height and the array of lines."""
    return trees.select("doc", "page_number", "page_height", _laid_out(profile).alias("lines"))


def _unnested(pages: DataFrame, lines: Column, *keep: str) -> DataFrame:
    # The outer form, because Spark would otherwise test size(lines) > 0 below the projection and
    # build every line array twice.
    rows = pages.select("doc", "page_number", "page_height", *keep, F.inline_outer(lines))
    return rows.filter(F.col("text").isNotNull())


def lines_from_pages(pages: DataFrame) -> DataFrame:
    """One row per line, with no layout statistics yet."""
    return _unnested(pages, F.col("lines"))


def feature_lines(pages: DataFrame, profile: Profile = OUTLINE_PROFILE) -> DataFrame:
    """One row per line with all layout and text features; no shuffle."""
    lines = F.col("lines")
    sizes = F.transform(lines, lambda l: l["font_size"])
    if profile.min_body_size is not None:
        sizes = F.filter(sizes, lambda s: s > profile.min_body_size)

    def with_neighbours(line: Column, i: Column) -> Column:
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        size = line["font_size"]
        size_before, size_after = F.coalesce(before["font_size"], size), F.coalesce(after["font_size"], size)
        gap_before = line["y_position"] - F.coalesce(before["y_bottom"], F.lit(0.0))
        gap_after = F.coalesce(after["y_position"], F.col("page_height")) - line["y_bottom"]
        return F.struct(
            *[line[c].alias(c) for c in (
                "line_no", "text", "font_size", "font_name", "is_bold", "x_position", "y_position", "y_bottom")],
            (size - size_before).alias("font_size_diff_prev"),
            (gap_before > size_before * BLANK_GAP).cast("int").alias("is_prev_line_blank"),
            (size - size_after).alias("font_size_diff_next"),
            (gap_after > size * BLANK_GAP).cast("int").alias("is_next_line_blank"),
        )

    laid = F.transform(lines, with_neighbours) if profile.neighbours else lines
    rows = _unnested(S.with_body_size(pages, sizes), laid, "body_size")
    return text_features(rows, profile).withColumn(
        "relative_font_size", X.relative_size(F.col("font_size"), F.col("body_size"))
    )


def lines_from_page_trees(trees: DataFrame, profile: Profile = OUTLINE_PROFILE) -> DataFrame:
    return feature_lines(pages_from_trees(trees, profile), profile)


def text_features(lines: DataFrame, profile: Profile = OUTLINE_PROFILE) -> DataFrame:
    """Word and character counts, capitals and number flags of each line."""
    text = F.col("text")
    return lines.withColumns({
        "word_count": X.word_count(text),
        "char_count": X.char_count(text),
        "is_all_caps": X.is_all_caps(text),
        "starts_with_number": X.starts_with_number(text, profile.number_pattern),
    })


def spans_from_page_trees(trees: DataFrame) -> DataFrame:
    """One row per non-empty span, sizes and positions rounded to whole numbers."""
    blocks = F.filter(F.coalesce(F.col("blocks"), F.array()), lambda b: b["type"] == 0)
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["lines"], F.array())))
    spans = F.flatten(F.transform(lines, lambda l: F.coalesce(l["spans"], F.array())))
    span = F.col("span")
    rows = trees.select("doc", "page_number", F.posexplode(spans).alias("span_no", "span")).select(
        "doc", "page_number", "span_no",
        X.strip(span["text"]).alias("text"),
        X.half_even(span["size"]).cast("int").alias("font_size"),
        span["font"].alias("font_name"),
        S.name_is_bold(span["font"]).cast("int").alias("is_bold"),
        X.half_even(span["bbox"][0]).cast("int").alias("x_position"),
    )
    return rows.filter(F.length("text") > 0).withColumn("word_count", X.word_count(F.col("text")))


# Layout given to plain text, one line per newline.
PLAIN_LINES_PER_PAGE = 40
PLAIN_LINE_HEIGHT = 18.0


def pages_from_text(
    docs: DataFrame, id_col: str, text_col: str, size: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Plain text as page rows of forty lines each; ``size`` maps a line's text to its font size."""
    size = size or (lambda text: F.lit(DEFAULT_SIZE))
    split = docs.select(F.col(id_col).cast("string").alias("doc"), F.split(text_col, "\n", -1).alias("raw"))

    def line(found: Column) -> Column:
        top = found["at"] * F.lit(PLAIN_LINE_HEIGHT)
        return F.struct(
            found["at"].alias("line_no"),
            found["text"].alias("text"),
            size(found["text"]).alias("font_size"),
            F.lit("plain").alias("font_name"),
            F.lit(0).alias("is_bold"),
            F.lit(0.0).alias("x_position"),
            top.alias("y_position"),
            (top + size(found["text"])).alias("y_bottom"),
        )

    def page(at: Column) -> Column:
        raw = F.slice("raw", at * PLAIN_LINES_PER_PAGE + 1, F.lit(PLAIN_LINES_PER_PAGE))
        texts = F.transform(raw, lambda t, i: F.struct(i.alias("at"), X.strip(t).alias("text")))
        clean = F.transform(texts, lambda t: F.struct(t["at"].alias("at"), X.remove_controls(t["text"]).alias("text")))
        found = F.filter(clean, lambda t: F.length(t["text"]) > 0)
        return F.struct((at + 1).alias("page_number"), F.transform(found, line).alias("lines"))

    last = F.floor((F.size("raw") - 1) / PLAIN_LINES_PER_PAGE).cast("int")
    pages = split.select("doc", F.inline_outer(F.transform(F.sequence(F.lit(0), last), page)))
    return pages.select("doc", "page_number", F.lit(PAGE_HEIGHT).alias("page_height"), "lines")


def lines_from_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return feature_lines(pages_from_text(docs, id_col, text_col))


DEFAULT_SIZE = 12.0

# Sizes of the tags that are not shown at the default size.
HTML_SIZES = {"title": 30.0, "h1": 24.0, "h2": 20.0, "h3": 16.0, "h4": 14.0, "h5": 13.0, "h6": 12.5}
# Tags that open a line of their own.
HTML_BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul"
).split()
# The named character references that are decoded, ampersand last.
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&euro;", "€"), ("&pound;", "£"), ("&sect;", "§"), ("&deg;", "°"), ("&times;", "×"), ("&amp;", "&"),
)
#: Tag of text that stands in no block of its own.
LOOSE = "body"


def _numeric_references(text: Column) -> Column:
    """Decimal and hexadecimal character references decoded, those of no character left."""
    def shown(found: Column) -> Column:
        hexadecimal = F.when(
            found.rlike("^&#[xX]"), F.regexp_extract(found, "^&#[xX]([0-9a-fA-F]+);", 1)
        ).otherwise(F.conv(F.regexp_extract(found, "^&#([0-9]+);", 1), 10, 16))
        code = F.conv(hexadecimal, 16, 10).cast("long")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")).otherwise(found)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});)"), F.lit(1)))
    return F.aggregate(found, text, lambda done, one: F.replace(done, one, shown(one)))


def _html_lines(html: Column) -> Column:
    """Array of a page's lines: tag, text and inner mark-up of every block and of loose text; ``br``
    ends a line."""
    html = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    html = F.regexp_replace(html, "[\x01\x02\x03]", "")
    html = F.regexp_replace(html, r"(?i)<br\s*/?>", "\x03")
    html = F.regexp_replace(html, rf"(?i)<({'|'.join(HTML_BLOCKS)})(\s[^>]*)?/?>", "\x01$1\x02")
    html = F.regexp_replace(html, rf"(?i)</({'|'.join(HTML_BLOCKS)})\s*>", f"\x01{LOOSE}\x02")

    def lines(piece: Column) -> Column:
        tag = F.lower(F.when(piece.contains("\x02"), F.substring_index(piece, "\x02", 1)).otherwise(F.lit(LOOSE)))
        inner = F.regexp_replace(piece, "^[^\x02]*\x02", "")
        return F.transform(F.split(inner, "\x03", -1), lambda part: F.struct(tag.alias("tag"), part.alias("inner")))

    def shown(line: Column) -> Column:
        text = _numeric_references(F.regexp_replace(line["inner"], r"<[^>]*>", " "))
        for name, char in HTML_ENTITIES:
            text = F.replace(text, F.lit(name), F.lit(char))
        text = X.strip(F.regexp_replace(text, f"[{X.SPACE_CLASS}]+", " "))
        return F.struct(line["tag"].alias("tag"), line["inner"].alias("inner"), text.alias("text"))

    found = F.transform(F.flatten(F.transform(F.split(html, "\x01", -1), lines)), shown)
    return F.filter(found, lambda line: F.length(line["text"]) > 0)


def pages_from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Web pages as page rows: every page is page 1 of its document, a line for each block, sized by
    its tag. The rows go wherever page trees or plain text go."""
    sizes = F.create_map(*[F.lit(v) for pair in HTML_SIZES.items() for v in pair])
    found = pages.select(F.col(id_col).cast("string").alias("doc"), _html_lines(F.coalesce(F.col(html_col), F.lit(""))).alias("found"))

    def line(read: Column, at: Column) -> Column:
        size = F.coalesce(F.try_element_at(sizes, read["tag"]), F.lit(DEFAULT_SIZE))
        top = at * F.lit(PLAIN_LINE_HEIGHT)
        bold = read["inner"].rlike(r"(?i)<(b|strong)(\s[^>]*)?>") | read["tag"].rlike("^h[1-6]$|^title$")
        return F.struct(
            at.alias("line_no"), read["text"].alias("text"), size.alias("font_size"), F.lit("html").alias("font_name"),
            bold.cast("int").alias("is_bold"), F.lit(0.0).alias("x_position"), top.alias("y_position"),
            (top + size).alias("y_bottom"), read["tag"].alias("tag"),
        )

    height = F.greatest(F.size("found") * F.lit(PLAIN_LINE_HEIGHT), F.lit(PAGE_HEIGHT))
    return found.select("doc", F.lit(1).alias("page_number"), height.alias("page_height"), F.transform("found", line).alias("lines"))


def lines_from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of web pages as lines of page 1, sized by tag."""
    rows = _unnested(pages_from_html(pages, id_col, html_col), F.col("lines"))
    return rows.select("doc", "page_number", "line_no", "tag", "text", "font_size", "is_bold")
