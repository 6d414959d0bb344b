"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("font", T.StringType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
])

TREE_LINE = T.StructType([
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("spans", T.ArrayType(SPAN)),
])

BLOCK = T.StructType([
    T.StructField("type", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("lines", T.ArrayType(TREE_LINE)),
])

#: One row per page of a document; the unit every layout rule works on.
PAGE_TREE = T.StructType([
    T.StructField("doc", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("page_height", T.DoubleType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
])

#: Line features in the order the labelled CSV stores them.
LABELLED_LINE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("font_size", T.DoubleType()),
    T.StructField("font_name", T.StringType()),
    T.StructField("is_bold", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("x_position", T.DoubleType()),
    T.StructField("y_position", T.DoubleType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("char_count", T.IntegerType()),
    T.StructField("is_all_caps", T.IntegerType()),
    T.StructField("relative_font_size", T.DoubleType()),
    T.StructField("starts_with_number", T.IntegerType()),
    T.StructField("font_size_diff_prev", T.DoubleType()),
    T.StructField("is_prev_line_blank", T.IntegerType()),
    T.StructField("font_size_diff_next", T.DoubleType()),
    T.StructField("is_next_line_blank", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

#: Model inputs: thirteen numbers, the font name and the text.
NUMERIC_FEATURES = [
    "font_size", "is_bold", "x_position", "y_position", "word_count", "char_count", "is_all_caps",
    "relative_font_size", "starts_with_number", "font_size_diff_prev", "is_prev_line_blank",
    "font_size_diff_next", "is_next_line_blank",
]
MODEL_INPUTS = NUMERIC_FEATURES + ["font_name", "text"]

OUTLINE_ENTRY = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("page", T.IntegerType()),
])

#: Current dialect, written by the outline sink.
OUTLINE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("outline", T.ArrayType(OUTLINE_ENTRY)),
])

HEADING = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
])

#: Both dialects at once; whichever list a file lacks is read as null.
OUTLINE_FILE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("headings", T.ArrayType(HEADING)),
    T.StructField("outline", T.ArrayType(HEADING)),
])

REQUEST_FILE = T.StructType([
    T.StructField("challenge_info", T.StructType([
        T.StructField("challenge_id", T.StringType()),
        T.StructField("test_case_name", T.StringType()),
        T.StructField("description", T.StringType()),
    ])),
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()),
        T.StructField("title", T.StringType()),
    ]))),
    T.StructField("persona", T.StructType([T.StructField("role", T.StringType())])),
    T.StructField("job_to_be_done", T.StructType([T.StructField("task", T.StringType())])),
])
