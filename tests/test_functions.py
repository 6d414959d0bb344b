import random
import re
import time
from difflib import SequenceMatcher

import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.acceptance.oracles import RATCLIFF
from quire.functions import similarity as M, spans as S, text as X, vectors as V
from tests import sequential

STRINGS = [
    "", " ", "a", "A", "AB", "Ab", "AB 12", "1", "12", "1.2 x", "1.2x", "3a", " 4 b", " 5 c", "²", "٣", "٣ x",
    "①", "ǅ", "Nº", "ÉTÉ", "Été", "a b", "a b  c", "\x1c a \x1f", "x\x00y", "\x01 z", "a\tb\nc",
    "　title　", "中文 標題", "İ", "STRASSE", "Straße", "1.", "1.2.", "1..2", "12_", "9é", "\U0001d54f",
]


def column(spark, strings, **expressions):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, t string")
    return df.select("i", *[e.alias(n) for n, e in expressions.items()]).orderBy("i").collect()


def test_text_like_python(spark):
    t = F.col("t")
    got = column(
        spark, STRINGS, strip=X.strip(t), words=X.word_count(t), chars=X.char_count(t), caps=X.is_all_caps(t),
        digits=X.is_digits(t), number=X.starts_with_number(t), leading=X.starts_with_number(t, X.LEADING_DIGIT),
        controls=X.remove_controls(t), norm=X.normalised(t),
    )
    for s, r in zip(STRINGS, got):
        assert r.strip == s.strip(), repr(s)
        assert r.words == len(s.split()), repr(s)
        assert r.chars == len(s)
        assert r.caps == int(s.isupper() and len(s) > 1), repr(s)
        assert r.digits == s.isdigit(), repr(s)
        assert r.number == int(bool(re.match(r"^\s*(\d+(\.\d+)*)\b", s))), repr(s)
        assert r.leading == int(bool(re.match(r"^\d+", s))), repr(s)
        assert r.controls == re.sub(r"[\x00-\x1f\x7f-\x9f]", "", s)
        assert r.norm == s.lower().strip(), repr(s)


def test_random_text_like_python(spark):
    rng = random.Random(3)
    alphabet = "ab AB1 .  éÉ\x1c\t_²"
    strings = ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(500)]
    t = F.col("t")
    got = column(spark, strings, strip=X.strip(t), words=X.word_count(t), caps=X.is_all_caps(t), number=X.starts_with_number(t))
    for s, r in zip(strings, got):
        assert (r.strip, r.words) == (s.strip(), len(s.split())), repr(s)
        assert r.caps == int(s.isupper() and len(s) > 1), repr(s)
        assert r.number == int(bool(re.match(r"^\s*(\d+(\.\d+)*)\b", s))), repr(s)


def test_names_and_texts(spark):
    got = spark.range(1).select(
        X.file_stem(F.lit("s3://b/x.y/file.tar.json")).alias("stem"),
        X.file_name(F.lit("/a/b c.pdf")).alias("name"),
        X.query_text(F.lit("Cook"), F.lit("plan a menu"), F.array(*map(F.lit, "abcdefg"))).alias("query"),
        X.requirement_text(F.lit("T"), F.lit("x" * 300)).alias("need"),
        X.retrieval_text(F.lit("T"), F.lit("x" * 600)).alias("text"),
        X.long_date(F.lit("2025-07-04").cast("date")).alias("date"),
        X.clock(F.lit("2025-07-04 19:45:00").cast("timestamp")).alias("clock"),
        X.month_day(F.lit("2025-07-04").cast("date")).alias("day"),
        X.half_even(F.lit(2.5)).cast("int").alias("two"),
        X.half_even(F.lit(3.5)).cast("int").alias("four"),
        X.level_name(F.lit(None).cast("string")).alias("level"),
        X.relative_size(F.lit(3.0), F.lit(0.0)).alias("none"),
    ).first()
    assert (got.stem, got.name) == ("file.tar", "b c.pdf")
    assert got.query == (
        "As a Cook, I need to plan a menu. Focus on sections that address: a, b, c, d, e. "
        "Provide practical, actionable information relevant to this specific task."
    )
    assert got.need == "T. " + "x" * 200 and got.text == "Title: T. Content: " + "x" * 500
    assert (got.date, got.clock, got.day) == ("Friday, July 04, 2025", "07:45 PM", "July 04")
    assert (got.two, got.four, got.level, got.none) == (2, 4, "H3", 0.0)


def test_terms_and_counts(spark, rows):
    df = spark.createDataFrame([(1, "a bb cc-bb dd"), (2, ""), (3, "x"), (4, "été ÉTÉ no_1")], "id int, t string")
    words = df.select("id", X.terms(F.col("t")).alias("w"))
    counted = X.counted(words, X.unigrams_and_bigrams(F.col("w")), ["id"])
    assert rows(counted) == sorted([
        (1, "bb", 2), (1, "cc", 1), (1, "dd", 1), (1, "bb cc", 1), (1, "cc bb", 1), (1, "bb dd", 1),
        (4, "été", 2), (4, "no_1", 1), (4, "été été", 1), (4, "été no_1", 1),
    ], key=repr)


def test_mode_and_body_size(spark):
    rng = random.Random(5)
    lists = [[float(rng.choice([3, 8, 9.5, 10, 12, 24])) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    lists += [[], [2.0], [8.0, 12.0], [8.0, 8.0, 12.0, 12.0]]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, v array<double>")
    got = S.with_body_size(df.withColumn("mode", S.first_mode(F.col("v"))), F.col("v")).orderBy("i").collect()
    for values, r in zip(lists, got):
        assert r.mode == sequential.mode(values)
        assert r.body_size == sequential.body_size(values), values


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<double>")
    got = df.select(
        V.cosine(F.col("a"), F.col("b")).alias("cos"), V.unit(F.col("a")).alias("unit"), V.norm(F.col("a")).alias("norm")
    ).collect()
    assert abs(got[0].cos - 0.96) < 1e-9 and got[0].norm == 5.0 and got[1].cos == 0.0
    assert [round(x, 6) for x in got[0].unit] == [0.6, 0.8] and got[1].unit == [0.0, 0.0]
    tied = spark.range(1).select(
        V.predicted_class(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), ["Body", "H1", "H2"]).alias("c"),
        V.confidence(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("p"),
    ).first()
    assert (tied.c, tied.p) == ("H1", 0.4)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_kernels(a, b):
    assert M.common_subsequence(a, b) == sequential.lcs(a, b)
    expected = 100.0 if a == b else 100.0 * 2 * sequential.lcs(a, b) / (len(a) + len(b))
    assert M.indel_ratio(a, b) == expected
    ratio = SequenceMatcher(None, a, b).ratio()
    assert M.ratcliff_ratio(a, b) == ratio
    assert M.is_near(a, b, 0.85) == (ratio > 0.85) and M.is_near(a, b, 0.5) == (ratio > 0.5)


def test_bounds_never_lose_a_pair(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("abcde ", k=rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            spot = rng.randint(0, len(b))
            b[spot:spot + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 1))
        pairs.append((a, "".join(b)))
    pairs += [(a * 200, b * 200) for a, b in pairs[:40]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for ratio, score in ((0.95, lambda a, b: M.indel_ratio(a, b) / 100), (0.85, M.ratcliff_ratio)):
        near = F.array_contains(M.neighbouring_bands(F.col("b"), ratio), M.length_band(F.col("a"), ratio))
        for a, b, kept in df.select("a", "b", (near & M.may_exceed("a", "b", ratio)).alias("kept")).collect():
            assert kept or score(a, b) <= ratio, (a, b)


def edited_pair(rng):
    """Two texts, most of them alike but for some edits, over alphabets of few and of many letters."""
    letters = rng.choice(["ab", "abc", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz ", "aaab"])
    size = rng.choice([0, 1, 5, 30, 120, 199, 200, 201, 260, 450])
    a = "".join(rng.choices(letters, k=rng.randint(0, size)))
    if rng.random() < 0.4:
        return a, "".join(rng.choices(letters, k=rng.randint(0, size)))
    b = list(a)
    for _ in range(rng.randint(0, 12)):
        at = rng.randint(0, len(b))
        if rng.random() < 0.5:
            b[at:at] = rng.choices(letters, k=rng.randint(1, 4))
        else:
            del b[at:at + rng.randint(1, 5)]
    return a, "".join(b)


def test_matching_blocks_like_difflib():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = edited_pair(rng)
        library = SequenceMatcher(None, a, b)
        assert M.matched(a, b) == sum(block.size for block in library.get_matching_blocks()), (a, b)
        assert M.ratcliff_ratio(a, b) == library.ratio()
    long = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(20_000))
    began = time.time()
    assert M.matched(long, long[:9000] + long[9500:]) == 19_500
    assert M.matched("ab" * 50_000, "ab" * 25_000 + "x" + "ab" * 25_000) == 50_000  # frequent characters only
    assert time.time() - began < 20


def test_sql_of_matching_blocks_like_difflib():
    rng = random.Random(3)
    pairs = sorted({edited_pair(rng) for _ in range(150)})
    near = [(a, b) for a, b in pairs if SequenceMatcher(None, a, b).ratio() > 0.85]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE to_match (a VARCHAR, b VARCHAR)")
    connection.executemany("INSERT INTO to_match VALUES (?, ?)", pairs)
    found = connection.execute(f"WITH RECURSIVE {RATCLIFF.lstrip()} SELECT DISTINCT a, b FROM alike").fetchall()
    assert sorted(found) == near and 20 < len(near) < len(pairs)
