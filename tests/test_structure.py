import random

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, outline, rules, sections
from quire.plans import jobs
from quire.profiles import OUTLINE_PROFILE, SECTION_PROFILE
from tests import sequential

COLUMNS = "doc string, page_number int, line_no int, text string, level string, font_size double"
LEVELS = ["Body", "H1", "H2", "H3", "Title", "H5"]


def scored(spark, cases):
    """``cases``: (text, level, confidence)."""
    rows = [("d", 1, i, t, l, c) for i, (t, l, c) in enumerate(cases)]
    df = spark.createDataFrame(rows, "doc string, page_number int, line_no int, text string, level string, confidence double")
    return df.withColumn("word_count", F.size(F.split("text", " ")))


def levels(df):
    return [r.level for r in df.orderBy("line_no").collect()]


def test_outline_rules(spark):
    cases = [
        ("Fine heading", "H1", 0.6, "H1"), ("Weak", "H1", 0.59, "Body"), ("Weak two", "H2", 0.64, "Body"),
        ("Good two", "H2", 0.65, "H2"), ("Weak three", "H3", 0.69, "Body"), ("Weak title", "Title", 0.5, "Body"),
        ("Table of  Contents", "H1", 0.9, "Body"), ("Table of\u00a0contents", "H1", 0.9, "Body"),
        ("Figure\u00a03", "H1", 0.9, "Body"), ("Figure\u2003\u0663", "H1", 0.9, "Body"), ("Appendix\u2003B", "H1", 0.9, "Body"),
        ("My contents", "H1", 0.9, "H1"), ("LIST OF FIGURES", "H1", 0.9, "Body"),
        ("See figure 3", "H2", 0.9, "Body"), ("Reference", "H2", 0.9, "Body"), ("References list", "H2", 0.9, "H2"),
        ("Appendix B", "H2", 0.9, "Body"), ("Glossary", "Title", 0.9, "Body"), ("12", "H1", 0.9, "Body"), ("1234", "H1", 0.9, "H1"),
        ("²", "H1", 0.9, "Body"), (" ".join("w" * 26), "H1", 0.9, "Body"), (" ".join("w" * 25), "H1", 0.9, "H1"),
        ("text", "Body", 0.1, "Body"),
    ]
    got = levels(rules.demote(scored(spark, [c[:3] for c in cases]), OUTLINE_PROFILE))
    assert got == [c[3] for c in cases]


def test_section_rules(spark):
    cases = [
        ("Fine heading", "H1", 0.6, "H1"), ("Single", "H1", 0.9, "Body"), ("3rd", "H1", 0.9, "H1"), ("Big index here", "H1", 0.9, "Body"),
        ("Introduction", "H1", 0.9, "Body"), ("1234", "H1", 0.9, "Body"), ("Ends so.", "H2", 0.9, "Body"),
        (" ".join("w" * 31), "H1", 0.9, "Body"), (" ".join("w" * 30), "H1", 0.9, "H1"), ("Cross references x", "H1", 0.9, "Body"),
    ]
    got = levels(rules.demote(scored(spark, [c[:3] for c in cases]), SECTION_PROFILE))
    assert got == [c[3] for c in cases]


def test_no_classifier_means_body(spark):
    df = scored(spark, [("Fine heading", "H1", 0.9)]).drop("confidence")
    assert levels(rules.demote(df)) == ["Body"]
    made = jobs.outlines_from_scored(df.withColumn("font_size", F.lit(9.0))).first()
    assert made.title == "Fine heading" and made.outline == []


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", 2)


def random_documents(seed, documents=60, steps=True):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Method one", " ingredients", "12", "gamma", "Gamma"]
    rows = []
    for d in range(documents):
        page = 1
        for i in range(rng.randint(1, 40)):
            if rng.random() < 0.25:
                page += rng.randint(1, 5)
            weights = [5, 2, 2, 2, 1, 1] if d % 3 else [9, 0, 0, 0, 0, 0]
            rows.append((f"d{d}", page, i, rng.choice(words), rng.choices(LEVELS, weights)[0], float(rng.choice([8, 9, 12]))))
    return rows


def by_document(rows):
    found = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        found.setdefault(row[0], []).append(row)
    return found


def test_clamp_like_the_walk_across_blocks(spark, small_blocks):
    rows = random_documents(1)
    got = outline.clamp_levels(spark.createDataFrame(rows, COLUMNS)).orderBy("doc", "page_number", "line_no").collect()
    assert len(got) == len(rows)
    for doc, lines in by_document(rows).items():
        expected = sequential.clamp([l[4] for l in lines])
        assert [r.level for r in got if r.doc == doc] == expected, doc


def test_sections_like_the_walk_across_blocks(spark, small_blocks):
    rows = random_documents(2)
    found = sections.sections(spark.createDataFrame(rows, COLUMNS)).orderBy("document", "section_no").collect()
    for doc, lines in by_document(rows).items():
        expected = sequential.sections([(l[1], l[3], l[4]) for l in lines])
        got = [(r.section_title, r.page_number, r.content) for r in found if r.document == doc]
        assert got == expected, doc


def test_long_documents_stay_one_row(spark):
    rows = [("d", 1, 0, "Start", "H1", 9.0)] + [("d", page, 1, f"w{page}", "H2" if page % 500 == 0 else "Body", 9.0) for page in range(1, 6001)]
    df = spark.createDataFrame(rows, COLUMNS)
    made = outline.outlines(outline.flag_adjacent_duplicates(df)).collect()
    assert [(r.doc, len(r.outline)) for r in made] == [("d", 13)]
    found = sections.sections(df).orderBy("section_no").collect()
    assert [r.content.split()[0] for r in found] == ["w1"] + [f"w{p}" for p in range(501, 5502, 500)]
    assert found[-1].content.endswith("w5999")


def test_adjacent_duplicates(spark, rows):
    data = [
        ("d", 1, 0, "Same", "Body", 9.0), ("d", 1, 1, "SAME", "H1", 9.0), ("d", 1, 2, "same", "Body", 9.0),
        ("d", 1, 5, "same", "H2", 9.0), ("d", 2, 0, "same", "H2", 9.0), ("d", 2, 1, "other", "H1", 9.0), ("d", 2, 2, "same", "H1", 9.0),
    ]
    kept = outline.drop_adjacent_duplicates(spark.createDataFrame(data, COLUMNS))
    assert rows(kept, "page_number", "line_no") == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_titles_and_outlines(spark):
    data = [
        ("classified", 1, 0, "Big", "Body", 30.0), ("classified", 2, 0, "The title", "Title", 9.0), ("classified", 2, 1, "the TITLE", "Title", 9.0),
        ("classified", 2, 2, "One", "H1", 9.0), ("classified", 3, 0, "Two", "H2", 9.0), ("classified", 3, 1, "two", "H2", 9.0),
        ("largest", 1, 0, "2024", "Body", 40.0), ("largest", 1, 1, "first", "Body", 20.0), ("largest", 1, 2, "second", "Body", 20.0),
        ("untitled", 2, 0, "late", "Body", 9.0), ("digits", 1, 0, "77", "Body", 9.0),
    ]
    flagged = outline.flag_adjacent_duplicates(spark.createDataFrame(data, COLUMNS))
    expected = {"classified": "The title", "largest": "first", "untitled": "Untitled Document", "digits": "Untitled Document"}
    assert {r.doc: r.title for r in outline.titles(flagged).collect()} == expected
    made = {r.doc: r for r in outline.outlines(flagged).collect()}
    assert {d: r.title for d, r in made.items()} == expected
    assert [tuple(e) for e in made["classified"].outline] == [("H1", "One", 2), ("H2", "Two", 3)]
    assert made["largest"].outline == []
