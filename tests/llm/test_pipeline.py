"""The pipeline's stages on a small corpus, each against what its operator should decide."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components, brute_lines, junk

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(vocabulary, k=rng.randint(20, 120))
        good = i % 4 > 0
        lines = [" ".join(words).capitalize() + "." if good else junk(rng, words)]
        if i % 6 == 1:
            lines.append("All rights reserved by the makers of this text.")
        if i % 10 == 3:
            lines.append(f"password = hunter2{i}xy")
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(good), 0))
    for i in range(240, 260):  # near copies of clean documents
        text = rows[(i - 240) * 4 + 2][1].split(" ")
        text[len(text) // 2] = "changed"
        rows.append((i, " ".join(text), "en", "s", 0))
    folder = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def test_stages(spark, corpus):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    bad = {doc for doc, quality, _ in labels if not quality}

    good = stages["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == {r[0] for r in rows} - bad

    lines = stages["line dedup"](spark, good, folder)
    assert lines.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {doc: (text, len(text)) for doc, text, _, _ in brute_lines(sorted(kept.items()))}

    apart = stages["n-gram Jaccard join"](spark, lines, folder)
    assert apart.columns == docs.columns
    expected = {doc for doc, _, root in brute_components([(d, t) for d, (t, _) in got.items()], 5, 80) if doc == root}
    assert {r.doc_id for r in apart.collect()} == expected and len(expected) < len(got)

    clean = stages["secret scans"](spark, apart, folder)
    assert clean.columns == docs.columns
    for row in clean.collect():
        assert row.text == re.sub(r"password = hunter2\w+", "[assign removed]", got[row.doc_id][0]) and row.n_chars == len(row.text)

    packed = stages["packing"](spark, clean, folder)
    assert {r.doc_id for r in packed.collect()} == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, packed.collect()))


def test_empty_and_clashing(spark, corpus):
    folder, _, _ = corpus
    empty = spark.createDataFrame([], DOCUMENTS + ", score string, n_lines string, spans string")
    odd = spark.createDataFrame([(None, None, None, None, None, "s", "l", "p"), (1, "", "en", "x", 0, None, None, None)], empty.schema)
    for docs, least in ((empty, 0), (odd, 2)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            done = stage(spark, docs, folder)
            assert done.columns == docs.columns and done.count() == least
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == least
    assert corpus_pipeline.STAGES[0][1](spark, empty, folder).columns == empty.columns


def test_queries_over_small_tables(spark):
    from quire.llm.queries import ORACLES, QUERIES
    from tests.check_oracles import compare

    for query in QUERIES:
        if query.__name__ in ORACLES:
            verdict = compare(spark, SMALL, query, ORACLES[query.__name__])
            assert verdict.startswith("equal"), (query.__name__, verdict)
        else:
            counted = query(spark, SMALL).count()
            assert counted >= 200, query.__name__
