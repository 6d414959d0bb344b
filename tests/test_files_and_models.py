import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import models
from quire.plans import jobs
from quire.schemas import NUMERIC_FEATURES
from quire.sources import datasets, outline_files, records, requests


def test_outline_dialects(spark, tmp_path):
    (tmp_path / "new a+b%20 (1).v1.json").write_text(json.dumps({"title": "Tête", "outline": [{"level": "H1", "text": "α", "page": 0}]}, ensure_ascii=False))
    (tmp_path / "old.json").write_text(json.dumps({"title": "O", "headings": [{"text": "x", "level": "H2", "page_number": 3}]}, indent=4))
    (tmp_path / "bad.json").write_text('{"title": ')
    good, bad = outline_files.read_outlines(spark, str(tmp_path))
    found = {r.doc: r for r in good.collect()}
    assert set(found) == {"new a+b%20 (1).v1", "old"}
    assert found["new a+b%20 (1).v1"].title == "Tête" and found["new a+b%20 (1).v1"].outline[0].text == "α" and found["new a+b%20 (1).v1"].headings is None
    assert found["old"].headings[0].page_number == 3
    assert [r.file for r in bad.collect()] == ["bad.json"]


def test_outline_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", "Größe", [("H1", "α β", 2)]), ("b", "", []), ("c", "T", [])], "doc string, title string, outline array<struct<level:string,text:string,page:int>>"
    )
    path = str(tmp_path / "out")
    outline_files.write_outlines(df, path)
    lines = [json.loads(l.value) for l in spark.read.text(path).collect()]
    assert {"doc": "a", "title": "Größe", "outline": [{"level": "H1", "text": "α β", "page": 2}]} in lines
    objects = {r.doc: r.json for r in outline_files.outline_json(df).collect()}
    assert json.loads(objects["a"]) == {"title": "Größe", "outline": [{"level": "H1", "text": "α β", "page": 2}]}
    again, bad = outline_files.read_outlines(spark, path)
    assert {r.doc: r.title for r in again.collect()} == {"a": "Größe", "b": "", "c": "T"} and bad.count() == 0
    one = str(tmp_path / "one")
    outline_files.write_outlines(df.coalesce(1), one)
    again, bad = outline_files.read_outlines(spark, one)
    assert {r.doc: [tuple(e)[:3] for e in r.outline] for r in again.collect()} == {"a": [("H1", "α β", 2)], "b": [], "c": []}
    back = outline_files.as_outline_files(df).filter("doc = 'a'").first()
    assert back.outline[0].page == 2 and back.headings is None


def test_requests(spark, tmp_path):
    full = {"challenge_info": {"challenge_id": "x"}, "documents": [{"filename": "a.pdf", "title": "A"}, {"filename": "b.pdf", "title": "B"}],
            "persona": {"role": "Planner"}, "job_to_be_done": {"task": "Plan"}}
    (tmp_path / "one.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"documents": [], "job_to_be_done": {"task": "T"}}))
    (tmp_path / "three.json").write_text(json.dumps({"persona": {"role": "P"}, "job_to_be_done": {"task": ""}}))
    (tmp_path / "four.json").write_text("[oops")
    good, rejects = requests.read_requests(spark, str(tmp_path))
    found = {r.request_id: r for r in good.collect()}
    assert set(found) == {"one", "two"} and found["two"].persona == "User"
    assert {r.request_id: r.reason for r in rejects.collect()} == {"three": "no task", "four": "unreadable"}
    corpus = spark.createDataFrame([("a.pdf",), ("c.pdf",)], "document string")
    assert [tuple(r) for r in requests.found_documents(good, corpus).collect()] == [("a.pdf", "one")]
    assert [tuple(r) for r in requests.missing_documents(good, corpus).collect()] == [("b.pdf", "one")]


def test_labelled_csv(spark, tmp_path):
    def row(text, font, label):
        return (text, 9.5, font, 1, 2, 0.0, 10.25, 1, 5, 0, 1.0, 0, 0.0, 1, -0.5, 0, label)
    data = [row('say "hi", ok', "Times", "H1"), row("two\nlines", "A,B", "Body"), row("", "", "H2")]
    df = spark.createDataFrame(data, schemas.LABELLED_LINE).withColumn("document", F.lit("d.pdf"))
    path = str(tmp_path / "csv")
    datasets.write_labelled(df, path)
    back = datasets.read_labelled(spark, path)
    assert back.columns == schemas.LABELLED_LINE.fieldNames()
    assert sorted(tuple(r) for r in back.collect()) == sorted(data)


def test_records(spark):
    made = records.numbered_records(spark, base_date="2025-07-01")
    rows = made.collect()
    assert len(rows) == 50
    again = records.synth_records(spark.range(1, 51).repartition(5), "2025-07-01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert {r.rsvp[:14] for r in rows} == {"by July 08 to "} and len({r.venue_name for r in rows}) == 5
    assert all(r.time[3:5] in ("00", "15", "30", "45") for r in rows)
    venues = {v[0]: v[1:] for v in records.VENUES}
    assert all(venues[r.venue_name] == (r.address_l1, r.address_l2) for r in rows)
    truth = records.record_truth(made).first()
    assert truth.title == "" and tuple(truth.outline[0]) == ("H1", "HOPE To SEE You THERE! ", 0)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        label = ["Body", "H1", "H2"][i % 3 if i % 2 else 0]
        size = {"Body": 9.0, "H1": 18.0, "H2": 14.0}[label] + rng.random()
        text = {"Body": "some running words of a body line", "H1": "Chapter heading", "H2": "Part heading"}[label] + f" {rng.choice('abc')}x"
        rows.append((i, text, size, "Times-Bold" if label != "Body" else "Times", None if i % 17 == 0 else rng.random() * 500, label))
    df = spark.createDataFrame(rows, "id int, text string, font_size double, font_name string, x_position double, label string")
    zeros = [c for c in schemas.NUMERIC_FEATURES if c not in df.columns]
    df = df.withColumns({c: F.lit(0) for c in zeros})
    plan = models.TrainingPlan(terms=50, fonts=8, deep=3, shallow=2, rounds=2, meta_rounds=30)
    model, held_out = jobs.training_job(df, F.col("id"), plan)
    return df, model, held_out


def test_training(trained):
    df, model, held_out = trained
    rows = held_out.collect()
    assert {"label", "predicted", "confidence"} <= set(held_out.columns)
    assert abs(len(rows) - 80) <= 1
    assert sum(r.label == r.predicted for r in rows) / len(rows) > 0.9
    assert all(0 < r.confidence <= 1 for r in rows)
    assert model.stages[-1].getLabels() == ["Body", "H1", "H2"]


def test_saved_model_scores_the_same(spark, trained, tmp_path):
    df, model, _ = trained
    path = str(tmp_path / "model")
    models.save_model(model, path)
    unlabelled = df.drop("label", "is_next_line_blank").withColumn("font_name", F.when(F.col("id") % 5 > 0, "Unseen"))
    first = models.score_lines(unlabelled, model).select("id", "level", "confidence").orderBy("id").collect()
    second = models.score_lines(unlabelled, models.load_model(path)).select("id", "level", "confidence").orderBy("id").collect()
    assert first == second and len(first) == 400


def test_text_features_like_smoothed_idf(spark):
    texts = ["aa bb", "aa cc", "bb cc dd", "aa bb"]
    df = spark.createDataFrame([(t, "F") for t in texts], "text string, font_name string").withColumns(
        {c: F.lit(1.0) for c in schemas.NUMERIC_FEATURES}
    )
    features = models.fit_features(models.model_rows(df), models.TrainingPlan(terms=100))
    terms = [s for s in features.stages if hasattr(s, "vocabulary")][1].vocabulary
    # In two texts at least and in at most 95 percent of them.
    assert set(terms) == {"aa", "bb", "cc", "aa bb"}
    import math
    vectors = [r.features.toArray()[14:] for r in features.transform(models.model_rows(df)).select("features").collect()]
    idf = {"aa": math.log(5 / 4) + 1, "bb": math.log(5 / 4) + 1, "cc": math.log(5 / 3) + 1, "aa bb": math.log(5 / 3) + 1}
    norm = math.sqrt(sum(idf[t] ** 2 for t in ("aa", "bb", "aa bb")))
    for term, value in zip(terms, vectors[0]):
        assert abs(value - (idf[term] / norm if term != "cc" else 0.0)) < 1e-9


def test_medians_are_exact_and_all_fonts_have_a_slot(spark):
    sizes = [1.0, 2.0, 4.0, 9.0, None, float("nan")]
    df = spark.createDataFrame([("t", f"F{i % 4}", s) for i, s in enumerate(sizes)], "text string, font_name string, font_size double")
    df = df.withColumns({c: F.lit(None).cast("double") for c in schemas.NUMERIC_FEATURES if c not in df.columns})
    made = models.fit_features(models.model_rows(df)).transform(models.model_rows(df)).select("features").collect()
    vectors = [r.features.toArray() for r in made]
    # Four numbers are known; a column without one counts as 0.
    assert sorted(v[0] for v in vectors) == [1.0, 2.0, 3.0, 3.0, 4.0, 9.0]
    assert all(v[1:13].sum() == 0 for v in vectors)
    # F0 and F1 twice, F2 and F3 once.
    assert [int(v[13:17].argmax()) for v in vectors] == [0, 1, 2, 3, 0, 1]


def test_rows_of_a_fit_are_bounded(spark):
    df = spark.range(1000)
    assert models.bounded(df, 1000).count() == 1000
    assert 40 < models.bounded(df, 100).count() < 200


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    got = models.label_indexer(df.dropna(), "label").transform(df).collect()
    assert [int(r[models.LABEL_INDEX]) for r in got] == [1, 0, 1, 2]


def test_class_weight(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    got = df.withColumn("w", models.class_weight(df, "label")).distinct().collect()
    assert {r.label: round(r.w, 6) for r in got} == {"a": 0.666667, "b": 2.0}


def test_outline_and_section_jobs(spark, trained):
    _, model, _ = trained
    def line(top, text, size, font):
        return ([0.0, top, 9.0, top + size], [(text, size, font, 0, [0.0, top, 9.0, top + size])])
    blocks = [(0, [0.0, 0.0, 9.0, 99.0], [
        line(0.0, "Chapter heading ax", 18.2, "Times-Bold"), line(30.0, "some running words of a body line bx", 9.3, "Times"),
        line(50.0, "Part heading bx", 14.4, "Times-Bold"), line(70.0, "some running words of a body line cx", 9.3, "Times"),
    ])]
    trees = spark.createDataFrame([("d", 1, 800.0, blocks)], schemas.PAGE_TREE)
    outline = jobs.outline_job(trees, model).first()
    assert outline.doc == "d" and outline.title == "Chapter heading ax"
    assert [tuple(e) for e in outline.outline] == [("H1", "Chapter heading ax", 1), ("H2", "Part heading bx", 1)]
    sections = jobs.section_job(trees, model).orderBy("section_no").collect()
    assert [(s.section_title, s.content) for s in sections] == [
        ("Chapter heading ax", "some running words of a body line bx"), ("Part heading bx", "some running words of a body line cx")]
    truth = spark.createDataFrame(
        [("d", "T", [("H1", "Chapter heading ax", 1, None)])], "doc string, title string, outline array<struct<level:string,text:string,page:int,page_number:int>>")
    dataset = jobs.dataset_job(trees, truth)
    assert sorted(r.label for r in dataset.collect()) == ["Body", "H1"]


def test_a_fit_reads_all_labelled_rows(spark, monkeypatch):
    """More than 200,000 of them were once drawn from, and medians, fonts and terms with them."""
    n = 200_400
    df = spark.range(n).select(
        "id", F.lit("Chapter one").alias("text"), F.concat(F.lit("f"), F.col("id") % 3).alias("font_name"),
        F.when(F.col("id") % 2 == 0, "Body").otherwise("H1").alias("label"), (F.col("id") % 5 == 0).alias("is_test"),
        *[(F.col("id") % 7 if c == "font_size" else F.lit(0)).alias(c) for c in NUMERIC_FEATURES],
    )

    class Seen(Exception):
        pass

    def settled(rows):
        raise Seen(rows.count(), rows.filter("is_test").count())

    monkeypatch.setattr(models, "settled", settled)
    with pytest.raises(Seen) as seen:
        models.fit_line_classifier(df, plan=models.TrainingPlan(terms=4, rounds=1))
    assert seen.value.args == (n, n // 5)


def test_medians_are_exact(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 4, 5, 40, 9001, 9002):
        made = [
            [rng.choice([None, float("nan"), -0.5, 3.0]) if rng.random() < 0.3 else rng.expovariate(1) ** 3 - 1 for _ in range(n)],
            [float(rng.randrange(3)) for _ in range(n)], [None] * n,
        ]
        names = list(NUMERIC_FEATURES)
        df = spark.createDataFrame([tuple(row) for row in zip(*made)], ", ".join(f"`{c}` double" for c in names[:3]))
        found = models._medians(df.withColumns({c: F.lit(0.0) for c in names[3:]}))
        for c, values in zip(names, made):
            known = [v for v in values if v is not None and v == v]
            assert found[c] == (statistics.median(known) if known else 0.0), (n, c)
