import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.functions import similarity as M
from quire.operators import evaluate, joins, labeling, sampling
from quire.sources import outline_files
from tests.conftest import SMALL


def changed(rng, text):
    """``text`` with a few characters left out, doubled or replaced."""
    out = []
    for ch in text:
        r = rng.random()
        if r < 0.03:
            continue
        out.append(rng.choice("xyz") if r < 0.05 else ch)
        if r > 0.97:
            out.append(ch)
    return "".join(out)


def random_headings(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcd ", k=rng.randint(1, 60))) for _ in range(25)]
    lines, truth = [], []
    for d in range(12):
        for page in range(1, 4):
            for i in range(12):
                lines.append((f"d{d}", page, i, rng.choice(pool)))
            if d % 4:
                for _ in range(rng.randint(0, 8)):
                    text = rng.choice(pool)
                    truth.append((f"d{d}", len(truth), rng.choice(["H1", "H2", "H3"]), changed(rng, text) if rng.random() < 0.7 else text, page))
    return lines, truth


def test_labels_like_every_pair(spark, rows):
    lines, truth = random_headings(7)
    df = spark.createDataFrame(lines, "doc string, page_number int, line_no int, text string")
    headings = spark.createDataFrame(truth, "doc string, pos int, level string, text string, page int")
    expected = []
    for doc, page, i, text in lines:
        scores = [(M.indel_ratio(text, t), -pos, level) for d, pos, level, t, p in truth if (d, p) == (doc, page)]
        best = max(scores, key=lambda s: s[:2], default=(0.0, 0, "Body"))
        expected.append((doc, page, i, text, best[2] if best[0] > 95 else "Body"))
    got = rows(labeling.label_lines(df, headings))
    assert got == sorted(expected, key=repr)
    assert len({e[4] for e in expected}) == 4
    shifted = headings.withColumn("page", F.col("page") - 1)
    assert rows(labeling.label_lines(df, shifted, page_offset=1)) == got
    assert rows(labeling.label_lines(df, shifted)) != got


def test_matches_like_every_pair(spark, rows):
    rng = random.Random(9)
    lines, truth = random_headings(13)
    gt = [(d, l, p, t) for d, _, l, t, p in truth]
    out = [(d, l, p, changed(rng, t).upper() + " ") for d, l, p, t in gt if rng.random() < 0.8]
    out += [("d1", "H1", 1, t) for _, _, _, t in lines[:20]] + [("extra", "H1", 1, "z")]

    def frame(entries):
        grouped = defaultdict(list)
        for d, l, p, t in entries:
            grouped[d].append((l, t, p, None))
        data = [(d, "Title " + d, None, hs) for d, hs in grouped.items()]
        schema = "doc string, title string, headings array<struct<level:string,text:string,page:int,page_number:int>>, outline array<struct<level:string,text:string,page:int,page_number:int>>"
        return spark.createDataFrame(data, schema)

    expected, missed = [], []
    for d in {g[0] for g in gt} & {o[0] for o in out}:
        g = {(t.lower().strip(), l, p) for x, l, p, t in gt if x == d}
        o = {(t.lower().strip(), l, p) for x, l, p, t in out if x == d}
        pairs = [(a, b) for a in g for b in o if a[1:] == b[1:] and M.ratcliff_ratio(a[0], b[0]) > 0.85]
        mg, mo = {a for a, _ in pairs}, {b for _, b in pairs}
        expected.append((d, True, len(mg), len(o - mo), len(g - mg)))
        missed += [(d, "truth", l, p, t) for t, l, p in g - mg] + [(d, "output", l, p, t) for t, l, p in o - mo]
    by_document = evaluate.eval_by_document(frame(gt), frame(out))
    assert rows(by_document) == sorted(expected, key=repr)
    assert rows(evaluate.heading_diff(frame(gt), frame(out))) == sorted(missed, key=repr)
    tp, fp, fn = (sum(e[i] for e in expected) for i in (2, 3, 4))
    assert tp and fp and fn
    overall = evaluate.eval_overall(by_document).first()
    assert abs(overall.precision - tp / (tp + fp)) < 1e-12 and abs(overall.recall - tp / (tp + fn)) < 1e-12
    assert overall.title_accuracy == 1.0


def test_nothing_to_score(spark):
    schema = "doc string, title string, headings array<struct<level:string,text:string,page:int,page_number:int>>, outline array<struct<level:string,text:string,page:int,page_number:int>>"
    a = spark.createDataFrame([("a", "T", None, [])], schema)
    b = spark.createDataFrame([("b", "T", None, None)], schema)
    none = evaluate.eval_overall(evaluate.eval_by_document(a, b)).first()
    assert (none.documents, none.tp, none.precision, none.f1, none.title_accuracy) == (0, 0, 0.0, 0.0, None)
    empty = evaluate.eval_by_document(a, a).first()
    assert (empty.title_correct, empty.tp, empty.fp, empty.fn) == (True, 0, 0, 0)


def test_strict_reads_only_headings(spark):
    schema = "doc string, title string, headings array<struct<level:string,text:string,page:int,page_number:int>>, outline array<struct<level:string,text:string,page:int,page_number:int>>"
    old = spark.createDataFrame([("a", "T", [("h1", "One", None, 3)], None)], schema)
    new = spark.createDataFrame([("a", "t ", None, [("H1", "one", 3, None)])], schema)
    assert tuple(evaluate.eval_by_document(old, new).first())[1:] == (True, 1, 0, 0)
    assert tuple(evaluate.eval_by_document(old, new, strict=True).first())[1:] == (True, 0, 0, 1)


def test_slabs_change_nothing(spark, rows):
    rng = random.Random(1)
    big = spark.createDataFrame([("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", i) for i in range(500)], "k string, i int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("none", "d")], "k string, v string")
    for how in ("inner", "left"):
        got = joins.slab_join(big, small, ["k"], "i", how=how, slab=16)
        assert got.select("slab").distinct().count() > 10
        assert rows(got, "k", "i", "v") == rows(big.join(small, "k", how), "k", "i", "v")


def test_label_counts_and_shares(spark, rows):
    schema = "title string, headings array<struct<level:string>>, outline array<struct<level:string>>"
    truth = spark.createDataFrame([("T", [("h1",)], [("H2",), (None,)]), ("", None, [("H2",)]), (None, None, None)], schema)
    assert rows(labeling.label_counts(truth)) == [("H1", 1), ("H2", 2), ("H3", 1), ("Title", 1)]
    df = spark.createDataFrame([("a",)] * 2 + [("b",)], "label string")
    assert rows(labeling.value_share(df, "label")) == [("a", 2, 0.667), ("b", 1, 0.333)]


def labelled(spark, body, heads):
    data = [(i, "Body") for i in range(body)] + [(body + i, "H1" if i % 3 else "H2") for i in range(heads)]
    return spark.createDataFrame(data, "id int, label string")


def test_balance_is_exact_and_repeatable(spark, rows):
    df = labelled(spark, 3000, 400)
    for ratio in (1, 2):
        first = sampling.balance(df, F.col("id"), ratio=ratio)
        got = rows(first)
        assert Counter(r[1] == "Body" for r in got) == {True: 400 * ratio, False: 400}
        assert len(set(got)) == len(got)
        again = sampling.balance(df.repartition(7), F.col("id"), ratio=ratio, shuffle=True)
        assert rows(again) == got
    assert rows(sampling.balance(labelled(spark, 5, 400), F.col("id"))) == rows(labelled(spark, 5, 400))
    assert rows(sampling.balance(labelled(spark, 50, 0), F.col("id"))) == []


def test_any_number_of_passes_gives_the_same_sample(spark, rows, monkeypatch):
    df = labelled(spark, 2000, 300)
    fine = rows(sampling.balance(df, F.col("id")))
    monkeypatch.setattr(sampling, "PASSES", 1)
    assert rows(sampling.balance(df, F.col("id"))) == fine


def test_split_is_exact_per_class(spark):
    df = labelled(spark, 1001, 301)
    train, test = sampling.stratified_split(df, "label", F.col("id"))
    counts = Counter(r.label for r in test.collect())
    assert counts == {"Body": 200, "H1": 40, "H2": 20}
    assert train.count() + test.count() == 1302
    assert train.join(test, "id", "left_semi").count() == 0


def test_confusion_and_report(spark):
    truth = ["a"] * 5 + ["b"] * 3 + ["c"] * 2
    guess = ["a", "a", "a", "b", "b", "b", "b", "a", "a", "b"]
    df = spark.createDataFrame(list(zip(truth, guess)), "label string, predicted string")
    cells = {(r.label, r.predicted): (r.n, round(r.share, 3)) for r in evaluate.confusion(df).collect()}
    assert cells[("a", "a")] == (3, 0.6) and cells[("c", "b")] == (1, 0.5)
    # A cell for every pair of classes, whether or not a row is in it.
    assert len(cells) == 9 and cells[("a", "c")] == (0, 0.0)
    unseen = spark.createDataFrame([("a", "z"), (None, "a")], "label string, predicted string")
    assert sorted(map(tuple, evaluate.confusion(unseen).collect())) == [
        ("a", "a", 0, 0.0), ("a", "z", 1, 1.0), ("z", "a", 0, 0.0), ("z", "z", 0, 0.0)]
    assert evaluate.confusion(df.limit(0)).count() == 0
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].support) == (0.6, 0.6, 5)
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0.0, 0.0, 0.0)
    assert report["accuracy"].f1 == 0.5 and report["macro avg"].support == 10
    assert abs(report["weighted avg"].recall - 0.5) < 1e-12


def test_truth_entries(spark, rows):
    schema = "doc string, title string, outline array<struct<level:string,text:string,page:int,page_number:int>>"
    df = spark.createDataFrame([("a", "T", [("H1", "x", 0, None), ("H2", "y", None, 4)]), ("b", "", None)], schema)
    assert rows(outline_files.truth_entries(df)) == [("a", 0, "H1", "x", 0), ("a", 1, "H2", "y", 4)]
    assert ("a", -1, "Title", "T", 1) in rows(outline_files.truth_entries(df, label_title=True))
