import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import retrieval as R
from quire.plans import jobs
from quire.sources import requests as Q
from tests import sequential

SECTIONS = "document string, section_no int, part_no int, section_title string, page_number int, content string"
REQUESTS = "request_id string, persona string, task string, documents array<struct<filename:string,title:string>>"


def corpus(spark, seed=4):
    rng = random.Random(seed)
    words = "plan menu dinner salad soup chicken travel hotel beach city museum train book water fire stone".split()
    sections = [
        (f"doc{d}", s, 0, " ".join(rng.choices(words, k=3)).title(), s, " ".join(rng.choices(words, k=rng.randint(3, 40))))
        for d in range(8) for s in range(1, 15)
    ]
    requests = [
        (f"r{i}", "Cook", " ".join(rng.choices(words, k=6)), [(f"doc{d}", "x") for d in rng.sample(range(9), 5)]) for i in range(6)
    ] + [("zero", "User", "unheard words only", [("doc1", "x")])]
    return spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(requests, REQUESTS), sections, requests


def words(text):
    return re.findall(r"\w\w+", text.lower())


def grams(text):
    w = words(text)
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def whole(section):
    return f"Title: {section[3]}. Content: {section[5]}"


def query_of(request):
    kept = [w for w in dict.fromkeys(words(request[2])) if w not in R.STOP_WORDS]
    return X.QUERY_TEMPLATE % (request[1], request[2], ", ".join(kept[:5]))


def naive_tfidf(sections, texts, requests, queries):
    counts = [grams(t) for t in texts]
    df = Counter(t for c in counts for t in c)
    n = len(counts)
    idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in df.items()}

    def vector(c):
        v = {t: k * idf[t] for t, k in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    held = [vector(c) for c in counts]
    scores = {}
    for request, query in zip(requests, queries):
        asked = vector(grams(query))
        for section, v in zip(sections, held):
            if section[0] in {d for d, _ in request[3]}:
                scores[(request[0], section[0], section[1])] = sum(x * v.get(t, 0.0) for t, x in asked.items())
    return scores


def test_tfidf_like_vectors(spark):
    found, requests, sections, asked = corpus(spark)
    queries = R.build_queries(requests)
    assert {r.request_id: r.query for r in queries.collect()} == {r[0]: query_of(r) for r in asked}
    text = X.retrieval_text(F.col("section_title"), F.col("content"), None)
    got = {
        (r.request_id, r.document, r.section_no): r.score
        for r in R.tfidf_scores(queries, found, Q.manifest(requests), text).collect()
    }
    expected = naive_tfidf(sections, [whole(s) for s in sections], asked, [query_of(r) for r in asked])
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_a_rare_word_decides(spark):
    words = ["menu salad soup", "train beach city"] * 40
    sections = [(f"doc{d}", s, f"Part {s}", 1, words[s] + (" zanzibar" if (d, s) in {(0, 17), (1, 5)} else "")) for d in range(2) for s in range(80)]
    found = spark.createDataFrame(sections, "document string, section_no int, section_title string, page_number int, content string")
    asked = spark.createDataFrame([("r", "Cook", "zanzibar", [("doc0", "x"), ("doc1", "x")])], REQUESTS)
    queries = R.build_queries(asked)
    scored = R.tfidf_scores(queries, found, Q.manifest(asked), F.col("content"), "requirements")
    best = R.retrieve(scored, 50).orderBy("rank").collect()
    assert [(r.document, r.section_no) for r in best[:2]] == [("doc0", 17), ("doc1", 5)] and best[1].score > 0 == best[2].score
    assert len(best) == 50 and scored.count() == 160
    assert R.requirement_scores(queries, found, Q.manifest(asked)).count() == 160


def test_popular_documents_are_spread(spark, rows, monkeypatch):
    found, requests, _, _ = corpus(spark)
    queries = R.build_queries(requests)
    whole = R.tfidf_scores(queries, found, Q.manifest(requests), F.col("content")).withColumn("score", F.round("score", 9))
    before = rows(whole)
    monkeypatch.setattr(R, "SLAB", 3)
    spread = R.tfidf_scores(queries, found, Q.manifest(requests), F.col("content")).withColumn("score", F.round("score", 9))
    assert rows(spread) == before


def test_bm25_like_the_formula(spark):
    found, requests, sections, asked = corpus(spark)
    queries = R.build_queries(requests)
    pairs = found.select(*R.SECTION_KEY).join(Q.manifest(requests), "document").withColumn("score", F.lit(0.25))
    text = X.retrieval_text(F.col("section_title"), F.col("content"), None)
    got = {(r.request_id, r.document, r.section_no): r.relevance for r in R.bm25(pairs, queries, found, text).collect()}
    texts = [words(whole(s)) for s in sections]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(t for w in texts for t in set(w))
    for request in asked:
        terms = set(words(query_of(request)))
        for s, w in zip(sections, texts):
            if s[0] not in {d for d, _ in request[3]}:
                continue
            tf = Counter(w)
            score = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
                for t in terms if tf[t]
            )
            assert abs(got.pop((request[0], s[0], s[1])) - score) < 1e-9
    assert not got


def test_diversity_like_the_greedy_walk(spark):
    rng = random.Random(2)
    rows = [
        (f"r{r}", f"d{rng.randint(0, 4)}", s, rng.choice([0.1, 0.2, 0.3, 0.4])) for r in range(120) for s in range(rng.randint(1, 12))
    ]
    df = spark.createDataFrame(rows, "request_id string, document string, section_no int, final_score double")
    got = {}
    for r in R.diversify(df).orderBy("request_id", "importance_rank").collect():
        got.setdefault(r.request_id, []).append((r.document, r.section_no))
    for request in {r[0] for r in rows}:
        scored = [(r[3], r[1], r[2]) for r in rows if r[0] == request]
        assert got[request] == sequential.diverse(scored, 2, 5), request


def test_lexicon_and_requirements(spark):
    df = spark.createDataFrame([("a", "u", "The planning of planned menus, MENUS and quick soup", [])], REQUESTS)
    assert R.with_keywords(df).first().keywords == ["planning", "planned", "menus", "quick", "soup"]
    lexicon = spark.createDataFrame(
        [("planning", "plan", "VERB"), ("planned", "plan", "VERB"), ("menus", "menu", "NOUN"), ("quick", "quick", "ADV")],
        "word string, lemma string, pos string",
    )
    built = R.build_queries(df, lexicon=lexicon).first()
    assert built.keywords == ["plan", "menu", "soup"] and built.requirements == "plan menu soup"


def test_requirement_scores_only_drop_on_request(spark):
    found, requests, _, _ = corpus(spark)
    queries = R.build_queries(requests)
    scored = R.requirement_scores(queries, found, Q.manifest(requests))
    kept = R.requirement_scores(queries, found, Q.manifest(requests), min_score=0.2)
    assert 0 < kept.count() < scored.count()


def test_vectors_in_slabs(spark, rows, monkeypatch):
    rng = random.Random(8)
    vectors = [(f"d{i % 2}", i, 0, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    found = spark.createDataFrame(vectors, "document string, section_no int, part_no int, embedding array<float>")
    asked = spark.createDataFrame([("r", [1.0, 0.0, 2.0, 0.0, -1.0])], "request_id string, embedding array<double>")
    listed = spark.createDataFrame([("r", "d0")], "request_id string, document string")
    got = {r.section_no: r.score for r in R.vector_scores(asked, found, listed).collect()}
    q = [1.0, 0.0, 2.0, 0.0, -1.0]
    assert len(got) == 30
    for _, i, _, v in vectors[::2]:
        expected = sum(a * b for a, b in zip(q, v)) / math.sqrt(sum(a * a for a in q)) / math.sqrt(sum(b * b for b in v))
        assert abs(got[i] - expected) < 1e-6


def test_ranked_results(spark):
    found, requests, sections, asked = corpus(spark)
    moment = F.lit("2025-07-01 10:15:00.5").cast("timestamp")
    results = {r.request_id: r for r in jobs.ranking_job(requests, found, now=moment).collect()}
    assert set(results) == {r[0] for r in asked}
    contents = {(s[0], s[3], s[2]): s[5] for s in sections}
    for request in asked:
        r = results[request[0]]
        assert list(r.metadata.input_documents) == [d for d, _ in request[3]]
        assert r.metadata.processing_timestamp == "2025-07-01T10:15:00.500000"
        assert [s.importance_rank for s in r.extracted_sections] == list(range(1, len(r.extracted_sections) + 1))
        assert max(Counter(s.document for s in r.extracted_sections).values()) <= 2
        for s, t in zip(r.extracted_sections, r.subsection_analysis):
            assert t.refined_text == contents[(s.document, s.section_title, 0)]
    assert len(results["r0"].extracted_sections) == 5 and len(results["zero"].extracted_sections) == 2


def test_own_scorer(spark):
    found, requests, _, _ = corpus(spark)
    queries = R.build_queries(requests)
    candidates = R.retrieve(R.tfidf_scores(queries, found, Q.manifest(requests), F.col("content")), 3)
    scored = R.rerank(candidates, queries, found, lambda query, text: F.length(text))
    blended = R.blend(scored).first()
    assert blended.final_score == 0.8 * blended.relevance + 0.2 * blended.score


def by_term(df):
    """The shuffles of a plan that deal rows by term."""
    return re.findall(r"Exchange hashpartitioning\([^)]*\bterm#[^)]*\)", df._jdf.queryExecution().executedPlan().toString())


def test_scores_do_not_hang_on_which_terms_are_common(spark, rows, monkeypatch):
    found, requests, _, _ = corpus(spark)
    queries = R.build_queries(requests)
    whole = rows(R.tfidf_scores(queries, found, Q.manifest(requests), F.col("content")).withColumn("score", F.round("score", 9)))
    for sample, most in ((2, 3), (20, 1), (10**6, 10**6)):
        monkeypatch.setattr(R, "SAMPLE", sample)
        monkeypatch.setattr(R, "HEAD", most)
        scored = R.tfidf_scores(queries, found, Q.manifest(requests), F.col("content"))
        assert rows(scored.withColumn("score", F.round("score", 9))) == whole


def test_repeated_and_missing_rows(spark, rows):
    """A section or a listing that is there twice counts twice; missing texts have no terms."""
    sections = [("d", 1, "T", 1, "red fox"), ("d", 1, "T", 1, "red hen"), ("d", 2, "T", 1, None), (None, 3, "T", 1, "red fox")]
    found = spark.createDataFrame(sections, "document string, section_no int, section_title string, page_number int, content string")
    queries = spark.createDataFrame([("r", "red fox"), ("n", None)], "request_id string, query string")
    listed = spark.createDataFrame([("r", "d"), ("r", "d"), ("n", "d"), ("r", "none"), (None, "d")], "request_id string, document string")
    got = {(r.request_id, r.section_no): r.score for r in R.tfidf_scores(queries, found, listed, F.col("content")).collect()}
    idf = {t: math.log(5 / (1 + df)) + 1 for t, df in {"red": 3, "fox": 2, "hen": 1, "red fox": 2, "red hen": 1}.items()}
    asked = math.sqrt(sum(idf[t] ** 2 for t in ("red", "fox", "red fox")))
    held = math.sqrt(sum(n * idf[t] ** 2 for t, n in (("red", 2), ("fox", 1), ("hen", 1), ("red fox", 1), ("red hen", 1))))
    dot = 2 * (2 * idf["red"] ** 2 + idf["fox"] ** 2 + idf["red fox"] ** 2)
    assert abs(got.pop(("r", 1)) - dot / asked / held) < 1e-9
    assert got == {("r", 2): 0.0, ("n", 1): 0.0, ("n", 2): 0.0, (None, 1): 0.0, (None, 2): 0.0}


def test_terms_meet_their_idf_only(spark):
    """Neither weights nor products of the sections' terms are shuffled as rows."""
    found, requests, _, _ = corpus(spark)
    queries, listed = R.build_queries(requests), Q.manifest(requests)
    assert by_term(R.tfidf_scores(queries, found, listed, F.col("content"))) == []
    pairs = found.select(*R.SECTION_KEY).join(listed, "document")
    dealt = by_term(R.bm25(pairs, queries, found, F.col("content")))
    assert dealt and not any("document" in keys for keys in dealt)


def test_rare_terms_go_in_few_rows():
    """Terms of a task are dealt as arrays, a row for a bucket; each was a row of its own."""
    import pyarrow as pa

    from quire.functions import counting as C

    rng = random.Random(5)
    texts = [[rng.choice(["ab", "cd", "ef", "straße", "x" * 40 + "y"]) if rng.random() < 0.6 else f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 60))] for _ in range(90)]
    texts[3] = None
    head = sorted(["ab", "cd", "ab cd", "ef", "cd ab"])
    asks = [at % 10 == 9 for at in range(90)]
    made = pa.RecordBatch.from_pydict({
        "request_id": [f"r{at}" if ask else None for at, ask in enumerate(asks)], "document": [None if ask else f"d{at}" for at, ask in enumerate(asks)],
        "section_no": pa.array([None if ask else at for at, ask in enumerate(asks)], pa.int32()), "words": pa.array(texts, pa.list_(pa.string())),
    })
    dealt = [row for part in (made.slice(0, 50), made.slice(50)) for row in C.rare_terms(iter([part.slice(0, 20), part.slice(20)]), C.head_of(head), len(head), 4)]
    assert sum(b.num_rows for b in dealt) <= 6 * 4
    table, n, alone = pa.Table.from_batches(dealt), sum(not a for a in asks), 2.5
    parts = [C.rare_weights(table.filter(pa.compute.equal(table["bucket"], bucket)), n, alone) for bucket in range(4)]
    got = [row for part in parts for row in part.to_pylist()]
    counts = [grams(" ".join(t or [])) for t in texts]
    df = Counter(term for own, ask in zip(counts, asks) if not ask for term in own)
    weight = {term: math.log((1 + n) / (1 + k)) + 1 for term, k in df.items()}
    assert {head[r["place"]]: r["df"] for r in got if r["place"] is not None} == {t: df[t] for t in head if df[t]}
    sections = Counter()
    for r in got:
        if r["document"] is not None:
            sections[r["document"]] += r["square"]
    for at, own in enumerate(counts):
        if not asks[at]:
            want = sum(tf * tf * (weight[t] ** 2 - alone ** 2) for t, tf in own.items() if t not in head and df[t] > 1)
            assert abs(sections.get(f"d{at}", 0.0) - want) < 1e-9
    wanted = {(r["request_id"], r["term"]): (round(r["pull"], 9), round(r["square"], 9)) for r in got if r["request_id"] is not None}
    assert wanted == {
        (f"r{at}", t): (round(tf * weight[t] ** 2, 9), round((tf * weight[t]) ** 2, 9))
        for at, own in enumerate(counts) if asks[at] for t, tf in own.items() if t not in head and df[t]
    }


def test_words_meet_all_pairs_of_a_section_at_once():
    """A section's words are counted once however many requests ask for it."""
    import pyarrow as pa

    from quire.functions import counting as C

    asked = [[{"request_id": f"r{i}", "terms": ["ab", "zz"], "idfs": [1.5, 9.0]} for i in range(5)], [{"request_id": "s", "terms": None, "idfs": None}]]
    batch = pa.RecordBatch.from_pydict({
        "document": ["a", "b"], "section_no": [1, 2], "words": [["ab", "cd", "ab"], ["ab"]], "asked": asked, "_mean": [2.0, 2.0],
    })
    found = pa.Table.from_batches(C.bm25_gains(iter([batch]), ["request_id", "document", "section_no", "gain"], 1.2, 0.75)).to_pylist()
    gain = 1.5 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert [(r["request_id"], r["document"], round(r["gain"], 9)) for r in found] == [*((f"r{i}", "a", round(gain, 9)) for i in range(5)), ("s", "b", 0.0)]
