"""Ranking of sections for many requests at once.

Requests only ever meet sections of documents they list. A text is shuffled to where it meets them, and
its terms are counted there; only terms that few sections have become rows, for their idf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from quire.functions import counting, text as X, vectors as V
from quire.operators.joins import SLAB, slab_join
from quire.session import settled
from quire.sources.requests import manifest

# Candidates kept for reranking, weights of the two scores, sections per document and in all.
CANDIDATES = 30
RERANK_WEIGHT = 0.8
RETRIEVAL_WEIGHT = 0.2
PER_DOCUMENT = 2
TOP_SECTIONS = 5

# Vocabulary bounds of the classifier's text features; ranking has none.
MIN_DOCUMENTS = 2
MAX_SHARE = 0.95

# Customary BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75

SECTION_KEY = ["document", "section_no"]

# English function words left out of keywords.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both "
    "but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its just me more most my myself no nor not now of off on once only or other our "
    "ours out over own same she should so some such than that the their theirs them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your "
    "yours"
).split()


def keywords(task: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct content words of a task in the order they first appear."""
    return F.array_except(F.array_distinct(X.terms(task)), F.array(*[F.lit(w) for w in stop_words]))


def with_keywords(
    requests: DataFrame, stop_words: Sequence[str] = STOP_WORDS, lexicon: DataFrame | None = None
) -> DataFrame:
    """Requests with their ``keywords``.

    ``lexicon`` (word, lemma, pos), if given, replaces words by lemmas and keeps only nouns,
    adjectives, proper nouns and verbs; words it lacks are kept as they are.
    """
    found = requests.withColumn("keywords", keywords(F.col("task"), stop_words))
    if lexicon is None:
        return found
    words = found.select("request_id", F.posexplode("keywords").alias("at", "word"))
    known = words.join(lexicon.select("word", "lemma", "pos"), "word", "left")
    content = F.col("pos").isNull() | F.col("pos").isin("NOUN", "ADJ", "PROPN", "VERB")
    lemmas = known.filter(content).groupBy("request_id").agg(
        F.array_distinct(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", F.coalesce("lemma", "word").alias("lemma")))),
                lambda w: w["lemma"],
            )
        ).alias("lemmas")
    )
    none = F.array().cast("array<string>")
    return found.join(lemmas, "request_id", "left").withColumn("keywords", F.coalesce("lemmas", none)).drop("lemmas")


def build_queries(requests: DataFrame, stop_words: Sequence[str] = STOP_WORDS, lexicon: DataFrame | None = None) -> DataFrame:
    """Requests with keywords, the query sentence and the requirement words."""
    words = F.col("keywords")
    return with_keywords(requests, stop_words, lexicon).withColumns({
        "query": X.query_text(F.col("persona"), F.col("task"), words),
        "requirements": X.requirement_query(words),
    })


def vocabulary(
    counts: DataFrame, n_items: Column, size: int, min_items: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """The ``size`` most frequent terms found in enough but not too many items, with smoothed idf."""
    return (
        counts.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        .filter((F.col("df") >= min_items) & (F.col("df") <= max_share * n_items))
        .orderBy(F.desc("total"), "term")
        .limit(size)
        .select("term", (F.log((1 + n_items) / (1 + F.col("df"))) + 1).alias("idf"))
    )


#: Copies of a term's weight over which the items that have it are spread.
SALTS = 16

#: Sections in which common terms are looked for, and terms that every task holds. Which terms these
#: are decides where a weight is worked out, not what it is.
SAMPLE, HEAD = 20_000, 100_000

#: Requests that a section's words meet at a time, and characters of the sections for a bucket of terms.
LOT, BUCKET = 16, 8_000_000


def _words(rows: DataFrame, text: Column, *keep: str | Column) -> DataFrame:
    return rows.select(*keep, X.terms(text).alias("words"))


def _head(sections: DataFrame, n_items: int, section_text: Column) -> list[str]:
    """Terms that many sections have: at most ``HEAD``, those that most of a sample of sections have.
    The others are in few of them each, so that shuffling by term stays even."""
    step = max(1, n_items // SAMPLE)
    sample = sections.filter(F.pmod(F.xxhash64(*SECTION_KEY), F.lit(step)) == 0)
    found = _words(sample, section_text).mapInArrow(counting.item_frequencies, "term string, df long")
    often = found.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 1").orderBy(F.desc("df"), "term").limit(HEAD)
    return sorted(r.term for r in often.select("term").collect())


def tfidf_scores(
    queries: DataFrame, sections: DataFrame, listed: DataFrame, section_text: Column, query: str = "query",
) -> DataFrame:
    """Cosine of request and section weights for every section of the documents each request lists;
    0 for those without a common term.

    Every term of the sections counts, however rare or common; idf comes from all sections. Weights of
    common terms are worked out where the texts are, with a bounded table that every task holds. Only
    the other terms are shuffled, once, as 96 bits each: for their idf, which the requests' terms need,
    and the lengths of the sections do for all that another section has too. The same pass counts the
    sections that have a common term. Products are summed up where a section meets the requests that
    list it, so that no product is a row. ``sections`` are counted at once.
    """
    spark, n_items = sections.sparkSession, sections.count()
    terms = _head(sections, n_items, section_text)
    alone = math.log((1 + n_items) / 2) + 1
    head = spark.sparkContext.broadcast((counting.head_of(terms), len(terms)))

    asked = queries.filter(F.col("request_id").isNotNull())
    none = {field.name: F.lit(None).cast(field.dataType) for field in sections.select(*SECTION_KEY).schema}
    name = F.lit(None).cast(queries.schema["request_id"].dataType)
    words = _words(sections, section_text, name.alias("request_id"), *SECTION_KEY).unionByName(
        _words(asked, F.col(query), "request_id", *[nothing.alias(key) for key, nothing in none.items()])
    )
    keys = [T.StructField(field.name, field.dataType) for field in words.drop("words").schema.fields]
    buckets = max(1, math.ceil((sections.agg(F.sum(F.length(section_text))).first()[0] or 0) / BUCKET))
    dealt = words.mapInArrow(lambda batches: counting.rare_terms(batches, *head.value, buckets), T.StructType([
        T.StructField("bucket", T.IntegerType()), *[T.StructField(key.name, T.ArrayType(key.dataType)) for key in keys],
        T.StructField("term", T.ArrayType(T.StringType())), *[T.StructField(name, T.BinaryType()) for name in counting.ENTRIES],
    ]))
    # A section's length starts from terms that no other section has; here is what others differ by.
    met = dealt.groupBy("bucket").applyInArrow(lambda rows: counting.rare_weights(rows, n_items, alone), T.StructType([
        *keys, T.StructField("term", T.StringType()), T.StructField("place", T.LongType()), T.StructField("df", T.LongType()),
        T.StructField("pull", T.DoubleType()), T.StructField("square", T.DoubleType()),
    ]))
    met = settled(met.groupBy("request_id", *SECTION_KEY, "term", "place").agg(
        F.sum("pull").alias("pull"), F.sum("square").alias("square"), F.max("df").alias("df")
    ))
    of_request, of_head = F.col("request_id").isNotNull(), F.col("place").isNotNull()
    counted = {r.place: r.df for r in met.filter(of_head).select("place", "df").collect()}
    idf = spark.sparkContext.broadcast([math.log((1 + n_items) / (1 + counted[at])) + 1 for at in range(len(terms))])
    others = met.filter(~of_request & ~of_head).select(*SECTION_KEY, F.col("square").alias("others"))
    wanted = _wanted(_words(asked, F.col(query), "request_id"), met.filter(of_request), head, idf)

    spread = _spread(sections, listed)
    times = listed.groupBy("request_id", "document").agg(F.count("*").alias("times")).join(wanted, "request_id", "left")
    place = ["document", "slab", "share"]
    asking = _in_lots(_split_requests(times, spread), place, ["request_id", "times", "length", "common", "terms", "pulls"])
    texts = sections.select(*SECTION_KEY, section_text.alias("text"))
    held = _split_sections(texts, spread).repartition(*place)
    held = held.withColumn("words", X.terms(F.col("text"))).drop("text")
    pairs = held.join(asking, place).select(*SECTION_KEY, "words", "asked")
    schema = T.StructType([
        *keys, T.StructField("times", T.LongType()), *[T.StructField(name, T.DoubleType()) for name in ("length", "dot", "square")],
    ])
    dots = pairs.mapInArrow(
        lambda batches: counting.dot_products(batches, head.value[0], idf.value, alone), schema
    ).groupBy("request_id", *SECTION_KEY).agg(
        F.sum(F.col("dot") * F.col("times")).alias("dot"), F.sum("square").alias("square"), F.max("length").alias("length")
    )
    length = F.sqrt(F.col("square") + F.coalesce("others", F.lit(0.0)))
    cosine = F.try_divide("dot", length * F.col("length"))
    return dots.join(others, SECTION_KEY, "left").select("request_id", *SECTION_KEY, F.coalesce(cosine, F.lit(0.0)).alias("score"))


def _in_lots(rows: DataFrame, place: list[str], columns: list[str]) -> DataFrame:
    """The rows of a place as lists of a few, ``asked``."""
    lots = F.sequence(F.lit(0), F.floor((F.size("asked") - 1) / LOT).cast("int"))
    return rows.groupBy(*place).agg(F.collect_list(F.struct(*columns)).alias("asked")).select(
        *place, F.explode(F.transform(lots, lambda at: F.slice("asked", at * LOT + 1, LOT))).alias("asked")
    )


def _wanted(words: DataFrame, rare: DataFrame, head: Broadcast, idf: Broadcast) -> DataFrame:
    """For each request the numbers of its terms of the ``head``, its ``rare`` terms with what they add
    to a dot product, and its length."""
    common = words.mapInArrow(
        lambda batches: counting.common_terms(batches, head.value[0]),
        T.StructType([words.schema["request_id"], T.StructField("common", T.ArrayType(T.IntegerType()))]),
    )

    @F.arrow_udf("double")
    def square(lists: pa.Array) -> pa.Array:
        return counting.squares(lists, idf.value)

    common = common.withColumn("square", square("common"))
    both = common.select("request_id", "common", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("pull"), "square")
    both = both.unionByName(rare.select("request_id", F.lit(None).cast("array<int>").alias("common"), "term", "pull", "square"))
    return both.groupBy("request_id").agg(
        F.flatten(F.collect_list("common")).alias("common"),
        F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "pull"))).alias("others"),
        F.sqrt(F.sum("square")).alias("length"),
    ).select("request_id", "common", F.col("others.term").alias("terms"), F.col("others.pull").alias("pulls"), "length")


def _spread(sections: DataFrame, listed: DataFrame) -> DataFrame:
    """How far the rows of huge and popular documents are spread: slabs of the sections, shares of the
    requests that list one. Others have one of each and no row here, so that these are few."""
    slabs = sections.groupBy("document").agg(F.floor(F.max("section_no") / SLAB).cast("int").alias("last_slab"))
    shares = listed.groupBy("document").agg(F.ceil(F.count("*") / SLAB).cast("int").alias("shares"))
    return slabs.join(shares, "document").filter("last_slab <> 0 OR shares > 1")


def _with_spread(rows: DataFrame, spread: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(spread), "document", "left").withColumns({
        "last_slab": F.coalesce("last_slab", F.lit(0)), "shares": F.coalesce("shares", F.lit(1)),
    })


def _split_sections(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows of sections in their slab, copied to each share of the requests."""
    share = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    cut = _with_spread(rows, spread).withColumn("share", share)
    return cut.withColumn("slab", F.floor(F.col("section_no") / SLAB).cast("int")).drop("last_slab", "shares")


def _split_requests(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows of requests in their share, copied to each slab of the sections."""
    slab = F.explode(F.sequence(F.lit(0), "last_slab"))
    cut = _with_spread(rows, spread).withColumn("slab", slab)
    return cut.withColumn("share", F.pmod(F.hash("request_id"), "shares")).drop("last_slab", "shares")


def vector_scores(queries: DataFrame, sections: DataFrame, listed: DataFrame, vector: str = "embedding") -> DataFrame:
    """Cosine of stored request and section vectors for the documents each request lists. Vectors
    are brought to length 1 once per row, so a pair costs one dot product."""
    held = sections.select(*SECTION_KEY, V.unit(F.col(vector)).alias("held"))
    asked = queries.select("request_id", V.unit(F.col(vector)).alias("asked")).join(listed, "request_id")
    pairs = slab_join(held, asked, ["document"], "section_no")
    return pairs.select("request_id", *SECTION_KEY, V.dot(F.col("held"), F.col("asked")).alias("score"))


def requirement_scores(
    queries: DataFrame, sections: DataFrame, listed: DataFrame, min_score: float | None = None,
    chars: int | None = X.REQUIREMENT_CHARS,
) -> DataFrame:
    """Similarity of the requirement words to title and opening of each section. Later steps do not
    use it; sections are only dropped where ``min_score`` asks for it."""
    text = X.requirement_text(F.col("section_title"), F.col("content"), chars)
    scored = tfidf_scores(queries, sections, listed, text, query="requirements")
    scored = scored.withColumnRenamed("score", "semantic_score")
    return scored if min_score is None else scored.filter(F.col("semantic_score") >= min_score)


def by_score(score: str) -> list[Column]:
    """Best first, then document order. Scores are compared to nine digits: the last bits of a
    distributed sum depend on the order of its parts, and equal texts must tie."""
    return [F.round(score, 9).desc(), F.col("document"), F.col("section_no")]


def best_first(score: str) -> WindowSpec:
    return Window.partitionBy("request_id").orderBy(*by_score(score))


def retrieve(scored: DataFrame, k: int = CANDIDATES, score: str = "score") -> DataFrame:
    """The ``k`` best sections per request with their rank."""
    return scored.withColumn("rank", F.row_number().over(best_first(score))).filter(F.col("rank") <= k)


def bm25(
    pairs: DataFrame, queries: DataFrame, sections: DataFrame, section_text: Column, query: str = "query",
    k1: float = BM25_K1, b: float = BM25_B,
) -> DataFrame:
    """BM25 of every (request, section) pair in ``pairs``; a pair without a common word gets 0.

    A pair takes the request's words with their idf to the text of its section and is summed up there,
    so that no word of a pair is a row. The other sections only give document frequencies.
    """
    found = _words(sections, section_text).mapInArrow(counting.word_frequencies, "term string, df long")
    stats = sections.agg(
        F.struct(F.count("*").alias("n"), F.avg(F.size(X.terms(section_text))).alias("length")).alias("stats")
    ).scalar()
    df, n = F.col("df"), stats["n"]
    asked = queries.select("request_id", F.explode(F.array_distinct(X.terms(F.col(query)))).alias("term"))
    # A common word is in most requests: its weight is copied to each salt the requests are spread over.
    known = (
        found.groupBy("term").agg(F.sum("df").alias("df"))
        .join(asked.select("term").distinct(), "term", "left_semi")
        .select("term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = asked.withColumn("salt", F.pmod(F.hash("request_id"), F.lit(SALTS)))
    weighted = salted.join(known, ["term", "salt"]).groupBy("request_id").agg(
        F.collect_list(F.struct("term", "idf")).alias("_asked")
    ).select("request_id", F.col("_asked.term").alias("terms"), F.col("_asked.idf").alias("idfs"))
    # Pairs of a section that very many requests list are dealt to copies of it; few sections are.
    shares = pairs.groupBy(*SECTION_KEY).agg(F.ceil(F.count("*") / SLAB).cast("int").alias("_shares")).filter("_shares > 1")
    shares = F.broadcast(shares)
    held = (
        sections.select(*SECTION_KEY, section_text.alias("_text")).join(shares, SECTION_KEY, "left")
        .withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
        # So many even where the texts are small: the work on them is not.
        .repartition(int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SECTION_KEY, "_share")
        .withColumn("words", X.terms(F.col("_text"))).drop("_text")
    )
    wanted = pairs.join(shares, SECTION_KEY, "left").withColumn(
        "_share", F.pmod(F.hash("request_id"), F.coalesce("_shares", F.lit(1)))
    ).join(weighted, "request_id", "left")
    others = [c for c in pairs.columns if c not in SECTION_KEY]
    asking = _in_lots(wanted, [*SECTION_KEY, "_share"], [*others, "terms", "idfs"])
    met = held.join(asking, [*SECTION_KEY, "_share"]).select(*SECTION_KEY, "words", "asked", stats["length"].alias("_mean"))
    schema = pairs.withColumn("gain", F.lit(None).cast("double")).schema
    gains = met.mapInArrow(
        lambda batches: counting.bm25_gains(batches, schema.names, k1, b),
        T.StructType([T.StructField(field.name, field.dataType) for field in schema]),
    )
    return gains.unionByName(pairs.withColumn("gain", F.lit(0.0))).groupBy(*pairs.columns).agg(F.sum("gain").alias("relevance"))


def rerank(
    candidates: DataFrame, queries: DataFrame, sections: DataFrame,
    scorer: str | Callable[[Column, Column], Column] = "bm25", chars: int | None = X.RETRIEVAL_CHARS,
) -> DataFrame:
    """Candidates with ``relevance``, by BM25 or by a function of query and section text such as a
    ``predict_batch_udf``."""
    text = X.retrieval_text(F.col("section_title"), F.col("content"), chars)
    if scorer == "bm25":
        return bm25(candidates, queries, sections, text)
    rows = candidates.join(sections.select(*SECTION_KEY, text.alias("_text")), SECTION_KEY).join(
        queries.select("request_id", F.col("query").alias("_query")), "request_id"
    )
    return rows.select(*candidates.columns, scorer(F.col("_query"), F.col("_text")).cast("double").alias("relevance"))


def blend(ranked: DataFrame, rerank_weight: float = RERANK_WEIGHT, retrieval_weight: float = RETRIEVAL_WEIGHT) -> DataFrame:
    return ranked.withColumn("final_score", rerank_weight * F.col("relevance") + retrieval_weight * F.col("score"))


def diversify(
    ranked: DataFrame, per_document: int = PER_DOCUMENT, k: int = TOP_SECTIONS, score: str = "final_score"
) -> DataFrame:
    """Best ``k`` sections per request with at most ``per_document`` of one document, ranked from 1."""
    of_document = Window.partitionBy("request_id", "document").orderBy(*by_score(score))
    few = ranked.withColumn("_n", F.row_number().over(of_document)).filter(F.col("_n") <= per_document).drop("_n")
    return few.withColumn("importance_rank", F.row_number().over(best_first(score))).filter(
        F.col("importance_rank") <= k
    )


def assemble_results(chosen: DataFrame, requests: DataFrame, sections: DataFrame, now: Column | None = None) -> DataFrame:
    """One result object per request that found sections: metadata, ranked sections, full contents."""
    keys = chosen.select("request_id", *SECTION_KEY, "importance_rank")
    detail = keys.join(sections.select(*SECTION_KEY, "section_title", "page_number", "content"), SECTION_KEY)
    row = F.struct("importance_rank", "document", "section_title", "page_number", "content")
    grouped = detail.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    moment = X.iso_timestamp(F.current_timestamp() if now is None else now)
    return grouped.join(requests, "request_id").select(
        "request_id",
        F.struct(
            F.transform("documents", lambda d: d["filename"]).alias("input_documents"),
            F.col("persona").alias("persona"),
            F.col("task").alias("job_to_be_done"),
            moment.alias("processing_timestamp"),
        ).alias("metadata"),
        F.transform("rows", lambda r: F.struct(
            r["document"].alias("document"), r["section_title"].alias("section_title"),
            r["importance_rank"].alias("importance_rank"), r["page_number"].alias("page_number"),
        )).alias("extracted_sections"),
        F.transform("rows", lambda r: F.struct(
            r["document"].alias("document"), r["content"].alias("refined_text"), r["page_number"].alias("page_number"),
        )).alias("subsection_analysis"),
    )


def rank_sections(
    requests: DataFrame, sections: DataFrame, scorer: str | Callable[[Column, Column], Column] = "bm25",
    chars: int | None = X.RETRIEVAL_CHARS, store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole ranking: retrieve, rerank, blend, diversify. ``store``, if given, is applied to the
    candidates: a few rows per request that take the whole corpus to find and are read several
    times."""
    queries = build_queries(requests)
    text = X.retrieval_text(F.col("section_title"), F.col("content"), chars)
    candidates = retrieve(tfidf_scores(queries, sections, manifest(requests), text))
    candidates = store(candidates) if store else candidates
    return diversify(blend(rerank(candidates, queries, sections, scorer, chars)))
