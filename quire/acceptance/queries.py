"""One query per operator or group of operators; each takes (spark, folder of the tables)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.acceptance import inputs as I
from quire.functions import text as X, vectors as V
from quire.operators import (
    evaluate, labeling, layout, models, outline, retrieval, rules, sampling, sections as sections_,
)
from quire.plans import jobs
from quire.profiles import BODY, SECTION_PROFILE
from quire.session import settled, shared_folder
from quire.sources import datasets, object_files, outline_files, pages, records, requests as request_files

LINE = ["doc", "page_number", "line_no"]
BASE_DATE = "2025-07-01"


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits)


# Lines and text features

def line_features(spark: SparkSession, folder: str) -> DataFrame:
    lines = pages.text_features(I.plain_lines(spark, folder))
    return lines.select(*LINE, "text", "word_count", "char_count", "is_all_caps", "starts_with_number")


def layout_features(spark: SparkSession, folder: str) -> DataFrame:
    """All sixteen features, worked out inside the page rows."""
    lines = pages.feature_lines(I.text_pages(spark, folder))
    return lines.select(
        *LINE, "body_size", "relative_font_size", "word_count", "is_prev_line_blank", "is_next_line_blank",
        "font_size_diff_prev", "font_size_diff_next",
    )


def page_tree_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = pages.lines_from_pages(pages.pages_from_trees(I.page_trees(spark, folder)))
    return lines.select(*LINE, "text", "font_size", "font_name", "is_bold", "x_position", "y_position")


def span_rows(spark: SparkSession, folder: str) -> DataFrame:
    spans = pages.spans_from_page_trees(I.page_trees(spark, folder))
    return spans.groupBy("font_size", "font_name", "is_bold", "x_position", "word_count").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_counts(I.page_trees(spark, folder))


def html_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pages.lines_from_html(I.table(spark, folder, "pages"))


# Page statistics

def page_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    q = layout.page_quantiles(I.plain_lines(spark, folder))
    return q.select("doc", "page_number", rounded("q25").alias("q25"), rounded("q75").alias("q75"))


def body_size(spark: SparkSession, folder: str) -> DataFrame:
    return layout.body_size(I.plain_lines(spark, folder))


def relative_size(spark: SparkSession, folder: str) -> DataFrame:
    return layout.with_body_size(I.plain_lines(spark, folder)).select(*LINE, "body_size", "relative_font_size")


def neighbor_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return layout.neighbor_features(I.plain_lines(spark, folder)).select(
        *LINE, "font_size_diff_prev", "is_prev_line_blank", "font_size_diff_next", "is_next_line_blank"
    )


# Rules, outlines, sections

def rule_demote_a(spark: SparkSession, folder: str) -> DataFrame:
    return rules.demote(I.scored_lines(spark, folder)).select(*LINE, "level")


def rule_demote_b(spark: SparkSession, folder: str) -> DataFrame:
    return rules.demote(I.scored_lines(spark, folder), SECTION_PROFILE).select(*LINE, "level")


def level_clamp(spark: SparkSession, folder: str) -> DataFrame:
    return outline.clamp_levels(rules.demote(I.scored_lines(spark, folder))).select(*LINE, "level")


def adjacent_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Repeats among the unfiltered levels, where the tables have some."""
    kept = outline.drop_adjacent_duplicates(I.scored_lines(spark, folder))
    return kept.select(*LINE, "level")


def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    return outline.titles(I.cleaned_lines(spark, folder))


def outline_headings(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outline_entries(I.cleaned_lines(spark, folder))


def _shown_outlines(found: DataFrame) -> DataFrame:
    shown = F.transform("outline", lambda e: F.concat_ws("|", e["level"], e["page"].cast("string"), e["text"]))
    return found.select("doc", "title", F.size("outline").alias("n"), F.array_join(shown, "\n").alias("entries"))


def outlines(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_outlines(I.found_outlines(spark, folder))


def outline_objects(spark: SparkSession, folder: str) -> DataFrame:
    return outline_files.outline_json(I.found_outlines(spark, folder))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return I.found_sections(spark, folder)


def fallback_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of an outline without a classifier: a title by size, no headings."""
    lines = pages.text_features(I.plain_lines(spark, folder))
    return _shown_outlines(jobs.outlines_from_scored(lines.withColumn("level", F.lit(BODY))))


# Files written and read again

def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def outline_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines through files of many objects, each over many lines."""
    path = _new_folder(spark, "outline-stream")
    objects = F.to_json(F.struct("doc", "title", "outline"), {"pretty": "true"})
    I.found_outlines(spark, folder).select(objects.alias("value")).write.text(path)
    return _shown_outlines(outline_files.read_outlines(spark, path)[0])


def outline_document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines through one file for each document."""
    path = _new_folder(spark, "outline-files")
    outline_files.write_outline_files(I.found_outlines(spark, folder), path)
    return _shown_outlines(outline_files.read_outlines(spark, path)[0])


def corpus_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of files that hold a document's text each."""
    path = _new_folder(spark, "corpus")
    spark.dataSource.register(object_files.OneFileEach)
    texts = I.table(spark, folder, "documents").select(F.concat(F.lit("doc "), "doc_id", F.lit(".v1")).alias("name"), F.col("text").alias("value"))
    texts.write.format(object_files.OneFileEach.name()).mode("overwrite").save(path)
    listed = pages.list_corpus(spark, path, "*.json")
    name = F.url_decode(F.replace(X.file_stem(F.col("path")), F.lit("+"), F.lit("%2B")))
    return listed.select(name.alias("name"), F.col("length").alias("bytes"))


def request_reader(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as request files, a third without a role, read back as requests and rejects."""
    path = _new_folder(spark, "requests")
    spark.dataSource.register(object_files.OneFileEach)
    turns = I.table(spark, folder, "conversations").withColumn("name", F.concat_ws("-", "conv_id", "turn"))
    role = F.when(F.col("turn") % 3 != 0, F.col("role"))
    request = F.to_json(F.struct(
        F.array(F.struct(F.col("name").alias("filename"), F.col("role").alias("title"))).alias("documents"),
        F.struct(role.alias("role")).alias("persona"),
        F.struct(F.when(F.col("turn") % 5 != 4, F.col("text")).alias("task")).alias("job_to_be_done"),
    ))
    cut = F.when(F.col("turn") % 7 == 6, F.expr("left(value, length(value) - 3)")).otherwise(F.col("value"))
    turns.withColumn("value", request).select("name", cut.alias("value")).write.format(object_files.OneFileEach.name()).mode("overwrite").save(path)
    good, rejects = request_files.read_requests(spark, path)
    return good.select(
        "request_id", "persona", "task", F.col("documents")[0]["filename"].alias("first_document"), F.lit("read").alias("verdict")
    ).unionByName(rejects.select(
        "request_id", F.lit(None).cast("string").alias("persona"), F.lit(None).cast("string").alias("task"),
        F.lit(None).cast("string").alias("first_document"), F.col("reason").alias("verdict"),
    ))


def labelled_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows through CSV, texts with quotes, blanks and line breaks, some missing."""
    path = _new_folder(spark, "labelled-csv")
    rows = I.labelled_documents(spark, folder).withColumns({
        "page_number": F.col("doc_id").cast("int"),
        "text": F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit(' "a", '), "text", F.lit("\n\n b\t"))),
        "font_name": F.when(F.col("doc_id") % 5 != 0, F.col("font_name")),
    })
    datasets.write_labelled(rows, path)
    read = datasets.read_labelled(spark, path)
    return read.select("page_number", "text", "font_name", "font_size", "word_count", "char_count", "is_bold", "label")


# Labels and samples

def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Fuzzy labels; truth pages count from 1 here, so no offset."""
    labelled = labeling.label_lines(I.plain_lines(spark, folder), I.truth_headings(spark, folder))
    return labelled.select(*LINE, "text", "label")


def label_lines_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Only equal texts count; the truth is moved a page back and the offset undoes it."""
    truth = I.truth_headings(spark, folder).withColumn("page", F.col("page") - 1)
    labelled = labeling.label_lines(I.plain_lines(spark, folder), truth, threshold=99.9999999, page_offset=1)
    return labelled.select(*LINE, "label")


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return labeling.label_counts(I.truth_outlines(spark, folder))


def value_share(spark: SparkSession, folder: str) -> DataFrame:
    return labeling.value_share(I.table(spark, folder, "labels"), "quality")


def balance_body(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.balance(I.table(spark, folder, "labels"), F.col("doc_id"), label="quality", body=1)


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.with_split(I.table(spark, folder, "labels"), "quality", F.col("doc_id"))


# Evaluation

def _outlines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return settled(I.truth_outlines(spark, folder)), settled(I.output_outlines(spark, folder))


def eval_documents(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.eval_by_document(*_outlines(spark, folder))


def eval_documents_exact(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.eval_by_document(*_outlines(spark, folder), exact=True)


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluate.eval_overall(eval_documents_exact(spark, folder))
    return scores.withColumns({c: rounded(c) for c in ("precision", "recall", "f1", "title_accuracy")})


def eval_missed(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.heading_diff(*_outlines(spark, folder), exact=True)


def eval_missed_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.heading_diff(*_outlines(spark, folder))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    cells = evaluate.confusion(I.table(spark, folder, "labels"), "quality", "toxic")
    return cells.withColumn("share", rounded("share"))


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluate.class_report(I.table(spark, folder, "labels"), "quality", "toxic")
    return report.withColumns({c: rounded(c) for c in ("precision", "recall", "f1")})


# Retrieval

def manifest_found(spark: SparkSession, folder: str) -> DataFrame:
    corpus = I.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("document"))
    return request_files.found_documents(I.requests(spark, folder), corpus)


def manifest_missing(spark: SparkSession, folder: str) -> DataFrame:
    corpus = I.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("document"))
    return request_files.missing_documents(I.requests(spark, folder), corpus)


def request_queries(spark: SparkSession, folder: str) -> DataFrame:
    built = retrieval.build_queries(I.requests(spark, folder))
    return built.select(
        "request_id", F.array_join("keywords", " ").alias("keywords"), "query", "requirements"
    )


def retrieval_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The two section texts at their default widths, which are part of their definition."""
    title, content = F.col("section_title"), F.col("content")
    return I.found_sections(spark, folder).select(
        "document", "section_no",
        X.requirement_text(title, content).alias("requirement_text"),
        X.retrieval_text(title, content).alias("retrieval_text"),
    )


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    best = retrieval.retrieve(retrieval.vector_scores(*I.vectors(spark, folder)))
    return best.select("request_id", "document", "section_no", "rank", rounded("score").alias("score"))


def diverse_topk(spark: SparkSession, folder: str) -> DataFrame:
    best = retrieval.retrieve(retrieval.vector_scores(*I.vectors(spark, folder)))
    chosen = retrieval.diversify(best, score="score")
    return chosen.select("request_id", "document", "section_no", "importance_rank", rounded("score").alias("score"))


def _ranking(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = I.requests(spark, folder)
    return asked, retrieval.build_queries(asked), settled(I.found_sections(spark, folder))


def _whole_text() -> Column:
    return X.retrieval_text(F.col("section_title"), F.col("content"), None)


RANKED = ["request_id", "document", "section_no"]


def tfidf_rank(spark: SparkSession, folder: str) -> DataFrame:
    asked, queries, found = _ranking(spark, folder)
    scored = retrieval.tfidf_scores(queries, found, request_files.manifest(asked), _whole_text())
    return retrieval.retrieve(scored).select(*RANKED, "rank", rounded("score").alias("score"))


def requirement_scores(spark: SparkSession, folder: str) -> DataFrame:
    asked, queries, found = _ranking(spark, folder)
    scored = retrieval.requirement_scores(queries, found, request_files.manifest(asked), chars=None)
    return scored.select(*RANKED, rounded("semantic_score").alias("semantic_score"))


def bm25_rank(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 of every section of the listed documents."""
    asked, queries, found = _ranking(spark, folder)
    pairs = found.select(*retrieval.SECTION_KEY).join(request_files.manifest(asked), "document")
    scored = retrieval.bm25(pairs, queries, found, _whole_text())
    return retrieval.retrieve(scored, score="relevance").select(*RANKED, "rank", rounded("relevance").alias("relevance"))


def blend_rank(spark: SparkSession, folder: str) -> DataFrame:
    asked, _, found = _ranking(spark, folder)
    chosen = retrieval.rank_sections(asked, found, chars=None, store=settled)
    return chosen.select(*RANKED, "importance_rank", rounded("final_score").alias("final_score"))


def ranked_results(spark: SparkSession, folder: str) -> DataFrame:
    asked, _, found = _ranking(spark, folder)
    chosen = retrieval.rank_sections(asked, found, chars=None, store=settled)
    moment = F.lit(f"{BASE_DATE} 10:15:00").cast("timestamp")
    results = retrieval.assemble_results(chosen, asked, found, moment)
    line = F.transform("extracted_sections", lambda s: F.concat_ws(
        "|", s["importance_rank"].cast("string"), s["document"], s["page_number"].cast("string"), s["section_title"]))
    return results.select(
        "request_id",
        F.array_join("metadata.input_documents", ",").alias("input_documents"),
        F.col("metadata.persona").alias("persona"),
        F.col("metadata.job_to_be_done").alias("job_to_be_done"),
        F.col("metadata.processing_timestamp").alias("processing_timestamp"),
        F.array_join(line, "\n").alias("extracted_sections"),
        F.array_join(F.transform("subsection_analysis", lambda s: s["refined_text"]), "\n").alias("refined_texts"),
    )


# Models and records

def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.labelled_documents(spark, folder).select("label")
    weight = models.class_weight(rows, "label")
    return rows.withColumn("weight", rounded(weight)).groupBy("label", "weight").agg(F.count("*").alias("n"))


def label_index(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the classes, as training gives them."""
    rows = I.labelled_documents(spark, folder).select("doc_id", "label")
    indexed = models.label_indexer(rows, "label").transform(rows)
    return indexed.select("doc_id", "label", F.col(models.LABEL_INDEX).cast("int").alias("index"))


def _model_features(rows: DataFrame) -> tuple[DataFrame, PipelineModel]:
    """Rows with the parts of the feature vector that a fit on all of them makes, and the fit."""
    rows = models.model_rows(rows)
    fitted = models.fit_features(rows)
    # The last two stages put the parts together and drop them.
    return PipelineModel(fitted.stages[:-2]).transform(rows), fitted


def imputed_features(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers with the median in place of missing ones; some are made missing."""
    rows = I.labelled_documents(spark, folder).withColumns({
        "font_size": F.when(F.col("doc_id") % 7 != 0, F.col("font_size")),
        "x_position": F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") * 37 % 1000 / 4),
        "char_count": F.when(F.col("doc_id") % 3 != 0, F.col("char_count")),
    })
    made, _ = _model_features(rows)
    return made.select("doc_id", *[F.col(f"{c}_filled").alias(c) for c in ("font_size", "x_position", "word_count", "char_count")])


def font_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The slot that a row's font sets."""
    made, _ = _model_features(I.labelled_documents(spark, folder))
    slots = F.unwrap_udt("font_vector")
    return made.select(
        "doc_id", slots["indices"][0].alias("slot"), F.size(slots["indices"]).alias("n_set"), slots["values"][0].alias("value")
    )


def text_features_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Each term of the classifier's vocabulary with the rows that have it and its weight in all."""
    made, fitted = _model_features(I.labelled_documents(spark, folder))
    terms = [stage.vocabulary for stage in fitted.stages if hasattr(stage, "vocabulary")][1]
    slots = F.unwrap_udt("text_vector")
    weights = made.select(F.explode(F.arrays_zip(slots["indices"].alias("slot"), slots["values"].alias("weight"))).alias("e"))
    sums = weights.groupBy(F.col("e.slot").alias("slot")).agg(
        F.count("*").alias("n_rows"), rounded(F.sum("e.weight"), 5).alias("weight")
    )
    names = spark.createDataFrame(list(enumerate(terms)), "slot int, term string")
    return names.join(sums, "slot").select("term", "slot", "n_rows", "weight")


def argmax_class(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector read as scores of classes: the best class and its score."""
    rows = I.table(spark, folder, "embeddings").withColumn("scores", F.col("embedding").cast("array<double>"))
    size = rows.select(F.max(F.size("scores"))).first()[0] or 1
    return rows.select(
        "vec_id", V.predicted_class(F.col("scores"), [f"c{i:04d}" for i in range(size)]).alias("level"),
        rounded(V.confidence(F.col("scores"))).alias("confidence"),
    )


def train_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Hold-out classes and confidences of the stacked classifier at its default sizes."""
    _, held_out = jobs.training_job(I.labelled_documents(spark, folder), F.col("doc_id"))
    return held_out.select("doc_id", "label", "predicted", rounded("confidence").alias("confidence"))


def train_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``train_stack`` trains on and those that it holds out."""
    rows = I.labelled_documents(spark, folder).select("doc_id", "label")
    return sampling.with_split(rows, "label", F.col("doc_id"))


def synth_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per customer."""
    return records.synth_records(I.table(spark, folder, "customer"), BASE_DATE, "c_custkey")


QUERIES = [
    line_features, layout_features, page_tree_lines, span_rows, page_counts, html_lines,
    page_quantiles, body_size, relative_size, neighbor_gaps,
    rule_demote_a, rule_demote_b, level_clamp, adjacent_dedupe,
    document_titles, outline_headings, outlines, outline_objects, sections,
    fallback_outlines, outline_stream, outline_document_files, corpus_listing, request_reader, labelled_csv,
    label_lines, label_lines_exact, label_counts, value_share, balance_body, stratified_split,
    eval_documents, eval_documents_exact, eval_metrics, eval_missed, eval_missed_fuzzy, confusion, class_report,
    manifest_found, manifest_missing, request_queries, retrieval_texts, cosine_topk, diverse_topk,
    tfidf_rank, requirement_scores, bm25_rank, blend_rank, ranked_results,
    class_weights, label_index, imputed_features, font_one_hot, text_features_tfidf, argmax_class, train_holdout, train_stack, synth_records,
]
