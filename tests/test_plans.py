import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import quire
from quire.acceptance import inputs as I
from quire.operators import layout, outline, retrieval, rules, sampling
from quire.sources import pages
from tests.check_oracles import compare
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan(df)))


def test_features_take_no_shuffle(spark):
    text = plan(pages.feature_lines(I.text_pages(spark, SMALL)))
    assert "Exchange" not in text and "Python" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)
    trees = plan(pages.lines_from_page_trees(I.page_trees(spark, SMALL)))
    assert "Exchange" not in trees and "Python" not in trees


def test_page_windows_share_one_shuffle(spark):
    lines = layout.neighbor_features(layout.with_body_size(I.plain_lines(spark, SMALL)))
    assert exchanges(lines) == 1


def test_line_rows_are_shuffled_once_for_clamp_and_repeats(spark):
    scored = I.scored_lines(spark, SMALL)
    cleaned = outline.flag_adjacent_duplicates(outline.clamp_levels(rules.demote(scored)))
    text = plan(cleaned)
    # One for the lines, one for what the blocks are summed up from, one or two for the block rows.
    assert "Python" not in text and exchanges(cleaned) <= 4
    assert len(re.findall(r"REPARTITION_BY_COL", text)) == 2


def test_top_candidates_are_cut_before_the_shuffle(spark):
    best = retrieval.retrieve(retrieval.vector_scores(*I.vectors(spark, SMALL)))
    text = plan(best)
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_samples_do_not_move_rows(spark):
    """In the whole plan, subqueries included, nothing but counts is shuffled."""
    labels = I.table(spark, SMALL, "labels")
    for df in (
        sampling.balance(labels, F.col("doc_id"), label="quality", body=1),
        sampling.with_split(labels, "quality", F.col("doc_id")),
    ):
        text = plan(df)
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text and "CartesianProduct" not in text
        lines = [re.sub(r"^[\s:|*+\-()0-9]*", "", line) for line in text.splitlines()]
        shuffles = [lines[at + 1] for at, line in enumerate(lines) if line.startswith("Exchange")]
        assert len(shuffles) >= 8
        for child in shuffles:  # partial counts, or what became of counts
            assert re.match(r"(Object|Sort)?HashAggregate|SortAggregate", child), child


def test_no_query_plans_a_cross_join(spark):
    for name in ("label_lines", "eval_documents", "cosine_topk", "bm25_rank", "tfidf_rank"):
        text = plan(entry.queries()[name](spark, SMALL))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc", "title", "n", "entries"] and df.count() == 200


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own - set(entry.oracle_sql()) - {"outlines", "outline_headings", "outline_objects"} == {"train_stack"}


@pytest.mark.parametrize("name", [
    "line_features", "layout_features", "page_tree_lines", "span_rows", "html_lines", "rule_demote_b", "level_clamp", "outline_objects",
    "sections", "label_lines_exact", "balance_body", "eval_missed", "class_report", "diverse_topk", "blend_rank", "synth_records",
])
def test_query_equals_its_sql(spark, name):
    verdict = compare(spark, SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("equal"), verdict


def test_exported_names_are_found_when_asked_for():
    assert set(quire._HOMES) <= set(dir(quire))
    assert all(getattr(quire, name) is not None for name in quire._HOMES)
    assert not hasattr(quire, "no_such_name")
    loaded = subprocess.run(
        [sys.executable, "-c", "import sys, quire.session; print('pandas' in sys.modules, 'pyspark.ml' in sys.modules)"],
        capture_output=True, text=True, check=True, cwd=Path(quire.__file__).parents[1],
    )
    assert loaded.stdout.split() == ["False", "False"]
