"""Document structure and retrieval on Spark: every function takes and returns DataFrames.

Names are imported when they are first used, so that a Python worker loads only the modules that its
functions come from: with all of them it needs 45 MB more.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

_EXPORTS = {
    "quire.operators.evaluate": (
        "class_report confusion eval_by_document eval_overall heading_diff heading_keys match_headings "
        "title_matches"
    ),
    "quire.operators.joins": "slab_join",
    "quire.operators.labeling": "label_counts label_lines value_share",
    "quire.operators.layout": "align_features body_size neighbor_features page_quantiles with_body_size",
    "quire.operators.models": (
        "TrainingPlan class_weight fit_features fit_line_classifier load_model save_model score_lines"
    ),
    "quire.operators.outline": (
        "clamp_levels drop_adjacent_duplicates flag_adjacent_duplicates outline_entries outlines titles"
    ),
    "quire.operators.retrieval": (
        "assemble_results blend bm25 build_queries diversify keywords rank_sections requirement_scores "
        "rerank retrieve tfidf_scores vector_scores"
    ),
    "quire.operators.rules": "demote",
    "quire.operators.sampling": "balance stratified_split with_split",
    "quire.operators.sections": "sections with_section",
    "quire.plans.jobs": (
        "dataset_job evaluation_job outline_job outlines_from_scored ranking_job section_job training_job"
    ),
    "quire.profiles": "OUTLINE_PROFILE SECTION_PROFILE Profile",
    "quire.session": "local_session settled",
    "quire.sources.datasets": "read_labelled write_labelled",
    "quire.sources.objects": "read_objects",
    "quire.sources.outline_files": (
        "as_outline_files outline_json read_outlines truth_entries write_outline_files write_outlines"
    ),
    "quire.sources.pages": (
        "feature_lines lines_from_html lines_from_page_trees lines_from_pages lines_from_text list_corpus "
        "page_counts pages_from_text pages_from_trees read_page_trees spans_from_page_trees text_features"
    ),
    "quire.sources.records": "numbered_records record_truth synth_records",
    "quire.sources.requests": "found_documents manifest missing_documents read_requests write_results",
}
_HOMES = {name: module for module, names in _EXPORTS.items() for name in names.split()}


def __getattr__(name: str) -> Any:
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOMES[name]), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *_HOMES])
