"""All queries on the engine's operators, and their SQL."""

from __future__ import annotations

from lorekeep.plans import queries as q
from lorekeep.plans.sql import ORACLE_SQL, oracle_sql

NAMES = (
    "hybrid_retrieve hybrid_all_lanes dense_topk lexical_topk neighbor_expand router_boosts define_lane define_debug graph_boosts "
    "index_hint_boosts text_keys title_keys question_terms concept_phrases page_segments chunk_windows chunk_pages section_islands "
    "section_synopses section_edges concept_edges see_also_edges doc_summaries document_notes enrich_sections index_entries "
    "history_budget history_rejects request_errors thread_depth prompt_budget prompt_text ask_results format_results "
    "citation_resolve near_ids provenance_pick citation_alignment snippet_focus answer_reconcile model_outputs eval_score "
    "grounded_results change_gate chunk_ranges scanned_only library_catalog"
).split()
QUERIES = {name: getattr(q, name) for name in NAMES}

# queries that take a stated set of questions as ``every``
SEARCHES = tuple(n for n in NAMES if "every" in getattr(q, n).__code__.co_varnames[: getattr(q, n).__code__.co_argcount])

__all__ = ["NAMES", "ORACLE_SQL", "QUERIES", "SEARCHES", "oracle_sql"]
