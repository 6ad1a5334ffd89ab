"""Parameters of ingest and retrieval."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults of the engine; every operator takes what it needs from here."""

    data_dir: str = "./data"
    embed_model: str = dataclasses.field(default_factory=lambda: os.environ.get("EMBED_MODEL", "nomic-embed-text"))
    top_k: int = 10
    neighbor_window: int = 1
    excerpt_budget: int = 3800
    candidate_pool: int = 96
    lexical_weight: float = 0.2
    lexical_top: int = 24
    max_per_document: int = 2
    neighbor_expand_top: int = 3
    provenance_per_document: int = 2
    index_hint_boost: float = 0.07
    doc_router_weight: float = 0.0
    graph_seeds: int = 24
    graph_per_hit: int = 3
    graph_weight: float = 0.0
    graph_edge_types: tuple[str, ...] = ("defines", "references", "see_also")
    define_weight: float = 0.0
    define_top: int = 12
    history_budget: int = 1500
    target_tokens: int = 300
    overlap_tokens: int = 40
    section_tokens: int = 700
    reorder_blend: float = 0.48


# fixed values: the keys of a configuration file
KEYS = {
    "dataDir": "data_dir",
    "embedModel": "embed_model",
    "historyBudget": "history_budget",
    "retrieveTopK": "top_k",
    "retrieveNeighborWindow": "neighbor_window",
    "retrieveExcerptTokenBudget": "excerpt_budget",
    "retrieveCandidatePool": "candidate_pool",
    "retrieveLexicalWeight": "lexical_weight",
    "retrieveHybridLexicalTopK": "lexical_top",
    "retrieveMaxChunksPerDocument": "max_per_document",
    "retrieveNeighborExpandTop": "neighbor_expand_top",
    "retrieveProvenanceMaxPerDocument": "provenance_per_document",
    "retrieveIndexHintBoost": "index_hint_boost",
    "retrieveDocRouterWeight": "doc_router_weight",
    "retrieveGraphSeedCount": "graph_seeds",
    "retrieveGraphExpandPerHit": "graph_per_hit",
    "retrieveGraphExpandWeight": "graph_weight",
    "retrieveGraphEdgeTypes": "graph_edge_types",
    "retrieveDefineConceptWeight": "define_weight",
    "retrieveDefineConceptMaxChunks": "define_top",
}


def load_params(path: str | None = None) -> Params:
    """The parameters of a JSON file over the defaults; the defaults where there is no such file.

    Unknown keys are passed over; a value of another type than its default is an error, so a mistyped file never passes silently.
    """
    if path is None or not os.path.exists(path):
        return Params()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a JSON object")
    base, given = Params(), {}
    for key, name in KEYS.items():
        if key not in found:
            continue
        value, default = found[key], getattr(base, name)
        if isinstance(default, tuple):
            good = isinstance(value, list) and all(isinstance(x, str) for x in value)
            value = tuple(value) if good else value
        elif isinstance(default, str):
            good = isinstance(value, str)
        else:
            good = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not good:
            raise ValueError(f"{key}: {found[key]!r} is no value for it")
        given[name] = value
    return dataclasses.replace(base, **given)
