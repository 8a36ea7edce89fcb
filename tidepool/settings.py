"""Defaults of the retrieval pipeline, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    rrf_k: int = 60
    overfetch: int = 3
    boost_title: float = 0.12
    boost_section: float = 0.08
    boost_source_type: float = 0.03
    boost_most: float = 0.20
    rerank_title: float = 0.35
    rerank_content: float = 0.08
    top_k_most: int = 12
    top_k_least: int = 3
    top_k_gap: float = 0.12
    top_k_coverage: int = 2
    context_tokens: int = 4096
    context_share: float = 0.8
    parent_window: int = 3
    parent_chars: int = 2400
    low_information_chars: int = 12
    graph_edges: int = 96
    graph_entities: int = 48
    graph_threshold: float = 0.40
    paragraph_chars: int = 800
    chunk_chars: int = 900
    chunk_overlap: int = 120
    embedding_dims: int = 384


DEFAULTS = Settings()
