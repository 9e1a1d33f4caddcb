"""Frozen policy of the retrieval methods."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """Depths and weights that all methods share."""

    chunk_chars: int = 1400
    overlap_chars: int = 180
    retrieval_depth: int = 50
    collapse_depth: int = 250
    results: int = 10
    rrf_constant: int = 60
    routes: int = 4
    rerank_depth: int = 45
    seeds: int = 5
    neighbours: int = 10
    discovered: int = 50
    hops: int = 2
    graph_weight: float = 0.25
    hop_decay: float = 0.5
    edge_hits: int = 1500
    k1: float = 1.5
    b: float = 0.75
    degree_cap: int = 20


POLICY = Policy()
