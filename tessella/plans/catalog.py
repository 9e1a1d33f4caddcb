"""Registered queries of the engine, with their oracle SQL."""

from __future__ import annotations

from . import answers, checks, content, corpus, docs, episodes, evaluation, files, gates, graphs, knowledge, more, normalise, retrieval, rules, shapes, stores, texts, traces  # noqa: F401  they register their queries
from .registry import ORACLES, PLANS


def queries() -> dict:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
