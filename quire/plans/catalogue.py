"""The registered queries with their SQL equivalents."""

from __future__ import annotations

from quire.operators import accounts, align, classify, context, contracts, decode, folds, headings, intervals, letterhead, lines, locate, normalization, operations, outline, packages, parts, reader, rope, rules, segments, spans, structure  # noqa: F401  registers their queries
from quire.plans.registry import ORACLES, QUERIES, Query
from quire.streaming import sessions, tasks  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
