"""All registered queries."""

from __future__ import annotations

from dwellstat.plans import batch_queries, cleaning_queries, flow_queries, model_queries, rating_queries, sampling_queries  # noqa: F401
from dwellstat.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
