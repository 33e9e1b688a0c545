"""All queries of the engine but those of the training-data subpackage."""

from __future__ import annotations

from pagelattice.plans import greedy_queries, image_queries, lines, neighbourhoods, projections, regions, texts  # noqa: F401
from pagelattice.plans.neighbourhoods import flagship  # noqa: F401
from pagelattice.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
