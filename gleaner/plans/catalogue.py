"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from gleaner.plans import corpus_plans, graph_plans, log_plans, retrieval_plans, text_plans  # noqa: F401
from gleaner.plans.base import QUERIES, SQL  # noqa: F401
