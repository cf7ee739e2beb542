"""All queries over the reference's own operators."""

from __future__ import annotations

from tracegrain.plans import code_queries, inference_queries, panel_queries, rate_queries, state_queries, trace_queries  # noqa: F401  they register themselves
from tracegrain.plans.registry import ORACLES, QUERIES  # noqa: F401
