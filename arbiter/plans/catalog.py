"""All registered queries (importing the binding modules fills the registry)."""

from arbiter.plans import (q_decide, q_decision, q_eval, q_explain, q_models, q_prep, q_profile,  # noqa: F401
                           q_shapley, q_stream, q_whatif)
from arbiter.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
