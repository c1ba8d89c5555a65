"""All registered queries of this subpackage."""

from arbiter.llm import (chaining, credentials, decontaminate, divergence, factorization, jaccard_join, kneser_ney,  # noqa: F401
                         licenses, ordinal, pieces, risk_rules, token_files, vector_codes)
from arbiter.llm.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
