"""arbiter: Spark-native decision analytics.

DataFrame-in / DataFrame-out operators for profiling tables, preparing
features, scoring and evaluating models, sweeping decision thresholds,
pricing errors, estimating confidence, checking data quality, explaining
and simulating predictions, mapping predictions to actions and keeping an
append-only audit log (batch and Structured Streaming).
"""

__version__ = "0.1.0"
