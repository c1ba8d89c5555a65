"""Spark bindings against their DuckDB oracles on the smallest tables (a cross-area sample;
``scripts/oracle_check.py`` runs every key)."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

from oracle_check import rows  # noqa: E402

from arbiter.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = ["cost_optimal_threshold", "thr_sweep", "thr_roc_curve", "thr_pr_curve", "eval_auc", "eval_all_models",
        "eval_auc_ovr", "eval_regression", "conf_reliability", "conf_distribution", "profile_summary",
        "profile_numeric", "profile_top_values", "view_topn_other", "prep_stratified_split", "prep_full",
        "dq_drift_ks", "dq_report", "decide_actions", "audit_statistics", "audit_log_batch",
        "explain_permutation", "explain_sampled_shapley", "whatif_build", "whatif_recommend", "cf_find",
        "cf_multiple", "registry_completeness", "stream_audit_stats", "src_synth_churn"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    import __spark_entry__ as E
    sp = E.queries()[key](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[key]).df()
    c1, r1 = rows(sp)
    c2, r2 = rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
