"""The fixed linear scorers used by the explanation, what-if and counterfactual queries."""

from arbiter.operators.scorer import LinearScorer, SoftmaxScorer

# fixed values: coefficients of the two reference scorers (scaled numerics, label codes)
LINEAR_A = LinearScorer("linear_a", {"o_totalprice": 1.5, "c_acctbal": 0.3, "o_custkey": -0.2,
                                     "c_mktsegment": 0.1, "o_orderstatus": -0.25}, intercept=0.0)
LINEAR_B = LinearScorer("linear_b", {"o_totalprice": 0.8, "c_acctbal": 0.5, "o_custkey": 0.0,
                                     "c_mktsegment": -0.1, "o_orderstatus": 0.2}, intercept=-0.2)
# a three-class scorer over the same features
SOFTMAX = SoftmaxScorer("softmax", ({"o_totalprice": 1.1, "c_acctbal": 0.2, "o_custkey": -0.3, "c_mktsegment": 0.05, "o_orderstatus": -0.2},
                                    {"o_totalprice": -0.4, "c_acctbal": 0.6, "o_custkey": 0.1, "c_mktsegment": -0.1, "o_orderstatus": 0.15},
                                    {"o_totalprice": -0.7, "c_acctbal": -0.5, "o_custkey": 0.25, "c_mktsegment": 0.08, "o_orderstatus": 0.1}),
                        (0.1, 0.3, 0.05))
FEATURES = list(LINEAR_A.features)
NUMERIC = ["o_totalprice", "c_acctbal", "o_custkey"]
CATEGORICAL = ["c_mktsegment", "o_orderstatus"]
