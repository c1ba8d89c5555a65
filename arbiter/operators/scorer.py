"""Scorers: one protocol for linear scorers and fitted MLlib models.

Every scorer has ``name``, ``features`` and
``apply(df, cols, p, pred)``: score ``df`` with some features replaced by the
column expressions in ``cols``, add the probability (or value) ``p`` and the
prediction ``pred``, and keep all columns of ``df``.  The explanation, what-if
and counterfactual operators use nothing else, so they run with any model.

A linear scorer is also a column expression (``columnar``), so operators that
try many changes of one row can do so inside the row (JVM, codegen), without
exploding it.

Scorers have ``n_classes`` (0 for a regression) and ``apply_classes(df, cols, prob)``, which adds the array of all classes'
probabilities.  With more than two classes ``pred`` is the class with the highest one (ties: the lowest class) and
``p`` its probability; ``for_class(k)`` is the same scorer with ``p`` = P(class k).

Linear scorers also take numpy arrays, one a feature (``p_of``, ``probs_of``), for operators that try very many changes of one
row inside a task; they are the expressions of ``p`` and ``probs``, term by term.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearScorer:
    """Logistic (or identity) link over named feature columns."""
    name: str
    coef: dict[str, float]
    intercept: float = 0.0
    link: str = "logistic"
    threshold: float = 0.5
    features: tuple = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "features", tuple(self.coef))

    def z(self, cols: dict[str, Column] | None = None) -> Column:
        cols = cols or {}
        acc = F.lit(float(self.intercept))
        for f, c in self.coef.items():
            acc = acc + F.lit(float(c)) * cols.get(f, F.col(f)).cast("double")
        return acc

    def p(self, cols: dict[str, Column] | None = None) -> Column:
        z = self.z(cols)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if self.link == "logistic" else z

    def pred(self, cols: dict[str, Column] | None = None) -> Column:
        return (self.p(cols) >= F.lit(self.threshold)).cast("int")

    def z_of(self, x: Mapping[str, np.ndarray]) -> np.ndarray:
        acc = np.float64(self.intercept)
        for f, c in self.coef.items():
            acc = acc + float(c) * x[f]
        return acc

    def p_of(self, x: Mapping[str, np.ndarray]) -> np.ndarray:
        z = self.z_of(x)
        return 1.0 / (1.0 + np.exp(-z)) if self.link == "logistic" else z

    def probs_of(self, x: Mapping[str, np.ndarray]) -> list[np.ndarray]:
        p = self.p_of(x)
        return [1 - p, p]

    columnar = True

    @property
    def n_classes(self) -> int:
        return 2 if self.link == "logistic" else 0

    def apply(self, df: DataFrame, cols: dict[str, Column] | None = None, p: str = "p",
              pred: str = "pred") -> DataFrame:
        return df.select("*", self.p(cols).alias(p), self.pred(cols).alias(pred))

    def apply_classes(self, df: DataFrame, cols: dict[str, Column] | None = None, prob: str = "prob") -> DataFrame:
        p = self.p(cols)
        return df.select("*", F.array(1 - p, p).alias(prob))

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("z", self.z()).withColumn("p", self.p()).withColumn("pred", self.pred())

    def sql_z(self, alias: str = "") -> str:
        a = f"{alias}." if alias else ""
        return f"({self.intercept!r}" + "".join(f" + ({c!r}) * CAST({a}{f} AS DOUBLE)"
                                               for f, c in self.coef.items()) + ")"

    def sql_p(self, alias: str = "") -> str:
        return f"(1.0 / (1.0 + exp(-{self.sql_z(alias)})))" if self.link == "logistic" else self.sql_z(alias)

    def sql_pred(self, alias: str = "") -> str:
        return f"CAST({self.sql_p(alias)} >= {self.threshold!r} AS INTEGER)"


@dataclass(frozen=True)
class SoftmaxScorer:
    """Multinomial logistic scorer: one linear form a class, over the same named feature columns."""
    name: str
    coef: tuple[dict[str, float], ...]
    intercept: tuple[float, ...]
    target: int | None = None

    columnar = True

    @property
    def features(self) -> tuple:
        return tuple(self.coef[0])

    @property
    def n_classes(self) -> int:
        return len(self.coef)

    def for_class(self, k: int) -> SoftmaxScorer:
        return replace(self, target=k)

    def _logits(self, cols: dict[str, Column] | None) -> list[Column]:
        return [LinearScorer(self.name, c, b).z(cols) for c, b in zip(self.coef, self.intercept)]

    def probs(self, cols: dict[str, Column] | None = None) -> Column:
        return F.array(*[self.for_class(k).p(cols) for k in range(self.n_classes)])

    def p(self, cols: dict[str, Column] | None = None) -> Column:
        if self.target is None:
            return F.array_max(self.probs(cols))
        z = self._logits(cols)
        return F.lit(1.0) / sum((F.exp(x - z[self.target]) for x in z), F.lit(0.0))

    def probs_of(self, x: Mapping[str, np.ndarray]) -> list[np.ndarray]:
        z = [LinearScorer(self.name, c, b).z_of(x) for c, b in zip(self.coef, self.intercept)]
        return [1.0 / sum(np.exp(y - own) for y in z) for own in z]

    def p_of(self, x: Mapping[str, np.ndarray]) -> np.ndarray:
        p = self.probs_of(x)
        return np.maximum.reduce(p) if self.target is None else p[self.target]

    def pred(self, cols: dict[str, Column] | None = None) -> Column:
        z = self._logits(cols)
        return (F.array_position(F.array(*z), F.greatest(*z)) - 1).cast("int")

    def apply(self, df: DataFrame, cols: dict[str, Column] | None = None, p: str = "p",
              pred: str = "pred") -> DataFrame:
        return df.select("*", self.p(cols).alias(p), self.pred(cols).alias(pred))

    def apply_classes(self, df: DataFrame, cols: dict[str, Column] | None = None, prob: str = "prob") -> DataFrame:
        return df.select("*", self.probs(cols).alias(prob))

    def sql_z(self, k: int, alias: str = "") -> str:
        return LinearScorer(self.name, self.coef[k], self.intercept[k]).sql_z(alias)

    def sql_p(self, k: int, alias: str = "") -> str:
        return f"(1.0 / ({' + '.join(f'exp({self.sql_z(j, alias)} - {self.sql_z(k, alias)})' for j in range(self.n_classes))}))"

    def sql_pred(self, alias: str = "") -> str:
        z = [self.sql_z(k, alias) for k in range(self.n_classes)]
        return f"CAST(CASE {' '.join(f'WHEN {x} = greatest({chr(44).join(z)}) THEN {k}' for k, x in enumerate(z))} END AS INTEGER)"


class ModelScorer:
    """A fitted MLlib model (a pipeline that assembles its own vector) over named feature columns.

    ``p`` is the probability of class 1 for a binary classifier, the highest class
    probability for more classes (``pred`` is then the class), the predicted value for a
    regression (``pred`` too).
    """

    columnar = False

    def __init__(self, name: str, model, features, threshold: float = 0.5, task: str = "classification", target: int | None = None):
        self.name, self.model, self.features = name, model, tuple(features)
        self.threshold, self.task, self.target = threshold, task, target

    @property
    def n_classes(self) -> int:
        return self.model.stages[-1].numClasses if self.task == "classification" else 0

    def for_class(self, k: int) -> ModelScorer:
        return ModelScorer(self.name, self.model, self.features, self.threshold, self.task, k)

    def _transform(self, df: DataFrame, cols: dict[str, Column] | None) -> DataFrame:
        cols = cols or {}
        return self.model.transform(df.select(F.struct("*").alias("_row"), *[cols.get(f, F.col(f)).alias(f) for f in self.features]))

    def apply(self, df: DataFrame, cols: dict[str, Column] | None = None, p: str = "p",
              pred: str = "pred") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        out = self._transform(df, cols)
        if self.task != "classification":
            return out.select("_row.*", F.col("prediction").alias(p), F.col("prediction").alias(pred))
        prob = vector_to_array("probability")
        binary = F.size(prob) == 2
        shown = F.get(prob, F.lit(self.target)) if self.target is not None else F.when(binary, F.get(prob, F.lit(1))).otherwise(F.array_max(prob))
        return out.select("_row.*", shown.alias(p),
                          F.when(binary, (F.get(prob, F.lit(1)) >= F.lit(self.threshold)).cast("int"))
                          .otherwise(F.col("prediction").cast("int")).alias(pred))

    def apply_classes(self, df: DataFrame, cols: dict[str, Column] | None = None, prob: str = "prob") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        return self._transform(df, cols).select("_row.*", vector_to_array("probability").alias(prob))

    def score(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


class OneHotScorer:
    """A model over label codes that takes one-hot columns instead.

    ``groups``: categorical feature -> its categories in code order.  The features are the model's numeric ones and a
    column ``<feature>_<category>`` for each category; a row's code is that of the first column that is 1, and 0 (the code of
    unseen labels) if none is.
    """

    def __init__(self, model, groups: dict[str, list[str]]):
        self.model, self.groups = model, {f: list(c) for f, c in groups.items()}
        self.name, self.columnar = model.name, model.columnar
        self.features = tuple(x for f in model.features for x in ([f"{f}_{c}" for c in self.groups[f]] if f in self.groups else [f]))

    @property
    def n_classes(self) -> int:
        return self.model.n_classes

    def codes(self, cols: dict[str, Column] | None = None) -> dict[str, Column]:
        """The model's features as expressions of the one-hot columns."""
        cols = cols or {}
        out = {f: cols[f] for f in self.model.features if f in cols}
        for f, categories in self.groups.items():
            hit = [F.when(cols.get(f"{f}_{c}", F.col(f"`{f}_{c}`")).cast("double") == 1, F.lit(float(i))) for i, c in enumerate(categories)]
            out[f] = F.coalesce(*hit, F.lit(0.0))
        return out

    def p(self, cols: dict[str, Column] | None = None) -> Column:
        return self.model.p(self.codes(cols))

    def pred(self, cols: dict[str, Column] | None = None) -> Column:
        return self.model.pred(self.codes(cols))

    def apply(self, df: DataFrame, cols: dict[str, Column] | None = None, p: str = "p", pred: str = "pred") -> DataFrame:
        return self.model.apply(df, self.codes(cols), p, pred)

    def apply_classes(self, df: DataFrame, cols: dict[str, Column] | None = None, prob: str = "prob") -> DataFrame:
        return self.model.apply_classes(df, self.codes(cols), prob)


def onehot_groups(columns, categorical) -> dict[str, list[str]]:
    """Categories of one-hot columns, found by the prefix ``<feature>_`` (the longest feature that fits), in column order."""
    groups: dict[str, list[str]] = {f: [] for f in categorical}
    for c in columns:
        fits = [f for f in categorical if c.startswith(f"{f}_")]
        if fits:
            f = max(fits, key=len)
            groups[f].append(c[len(f) + 1:])
    return {f: c for f, c in groups.items() if c}


def linear_from_model(name: str, model, features, threshold: float = 0.5) -> LinearScorer:
    """The linear scorer of a fitted binary logistic or linear regression over ``features`` (in the order
    of its vector), so that a trained model gets the in-row forms too."""
    logistic = hasattr(model, "numClasses")
    if logistic and model.numClasses != 2:
        raise ValueError("a linear scorer needs a binary model")
    return LinearScorer(name, dict(zip(features, [float(c) for c in model.coefficients])), float(model.intercept),
                        "logistic" if logistic else "identity", threshold)
