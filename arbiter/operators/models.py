"""Model fitting and scoring with MLlib pipelines.

The fitted unit is a ``PipelineModel``: label indexers (alphabetical codes,
as the reference's encoder), a population-std scaler written as a
``SQLTransformer`` with the fitted statistics, a ``VectorAssembler`` and
the estimator - so a saved model scores raw rows by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators.common import refused
from arbiter.operators.encoders import TableIndexer
from arbiter.operators.prep import scaler_stats

# fixed values: the reference's model settings
SEED = 42
LOGREG_MAX_ITER = 1000
MAX_LABELS = 10_000                # labels an indexer may collect; columns with more have a joined label table
FOREST_TREES, FOREST_DEPTH = 100, 10

# execution settings (not model semantics): keep each row's current tree node
# cached (checkpointed every 10 iterations in the shared folder) instead of
# re-walking the trees, and give the split-statistics aggregation 1 GB per pass
# so a depth-10 level splits in fewer passes over the data
FOREST_EXECUTION = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 1024}
FOREST_ROWS = 400_000              # training rows a task; with their weights and nodes in 100 trees a row takes about 1.5 KB
# trees grown at once on more rows than that: every row is kept with its weights and nodes in them, in memory or on disk
FOREST_PART = 10


def estimator(name: str, task: str, n_train: int, label: str = "label", max_bins: int = 32):
    if name == "logistic_regression":
        if task == "classification":
            # sklearn C=1 on summed loss == regParam 1/n on Spark's mean loss
            return LogisticRegression(featuresCol="features", labelCol=label, maxIter=LOGREG_MAX_ITER,
                                      regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                      standardization=False, tol=1e-4)
        return LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal")
    if name == "random_forest":
        if task == "classification":
            return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=FOREST_TREES,
                                          maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt", seed=SEED,
                                          maxBins=max_bins, **FOREST_EXECUTION)
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=FOREST_TREES,
                                     maxDepth=FOREST_DEPTH, featureSubsetStrategy="all", seed=SEED,
                                     maxBins=max_bins, **FOREST_EXECUTION)
    raise ValueError(f"Unknown model: {name}")


class ForestInParts(Estimator):
    """A forest of MLlib grown ``part`` trees at a time over all rows, with a seed of its own for each part.

    The trees of a forest don't depend on one another, so the parts' trees together are the forest; what MLlib keeps of a
    row (its weight in each tree, its node in each tree as of the last three levels) is that of one part.  The nodes aren't
    checkpointed: their lineage is as short as the trees are deep.  ``keep``: the vectors come from a join, which is
    made once and not for each part.
    """

    def __init__(self, forest, part: int, keep: bool = False):
        super().__init__()
        self.forest, self.part, self.keep = forest, part, keep

    def _fit(self, df: DataFrame):
        if not self.keep:
            return self._grow(df)
        df = df.select(self.forest.getLabelCol(), self.forest.getFeaturesCol()).persist()
        try:
            return self._grow(df)
        finally:
            df.unpersist()

    def _grow(self, df: DataFrame):
        f, n = self.forest, self.forest.getNumTrees()
        # a partition's weights are drawn with the seed plus its number: seeds lie farther apart than there are partitions
        models = [f.fit(df, {f.numTrees: min(self.part, n - i), f.seed: f.getSeed() + 1_000_003 * i, f.checkpointInterval: -1})
                  for i in range(0, n, self.part)]
        trees = [t for m in models for t in m._java_obj.trees()]
        jvm, first = df.sparkSession.sparkContext._jvm, models[0]._java_obj
        array = df.sparkSession.sparkContext._gateway.new_array(getattr(jvm, trees[0].getClass().getName()), n)
        for i, tree in enumerate(trees):
            array[i] = tree
        sizes = [first.numFeatures(), *([first.numClasses()] if hasattr(models[0], "numClasses") else [])]  # the same in all parts
        model = f._copyValues(f._create_model(getattr(jvm, first.getClass().getName())(first.uid(), array, *sizes)))
        model._transfer_params_to_java()
        return model


def build_pipeline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   est, scale: bool = True, joined: Sequence[str] = (), mean_of: str = "", stats=None) -> Pipeline:
    """Indexers + fitted population-std scaler + assembler + estimator.

    A column in ``joined`` (too many labels to be collected by an indexer) is coded by a label table that is joined
    (``encoders.TableIndexer``): the same codes, or ranks by the labels' mean of ``mean_of``.  ``stats``: the
    scaler's statistics (a row ``<c>__mean, <c>__std``), if they are known.
    """
    q = lambda c: "`" + c.replace("`", "``") + "`"
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep") for c in categorical if c not in joined]
    if joined:
        stages.append(TableIndexer(list(joined), [f"{c}__idx" for c in joined], mean_of))
    cols = list(numeric)
    if scale and numeric:
        st = stats if stats is not None else scaler_stats(train, numeric).first()  # 2 numbers per feature: a bounded parameter
        exprs = []
        for c in numeric:
            m, s = st[f"{c}__mean"], st[f"{c}__std"]
            s = 1.0 if not s else s
            exprs.append(f"(CAST({q(c)} AS DOUBLE) - ({(m or 0.0)!r})) / ({s!r}) AS {q(c + '__z')}")
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__"))
        cols = [f"{c}__z" for c in numeric]
    stages.append(VectorAssembler(inputCols=cols + [f"{c}__idx" for c in categorical], outputCol="features",
                                  handleInvalid="keep"))
    stages.append(est)
    return Pipeline(stages=stages)


def fit(train: DataFrame, name: str, task: str, label: str, numeric: Sequence[str],
        categorical: Sequence[str]) -> PipelineModel:
    from arbiter.session import checkpoint_dir
    checkpoint_dir(train.sparkSession)  # node-id cache checkpoints go to the shared folder
    t = train.withColumn("label", F.col(label).cast("double"))
    # one pass: the row count, the scaler's statistics and estimates of the numbers of labels
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top"),
                  *[e for c in numeric for e in (F.avg(F.col(c).cast("double")).alias(f"{c}__mean"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std"))],
                  *[F.approx_count_distinct(F.col(c), 0.01).alias(f"{c}__k") for c in categorical]).first()
    if not stats["n"]:
        raise ValueError("no rows to train on")
    joined = [c for c in categorical if stats[f"{c}__k"] > 0.9 * MAX_LABELS]
    # forests bin an indexed column's labels by value: maxBins must cover the exact number of labels (and the indexer's
    # slot for unseen ones); of a joined column they see thresholds on codes, ordered by the label's mean
    max_bins = 32  # MLlib's default
    collected = [c for c in categorical if c not in joined]
    if name == "random_forest" and any(stats[f"{c}__k"] > 20 for c in collected):
        exact = t.agg(F.lit(0), *[F.countDistinct(F.col(c)) for c in collected]).first()
        max_bins = max([32, *(n + 2 for n in exact[1:])])
    est = estimator(name, task, stats["n"], max_bins=max_bins)
    ordered = name == "random_forest" and (task == "regression" or (stats["top"] or 0) <= 1)  # a mean of class numbers orders nothing
    mean_of = "label" if ordered and joined else ""
    if name != "random_forest" or stats["n"] <= FOREST_ROWS:
        return build_pipeline(t, numeric, categorical, est, joined=joined, mean_of=mean_of, stats=stats).fit(t)
    est = ForestInParts(est, FOREST_PART, keep=bool(joined))
    # a scan of few bytes has one task a core, however many rows they hold
    t = t.repartition(max(-(-stats["n"] // FOREST_ROWS), t.sparkSession.sparkContext.defaultParallelism)).persist()
    try:
        return build_pipeline(t, numeric, categorical, est, joined=joined, mean_of=mean_of, stats=stats).fit(t)
    finally:
        t.unpersist()


def score(model: PipelineModel, df: DataFrame, key: str = "id", label: str | None = "y",
          task: str = "classification", with_prob: bool = False) -> DataFrame:
    """``[key, (y), prediction, p]`` - p = probability of class 1 for classifiers; ``with_prob`` adds the
    probabilities of all classes as an array."""
    out = model.transform(df)
    keep = [key] + ([label] if label and label in df.columns else [])
    if task == "classification":
        prob = vector_to_array("probability")
        return out.select(*keep, F.col("prediction").cast("int").alias("pred"), F.get(prob, F.lit(1)).alias("p"),
                          *([prob.alias("prob")] if with_prob else []))
    return out.select(*keep, F.col("prediction").alias("pred"))


def train_all(train: DataFrame, names: Sequence[str], task: str, label: str, numeric, categorical,
              key: str = "id"):
    """Fit several models on one cached training frame, capturing per-model failures (M6).

    Returns ``(models, status rows)``; status is 'failed' for every row if no
    model trained (the reference reports success with an empty result).  Only a model that can't be trained on
    these rows has failed (``common.refused``); a job that broke down is raised, as it says nothing about the model.
    """
    t = train.persist()
    models, rows = {}, []
    try:
        for nm in names:
            try:
                m = fit(t, nm, task, label, numeric, categorical)
                models[nm] = m
                rows.append((nm, "success", None))
            except Exception as e:  # noqa: BLE001 - the error text is the result
                if not refused(e):
                    raise
                rows.append((nm, "failed", f"{type(e).__name__}: {e}"[:500]))
    finally:
        t.unpersist()
    return models, rows


def available() -> list[str]:
    """Names of the models that can be trained."""
    return ["logistic_regression", "random_forest"]
