"""Exact Shapley values: of tree ensembles along their paths, and of any scorer with few features.

Trees (X3).  A leaf counts in the value of a feature set S with the product, over the features of its path, of "the
row meets the path's conditions on it" for a feature in S, and of the share of training rows that go the path's
way for one outside.  Its Shapley values are sums over all subsets of the path's features, which are the integrals over
u in (0, 1) of products of ``z (1 - u) + o u``: polynomials of a degree below the number of features, so
Gauss-Legendre quadrature with half as many points is exact, and the time is polynomial in the depth.  Leaves are
flattened to arrays once; conditions on one feature are merged, so a row is described by the bin (between two
neighbouring thresholds) or category of each feature; rows are sorted by these bins, and rows of an Arrow batch that
agree in all of them are computed once.  Every class of a classifier has its own values; a class's values sum to its probability less the base.

Any scorer (X3, few features).  The value of a set is the mean prediction over a bounded background with the set's features
taken from the row.  Sets are bit masks; Shapley values are linear in the sets' values, so sums
per row over background x masks give them: inside the task for scorers that take arrays, as an aggregation of mixed rows for others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.functions.hashing import hash_hex
from arbiter.operators.common import attach
from arbiter.session import scratch_path, ship_package

MAX_NODES = 4_000_000       # nodes of all trees, which the driver flattens and broadcasts
MAX_FEATURES = 12           # features of which all sets are tried
TABLE = 8                   # features of a path up to which a leaf's shares are tabulated
BACKGROUND = 50             # fixed value: background rows of the reference's model-agnostic explainer
CELLS = 2_000_000           # (row, leaf, feature) entries computed at a time
MIXED = 100_000             # mixed rows of the exact values that a task scores at a time

NODES = ("tree int, node int, left int, right int, feature int, threshold double, categories array<double>, "
         "n_categories int, cover double, value array<double>")


def forest_nodes(model) -> DataFrame:
    """The nodes of a fitted tree or random forest, one row each (``NODES``).

    They are read from the model's saved form, in the shared folder.  ``value`` is the share of each class in the node's
    training rows, or the mean of its labels; ``cover`` is the number (weight) of its training rows.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in data.columns else ""
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    stats = F.col(f"{node}impurityStats")
    if hasattr(model, "numClasses"):
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value = F.transform(stats, lambda x: F.try_divide(x, cover))
    else:
        cover, value = F.get(stats, F.lit(0)), F.array(F.col(f"{node}prediction"))
    split = f"{node}split"
    numeric = F.col(f"{split}.numCategories") < 0
    return data.select(
        tree.cast("int").alias("tree"), F.col(f"{node}id").alias("node"), F.col(f"{node}leftChild").alias("left"), F.col(f"{node}rightChild").alias("right"),
        F.col(f"{split}.featureIndex").alias("feature"), F.when(numeric, F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~numeric, F.col(f"{split}.leftCategoriesOrThreshold")).alias("categories"), F.col(f"{split}.numCategories").alias("n_categories"),
        cover.alias("cover"), value.alias("value"))


def with_covers(nodes: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``nodes`` with ``cover`` counted over ``rows``: one aggregation with a count for each node of a hand-made tree."""
    found = {(n.tree, n.node): n for n in nodes.collect()}
    counts = []

    def walk(tree: int, i: int, met) -> None:
        n = found[tree, i]
        counts.append(F.count(F.when(met, 1)).cast("double").alias(f"{tree}_{i}"))
        if n.left < 0:
            return
        x = F.col(features[n.feature]).cast("double")
        left = x.isin(*n.categories) if n.categories is not None else x <= n.threshold
        left = F.coalesce(left, F.lit(False))
        walk(tree, n.left, met & left)
        walk(tree, n.right, met & ~left)

    for tree in sorted({t for t, _ in found}):
        walk(tree, 0, F.lit(True))
    cover = rows.agg(*counts).first()
    return nodes.sparkSession.createDataFrame([(*n[:-2], cover[f"{n.tree}_{n.node}"], n.value) for n in found.values()], NODES)


@dataclass
class Leaves:
    """Leaves of all trees by the number of features on their paths.

    ``groups``: (features, conditions, shares of rows outside, values), arrays of leaves x features (values: leaves x
    classes, divided by the number of trees).  ``allowed[condition, bin]``: whether a bin meets a condition.
    """

    cuts: dict[int, np.ndarray]
    sizes: dict[int, int]
    allowed: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every feature: the number of thresholds below the value, or the category (one more for others)."""
        out = np.zeros(x.shape, np.int64)
        for f, cut in self.cuts.items():
            out[:, f] = np.searchsorted(cut, x[:, f])  # NaN comes after all thresholds, so it goes right
        for f, n in self.sizes.items():
            known = (x[:, f] >= 0) & (x[:, f] < n)
            out[:, f] = np.where(known, x[:, f], n)
        return out

    def contributions(self, x: np.ndarray, classes: Sequence[int]) -> np.ndarray:
        """Shapley values, rows x classes x features."""
        cells, back = np.unique(self.bins(x), axis=0, return_inverse=True)
        phi = np.zeros((len(classes), len(cells), x.shape[1]))
        for features, conditions, outside, values in self.groups:
            depth = features.shape[1]
            block = max(1, CELLS // (depth * max(len(cells), 1 << depth if depth <= TABLE else 1)))
            for a in range(0, len(features), block):
                f, z = features[a:a + block], outside[a:a + block]
                met = self.allowed[conditions[a:a + block][None], cells[:, f]]  # cells x leaves x features
                if depth <= TABLE:  # a leaf's shares depend on which of its conditions are met: computed once for each
                    every = (np.arange(1 << depth)[:, None] >> np.arange(depth) & 1).astype(float)
                    table = _shares(every[:, None, :], z).transpose(1, 0, 2).reshape(-1, depth)
                    which = met.astype(np.int32) @ (1 << np.arange(depth, dtype=np.int32)) + (np.arange(len(f), dtype=np.int32) << depth)
                    share = table[which]
                else:
                    share = _shares(met, z)
                slot = np.zeros((f.size, x.shape[1]))
                slot[np.arange(f.size), f.ravel()] = 1.0
                flat = share.reshape(len(cells), -1)
                for k, c in enumerate(classes):
                    phi[k] += flat @ (slot * np.repeat(values[a:a + block, c], depth)[:, None])
        return phi[:, back.ravel()].transpose(1, 0, 2)


def _shares(met: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(o - z) times the weighted sum over the sets of the other features, for o = ``met`` (.. x leaves x features)."""
    depth = z.shape[-1]
    met = np.broadcast_to(met, np.broadcast_shapes(met.shape, z.shape))
    at, weight = np.polynomial.legendre.leggauss(-(-depth // 2))
    out = np.zeros(met.shape)
    for u, w in zip((at + 1) / 2, weight / 2):
        term = z * (1 - u) + met * u
        before, after = np.ones(met.shape), np.ones(met.shape)
        np.cumprod(term[..., :-1], axis=-1, out=before[..., 1:])
        np.cumprod(term[..., :0:-1], axis=-1, out=after[..., -2::-1])
        out += w * before * after
    return out * (met - z)


def flatten(nodes: DataFrame) -> Leaves:
    """Arrays of all leaves; the nodes, whose number is checked, are collected."""
    n_nodes = nodes.count()
    if n_nodes > MAX_NODES:
        raise ValueError(f"{n_nodes} nodes: more than {MAX_NODES} are not flattened in the driver")
    rows = {(r.tree, r.node): r for r in nodes.collect()}
    trees = sorted({t for t, _ in rows})
    inner = [r for r in rows.values() if r.left >= 0]
    cuts = {f: np.unique([r.threshold for r in inner if r.feature == f and r.categories is None]) for f in {r.feature for r in inner if r.categories is None}}
    sizes = {f: max(r.n_categories for r in inner if r.feature == f and r.categories is not None) for f in {r.feature for r in inner if r.categories is not None}}
    bins = {f: len(c) + 1 for f, c in cuts.items()} | {f: n + 1 for f, n in sizes.items()}
    conditions: dict[tuple[int, bytes], int] = {}
    paths: dict[int, list] = {}
    n_classes = len(rows[trees[0], 0].value) if trees else 1
    base = np.zeros(n_classes)
    for tree in trees:
        stack = [(rows[tree, 0], {})]
        while stack:
            n, path = stack.pop()
            if n.left < 0:
                value = np.array(n.value, float) / len(trees)
                base += value * math.prod(z for _, z in path.values())
                keys = [(f, conditions.setdefault((f, ok.tobytes()), len(conditions)), z) for f, (ok, z) in sorted(path.items())]
                paths.setdefault(len(keys), []).append((keys, value))
                continue
            left = np.arange(bins[n.feature]) <= np.searchsorted(cuts[n.feature], n.threshold) if n.categories is None \
                else np.isin(np.arange(bins[n.feature]), n.categories)
            for child, way in ((n.left, left), (n.right, ~left)):
                ok, z = path.get(n.feature, (np.ones(bins[n.feature], bool), 1.0))
                to = rows[tree, child]
                stack.append((to, path | {n.feature: (ok & way, z * (to.cover / n.cover if n.cover else 0.0))}))
    allowed = np.zeros((max(len(conditions), 1), max(bins.values(), default=1)))
    for (f, ok), k in conditions.items():
        allowed[k, :bins[f]] = np.frombuffer(ok, bool)
    groups = []
    for depth, found in sorted(paths.items()):
        if depth:
            part = [np.array([[key[j] for key in keys] for keys, _ in found]) for j in range(3)]
            groups.append((part[0].astype(np.int64), part[1].astype(np.int64), part[2].astype(float), np.array([v for _, v in found])))
    return Leaves(cuts, sizes, allowed, groups, base)


def by_cells(rows: DataFrame, shipped, n_features: int) -> DataFrame:
    """``rows`` (``_key``, ``_x``) with their ``_cell`` (the bins of all features), dealt and sorted by it.

    Thresholds are few, so large tables have far more rows than cells: rows of a cell come in the same Arrow batches, which
    compute it once.  A row costs far more than its shuffle; a cell of many rows is dealt by key to several tasks.
    """
    kind = rows.schema["_key"].dataType.simpleString()

    def bins(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_features)
                cell = shipped.value.bins(v).astype(np.int32).tobytes()
                cell = pa.Array.from_buffers(pa.binary(4 * n_features), b.num_rows, [None, pa.py_buffer(cell)]).cast(pa.binary())
                yield pa.record_batch([b.column("_key"), b.column("_x"), cell], names=["_key", "_x", "_cell"])

    ship_package(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(bins, f"_key {kind}, _x array<double>, _cell binary")
    return made.repartitionByRange(parts, "_cell", "_key").sortWithinPartitions("_cell")


def tree_shapley(df: DataFrame, nodes: DataFrame, features: Sequence[str], key: str = "id", vector: str | None = None,
                 classes: Sequence[int] | None = None) -> DataFrame:
    """Exact path-dependent Shapley values of a forest: ``[key, class, feature, value, phi, base_value, prediction]``.

    The features are columns (null as NaN, which goes right at every threshold), or the slots of the array column ``vector``.
    Without ``classes``, two classes are explained by class 1 and more by every class; a regression has class 0.
    """
    leaves = flatten(nodes)
    shipped = df.sparkSession.sparkContext.broadcast(leaves)
    k = len(leaves.base)
    classes = list(classes) if classes is not None else [1] if k == 2 else list(range(k))
    names = list(features)
    x = F.col(vector) if vector else F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in names])
    src = by_cells(df.select(F.col(key).alias("_key"), x.alias("_x")), shipped, len(names)).select("_key", "_x")
    kind = src.schema["_key"].dataType.simpleString()

    def run(batches):
        tree = shipped.value
        for b in batches:
            n, c, m = b.num_rows, len(classes), len(names)
            if not n:
                continue
            v = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, m)
            phi = tree.contributions(v, classes)
            base = np.broadcast_to(tree.base[classes][None, :, None], phi.shape)
            row = pa.array(np.repeat(np.arange(n), c * m))
            yield pa.record_batch([
                b.column("_key").take(row), pa.array(np.tile(np.repeat(np.array(classes, np.int32), m), n)),
                pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(m), n * c))), pa.array(np.repeat(v[:, None, :], c, axis=1).ravel()),
                pa.array(phi.ravel()), pa.array(base.ravel()), pa.array((base + phi.sum(2, keepdims=True)).ravel())],
                names=[key, "class", "feature", "value", "phi", "base_value", "prediction"])

    ship_package(df.sparkSession)
    return src.mapInArrow(run, f"`{key}` {kind}, class int, feature string, value double, phi double, base_value double, prediction double")


def model_shapley(df: DataFrame, model: PipelineModel, features: Sequence[str], key: str = "id", classes: Sequence[int] | None = None) -> DataFrame:
    """``tree_shapley`` of the fitted pipeline ``model`` whose last stage is a tree or a forest; its other stages make
    the vector, whose slots belong to ``features`` in order."""
    forest = model.stages[-1]
    made = PipelineModel(model.stages[:-1]).transform(df)
    made = made.select(key, vector_to_array(forest.getFeaturesCol()).alias("_vector"))
    return tree_shapley(made, forest_nodes(forest), features, key, "_vector", classes)


def is_forest(scorer) -> bool:
    """True for a scorer of a fitted pipeline that ends in a tree or a random forest."""
    stages = getattr(getattr(scorer, "model", None), "stages", None)
    kind = type(stages[-1]).__name__ if stages else ""
    return kind in ("RandomForestClassificationModel", "RandomForestRegressionModel", "DecisionTreeClassificationModel", "DecisionTreeRegressionModel")


def _weights(n: int) -> list[float]:
    """|S|! (n - |S| - 1)! / n! of sets S without the feature."""
    return [math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) for s in range(n)]


def exact_shapley(df: DataFrame, scorer, background: DataFrame, key: str = "id", rows: int = BACKGROUND, seed: int = 42,
                  max_features: int = MAX_FEATURES, classes: int = 0) -> DataFrame:
    """Exact Shapley values of ``scorer`` against a background: ``[key, feature, phi, base_value, prediction]``.

    The background is the ``rows`` rows with the smallest md5(key:seed).  Every set of features is tried, so there may be
    ``max_features`` of them at most.  With ``classes`` = k the values of the scorer's classes 0 to k - 1 are computed
    together, and ``class`` is a column.
    """
    feats = list(scorer.features)
    n = len(feats)
    if n > max_features:
        raise ValueError(f"{n} features have {2 ** n} sets: use sampled_shapley for more than {max_features}")
    weight = _weights(n)
    sign = [[weight[m.bit_count() - 1] if m >> i & 1 else -weight[m.bit_count()] for m in range(1 << n)] for i in range(n)]
    outputs = range(classes or 1)
    bg = background.select(hash_hex(F.col(key), seed).alias("_h"), F.col(key).alias("_k"), *[F.col(f).cast("double").alias(f"_b_{f}") for f in feats])
    bg = bg.orderBy("_h", "_k").limit(rows)
    src = df.select(key, *[F.col(f).cast("double").alias(f) for f in feats])
    if hasattr(scorer, "p_of"):
        out = _sums_in_tasks(src, scorer, bg.select(*[f"_b_{f}" for f in feats]).collect(), key, sign, classes)  # bounded: ``rows`` rows
    else:
        out = _sums_of_rows(src, scorer, bg, key, sign, classes)
    each = F.array(*[F.struct(*([F.lit(k).alias("class")] if classes else []), F.lit(f).alias("feature"), F.col(f"_phi_{k}_{i}").alias("phi"),
                              F.col(f"_base_{k}").alias("base_value"), F.col(f"_all_{k}").alias("prediction")) for k in outputs for i, f in enumerate(feats)])
    return out.select(key, F.inline(each))


def _sums_of_rows(src: DataFrame, scorer, bg: DataFrame, key: str, sign: list[list[float]], classes: int) -> DataFrame:
    """A row a key with ``_phi_<class>_<feature>``, ``_base_<class>`` and ``_all_<class>``; every mixed row is a row that any scorer scores."""
    feats, n = list(scorer.features), len(sign)
    bg = bg.agg(F.collect_list(F.struct(*[f"_b_{f}" for f in feats])).alias("_bg"))  # a bounded array
    j = attach(src, bg)
    j = j.select(key, *feats, F.explode("_bg").alias("_b")).select(key, *feats, "_b.*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("_mask"))
    # the mixed rows as columns of their own, so that a scorer that names a feature often doesn't choose its value again
    j = j.select(key, "_mask", *[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f) for i, f in enumerate(feats)])
    j = scorer.apply_classes(j, prob="_p") if classes else scorer.apply(j, p="_v", pred="_pred").select(key, "_mask", F.array("_v").alias("_p"))
    signs = [F.get(F.array(*map(F.lit, s)), F.col("_mask")) for s in sign]
    outputs = range(classes or 1)
    p = [F.get("_p", F.lit(k)) for k in outputs]
    rows_of = F.count(F.when(F.col("_mask") == 0, 1))
    return j.groupBy(key).agg(*[(F.sum(signs[i] * p[k]) / rows_of).alias(f"_phi_{k}_{i}") for k in outputs for i in range(n)],
                              *[F.avg(F.when(F.col("_mask") == m, p[k])).alias(f"_{name}_{k}") for k in outputs for m, name in ((0, "base"), ((1 << n) - 1, "all"))])


def _sums_in_tasks(src: DataFrame, scorer, bg: list, key: str, sign: list[list[float]], classes: int) -> DataFrame:
    """The same of a scorer that takes arrays: a row's background x sets are scored and summed in the task, so one row leaves it.

    A mixed row with a null feature has no probability and counts in no sum, as in SQL; rows that repeat a key are averaged.
    """
    feats, n, size = list(scorer.features), len(sign), len(bg)
    outputs = list(range(classes or 1))
    weights = np.array(sign).T
    taken = (np.arange(1 << n) >> np.arange(n)[:, None] & 1).astype(bool)  # feature x set
    held = [np.array([0.0 if r[i] is None else r[i] for r in bg]) for i in range(n)]
    missing = [np.array([r[i] is None for r in bg], bool) for i in range(n)]
    block = max(1, MIXED // max(1, size << n))
    names = [f"_phi_{k}_{i}" for k in outputs for i in range(n)] + [f"_{name}_{k}{c}" for k in outputs for name in ("base", "all") for c in ("", "_n")]
    kind = src.schema[key].dataType.simpleString()

    def sums(x: list[np.ndarray], null: list[np.ndarray]) -> list[pa.Array]:
        mixed = {f: np.where(taken[i], x[i][:, None, None], held[i][:, None]) for i, f in enumerate(feats)}  # row x background x set
        gone = None
        if any(a.any() for a in null) or any(a.any() for a in missing):
            gone = np.logical_or.reduce([np.where(taken[i], null[i][:, None, None], missing[i][:, None]) for i in range(n)])
        with np.errstate(over="ignore", invalid="ignore"):
            p = scorer.probs_of(mixed) if classes else [scorer.p_of(mixed)]
            count = np.full((len(x[0]), 1 << n), size) if gone is None else size - gone.sum(1)
            total = [(p[k] if gone is None else np.where(gone, 0.0, p[k])).sum(1) for k in outputs]
            none = ~count.any(1)
            out = [pa.array(v, mask=none) for t in total for v in (t @ weights).T]
        for t in total:
            for m in (0, -1):
                out += [pa.array(t[:, m], mask=count[:, m] == 0), pa.array(count[:, m].astype(np.int64))]
        return out

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows if size else 0, block):
                s = b.slice(a, block)
                cols = [s.column(1 + i) for i in range(n)]
                yield pa.record_batch([s.column(0), *sums([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols],
                                                          [c.is_null().to_numpy(zero_copy_only=False) for c in cols])], names=[key, *names])

    ship_package(src.sparkSession)
    got = src.mapInArrow(run, ", ".join([f"`{key}` {kind}", *[f"{c} {'long' if c.endswith('_n') else 'double'}" for c in names]]))
    return got.groupBy(key).agg(*[(F.sum(f"_phi_{k}_{i}") / (F.count(F.lit(1)) * size)).alias(f"_phi_{k}_{i}") for k in outputs for i in range(n)],
                                *[F.try_divide(F.sum(f"_{name}_{k}"), F.sum(f"_{name}_{k}_n")).alias(f"_{name}_{k}") for k in outputs for name in ("base", "all")])
