"""An exact label encoder for pipelines whose columns have too many labels for an indexer in the driver.

``TableIndexer`` fits a table (feature, label, code) in Spark; its model joins it to the rows (broadcast while
it is small, a shuffled join beyond) and is saved as Parquet with the pipeline.  No label passes through the driver.
Codes are ranks of the sorted labels, as MLlib's indexer gives them; with ``meanOf`` they are ranks by the labels' mean
of that column, the order in which a tree's best split of a category's values is a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators.common import broadcast_if_small, materialize
from arbiter.operators.ordered import running_sums

CUTS = 255                  # sampled labels that cut the sorted labels into pieces
SAMPLE = 4096


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns of labels", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "columns of codes", TypeConverters.toListString)
    meanOf = Param(Params._dummy(), "meanOf", "order labels by their mean of this column; empty: alphabetically", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(meanOf="")


def _pieces(labels: DataFrame) -> DataFrame:
    """Add ``_b``, an order-preserving piece of ``label``: the number of sampled cut points up to it.

    The cut points are labels with the smallest hashes, so a prefix that most labels share is cut as well.
    """
    some = [r.label for r in labels.orderBy(F.md5("label"), "label").limit(SAMPLE).select("label").collect()]  # bounded
    some.sort(key=lambda x: x.encode())
    cuts = sorted({some[i * len(some) // (CUTS + 1)] for i in range(1, CUTS + 1)}, key=lambda x: x.encode()) if len(some) == SAMPLE else []
    if not cuts:
        return labels.withColumn("_b", F.lit(0))
    array = F.array(*[F.lit(c) for c in cuts])
    return labels.withColumn("_b", F.size(F.filter(array, lambda c: c <= F.col("label"))))


def label_table(df: DataFrame, cols: Sequence[str], mean_of: str = "") -> DataFrame:
    """``[feature, label, code]`` of all labels, codes 0, 1, .. by label or by the label's mean of ``mean_of`` (ties: by label).

    Nulls have no label.  A mean is taken over the rows where ``mean_of`` isn't null; labels without one come last.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("label")) for c in cols])
    y = F.col(mean_of).cast("double") if mean_of else F.lit(None).cast("double")
    d = df.select(y.alias("_y"), F.inline(arr)).where("label is not null")
    d = materialize(d.groupBy("feature", "label").agg(F.avg("_y").alias("_mean")).withColumn("_one", F.lit(1)))
    d = _pieces(d)
    if not mean_of:
        ranked = running_sums(d, ["feature"], "label", ["_one"], bucket=F.col("_b"), include_ties=False, tie_breaker="label")
    else:
        d = d.drop("_b").withColumn("_mean", F.coalesce("_mean", F.lit(float("inf"))))
        ranked = running_sums(d, ["feature"], "_mean", ["_one"], include_ties=False, tie_breaker="label")
    return ranked.select("feature", "label", (F.col("cum__one") - 1).cast("long").alias("code"))


class TableIndexer(Estimator, _Columns, DefaultParamsWritable):
    """Fits the label table of ``inputCols``."""

    def __init__(self, inputCols: Sequence[str] = (), outputCols: Sequence[str] = (), meanOf: str = ""):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols), meanOf=meanOf)

    def _fit(self, dataset: DataFrame) -> TableIndexerModel:
        cols, mean_of = self.getOrDefault("inputCols"), self.getOrDefault("meanOf")
        model = TableIndexerModel(materialize(label_table(dataset, cols, mean_of)))
        return model._set(inputCols=cols, outputCols=self.getOrDefault("outputCols"), meanOf=mean_of)


class TableIndexerModel(Model, _Columns, MLWritable, MLReadable):
    """Adds the codes; a null or a label that the table hasn't is coded as the number of the column's labels."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        sizes = {r.feature: r.n for r in self.table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
        for c, to in zip(self.getOrDefault("inputCols"), self.getOrDefault("outputCols")):
            codes = self.table.where(F.col("feature") == c).select(F.col("label").alias("_label"), F.col("code").cast("double").alias("_code"))
            out = out.join(broadcast_if_small(codes), F.col(c).cast("string") == F.col("_label"), "left")
            out = out.withColumn(to, F.coalesce("_code", F.lit(float(sizes.get(c, 0))))).drop("_label", "_code")
        return out

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()


class _TableWriter(MLWriter):
    def __init__(self, model: TableIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.mode("overwrite").parquet(f"{path}/labels")


class _TableReader(MLReader):
    def load(self, path: str) -> TableIndexerModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TableIndexerModel(self.sparkSession.read.parquet(f"{path}/labels"))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
