"""Boosted trees as ML estimators and models that can be saved."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.losses import FocalLoss, LogLoss
from panelspark.functions.numeric import sigmoid
from panelspark.operators.boosting import BoostParams, boost
from panelspark.operators.forest import Forest, Tree, margin_column, shapley_column, staged_column
from panelspark.session import checkpoint_frame

LOSSES = {"log": LogLoss, "focal": FocalLoss}
NODES = "tree int, node int, feature int, threshold double, bin int, missing_left boolean, left int, right int, value double, cover double, gain double"


class HistogramBooster(Estimator):
    """Gradient-boosted trees on a feature column (vector or array; NaN and NULL are missing), for binary labels.

    The start score is the loss's best constant, for the focal loss that of ``focal_init_score``, unless given.
    """

    def __init__(
        self,
        params: BoostParams | None = None,
        loss: LogLoss | FocalLoss | None = None,
        labelCol: str = "label",
        featuresCol: str = "features",
        idCol: str = "id",
        initScore: float | None = None,
    ) -> None:
        super().__init__()
        self.boosting, self.loss = params or BoostParams(), loss or LogLoss()
        self.labelCol, self.featuresCol, self.idCol, self.initScore = labelCol, featuresCol, idCol, initScore

    def _fit(self, dataset: DataFrame) -> HistogramBoosterModel:
        dataset = checkpoint_frame(dataset.select(self.idCol, self.labelCol, self.featuresCol))
        forest = boost(dataset, self.labelCol, self.idCol, self.loss, self.boosting, features=self.featuresCol, init_score=self.initScore).forests[0]
        return HistogramBoosterModel(forest, self.loss, self.featuresCol)


class HistogramBoosterModel(Model, MLWritable, MLReadable):
    """A fitted forest: ``transform`` adds ``margin`` and ``probability``, the vector (negative, positive)."""

    def __init__(self, forest: Forest, loss: LogLoss | FocalLoss | None = None, featuresCol: str = "features") -> None:
        super().__init__()
        self.forest, self.loss, self.featuresCol = forest, loss or LogLoss(), featuresCol

    @property
    def trees(self) -> list[Tree]:
        return self.forest.trees

    @property
    def getNumTrees(self) -> int:
        return len(self.forest.trees)

    def featureImportances(self, features: int) -> np.ndarray:
        """Each feature's share of the gain of all splits."""
        return self.forest.importances(features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("margin", margin_column(dataset, self.forest, self.featuresCol))
        positive = sigmoid("margin")
        return scored.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - positive, positive)))

    def scores(self, dataset: DataFrame, keep: list[str], name: str = "prediction") -> DataFrame:
        """The ``keep`` columns, the margin and its probability."""
        scored = dataset.select(*keep, margin_column(dataset, self.forest, self.featuresCol).alias("margin"))
        return scored.withColumn(name, sigmoid("margin"))

    def staged(self, dataset: DataFrame, keep: list[str], name: str = "staged") -> DataFrame:
        """The ``keep`` columns and the margins after each round."""
        return dataset.select(*keep, staged_column(dataset, self.forest, self.featuresCol).alias(name))

    def shapley(self, dataset: DataFrame, keep: list[str], name: str = "shapley") -> DataFrame:
        """The ``keep`` columns and the Shapley values of the features, the expected margin last."""
        return dataset.select(*keep, shapley_column(dataset, self.forest, self.featuresCol).alias(name))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    """``metadata``: one line of JSON; ``trees``: one Parquet row per node."""

    def __init__(self, model: HistogramBoosterModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        forest, spark = self.model.forest, self.sparkSession
        kind = next(name for name, cls in LOSSES.items() if isinstance(self.model.loss, cls))
        told = {
            "class": "HistogramBoosterModel",
            "init_score": forest.init_score,
            "weights": forest.weights,
            "loss": {"kind": kind, **asdict(self.model.loss)},
            "featuresCol": self.model.featuresCol,
        }
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        names = [f.name for f in fields(Tree)]
        rows = [(t, n, *(getattr(tree, name)[n] for name in names)) for t, tree in enumerate(forest.trees) for n in range(len(tree.feature))]
        spark.createDataFrame(rows, NODES).write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> HistogramBoosterModel:
        spark = self.sparkSession
        told = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        trees = [Tree() for _ in told["weights"]]
        for r in spark.read.schema(NODES).parquet(f"{path}/trees").orderBy("tree", "node").collect():
            for f in fields(Tree):
                getattr(trees[r["tree"]], f.name).append(r[f.name])
        loss = dict(told["loss"])
        return HistogramBoosterModel(Forest(told["init_score"], trees, told["weights"]), LOSSES[loss.pop("kind")](**loss), told["featuresCol"])
