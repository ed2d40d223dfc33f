"""Reading and writing panels, predictions, feature lists and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions.numeric import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema, so that no pass over the data infers one."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return nulls_for_nan(df)


def read_panel(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Columnar panel; ``split`` reads only that partition folder."""
    df = nulls_for_nan(spark.read.parquet(path))
    return df if split is None else df.filter(F.col("split") == split)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_clustered(df: DataFrame, name: str, path: str, id_col: str, buckets: int, index: str = "ind") -> None:
    """A panel as the table ``name`` with files under ``path``, bucketed by customer and sorted by period within.

    Each bucket is one file, written by one task. Aggregations, windows and joins by customer read it without a
    shuffle; choose buckets of a size that one task can take, some 100 MB to 1 GB.
    """
    rows = df.repartition(buckets, id_col).sortWithinPartitions(id_col, index)
    rows.write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col, index).option("path", path).saveAsTable(name)


def read_clustered(spark: SparkSession, name: str) -> DataFrame:
    """A panel that ``write_clustered`` wrote; tell operators that take it ``clustered=True``."""
    return nulls_for_nan(spark.table(name))


def write_predictions(df: DataFrame, path: str, id_col: str, score: str = "prediction") -> None:
    """CSV part files of (id, prediction), each with a header."""
    df.select(id_col, score).write.mode("overwrite").option("header", True).csv(path)


def save_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    rows = [(i, name) for i, name in enumerate(features)]
    spark.createDataFrame(rows, "pos INT, feature STRING").write.mode("overwrite").parquet(path)


def load_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Feature names in rank order. The list names columns, so it is collected."""
    return [r["feature"] for r in spark.read.parquet(path).orderBy("pos").collect()]


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)
