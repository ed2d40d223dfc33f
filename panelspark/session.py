"""Session building and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Generated methods above 8000 bytes of bytecode are never compiled by HotSpot. With the limit,
# Spark leaves whole-stage code for such a stage and splits its expressions into small methods,
# which is many times faster for long CASE chains and wide aggregations.
SESSION_DEFAULTS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "panelspark", conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` wins over the defaults.

    The master, memory and shuffle partition count are left to the deployment.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_frame(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Used where a later step must see exactly the rows and partitions of an earlier one
    (range buckets, boosting margins), so that losing an executor cannot change them.
    """
    _require_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _require_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
    context.setCheckpointDir(folder)
