"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six ASCII white space characters: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
#: Largest number of rows that a side may have to be broadcast; beyond it a plain join is used.
BROADCAST_ROWS = 200_000


def whole(text: Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def row_identity(rows: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart, in a fixed order: the id, the text, then all columns (maps, which cannot be hashed, left out)."""
    every = [F.col(f"`{c.replace('`', '``')}`") for c, kind in rows.dtypes if "map<" not in kind]
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), F.xxhash64(*every).alias("row_hash"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the quicker built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of the separators."""
    return F.array_remove(F.split(text, separators), "")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def frozen(frame: DataFrame) -> DataFrame:
    """The frame as checkpoint files: computed once, lineage cut, same rows in the same partitions from then on."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The frame as a compressed table in the shared folder; smaller than a checkpoint, for wide intermediates."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int) -> DataFrame:
    """The frame, to be broadcast if its counted rows are few enough."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def numbered(frame: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Number all rows from 0 in a global order, without one task that sees them all.

    Rows are range-partitioned, sorted and frozen; a row's number is its place in its partition plus
    the rows of the partitions before it, one number per partition.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = frozen(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part).agg(F.count("*").alias("n")).collect()  # one row per partition
    before, offsets = 0, []
    for row in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row["n"]
    table = frame.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(table), "_part")
    return joined.withColumn(name, F.col("_before") + place).drop("_part", "_before", "_at")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, changed where the frame already has such a column."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
