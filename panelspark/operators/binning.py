"""Weighted quantile cuts of many features at once, and rows as bins.

A feature matrix is a column ``features`` of arrays of doubles; NULL and NaN are missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import quoted

#: Most bins of a feature; the code above them is for missing values.
MAX_BINS = 255
MISSING = 255
#: Entries of a summary. Each time one is shortened, ranks move by 1 / SUMMARY of the total weight at most.
SUMMARY = 4096
#: Rows summarized at a time, and summaries merged by one task.
CHUNK = 16_384
FAN_IN = 32


def feature_array(df: DataFrame, features: Sequence[str]) -> Column:
    """Columns as one array of doubles, in order; missing stays missing."""
    return F.array(*[F.col(quoted(c)).cast("double") for c in features])


def as_array(df: DataFrame, features: str) -> Column:
    """The feature column as an array, if it is an ML vector."""
    return vector_to_array(features) if dict(df.dtypes)[features] == "vector" else F.col(features).cast("array<double>")


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix, missing as NaN."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


Summary = tuple[np.ndarray, np.ndarray]


def summarize(values: np.ndarray, weights: np.ndarray) -> Summary:
    """Distinct values in order and their weights; missing values left out."""
    present = ~np.isnan(values)
    found, at = np.unique(values[present], return_inverse=True)
    return found, np.bincount(at, weights[present], len(found))


def shorten(summary: Summary, size: int = SUMMARY) -> Summary:
    """At most ``size`` entries at equal steps of weight; the weight between two goes to the upper one."""
    values, weights = summary
    if len(values) <= size:
        return summary
    total = np.cumsum(weights)
    kept = np.unique(np.minimum(np.searchsorted(total, total[-1] * np.arange(1, size + 1) / size), len(values) - 1))
    return values[kept], np.diff(total[kept], prepend=0.0)


def merge(summaries: Sequence[Summary], size: int = SUMMARY) -> Summary:
    return shorten(summarize(np.concatenate([s[0] for s in summaries]), np.concatenate([s[1] for s in summaries])), size)


def cuts_of(summary: Summary, bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last: every value if there are few, else weighted quantiles."""
    values, weights = summary
    if len(values) <= bins:
        return values[:-1]
    total = np.cumsum(weights)
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, bins) / bins))
    return values[at[at < len(values) - 1]]


def quantile_cuts(
    df: DataFrame, features: str = "features", weight: str | None = None, bins: int = MAX_BINS, size: int = SUMMARY
) -> list[np.ndarray]:
    """Cuts of each feature at its weighted quantiles i / bins: the smallest values that reach them.

    Tasks keep a summary per feature, halves of equal age are merged first, and the tasks' summaries are
    merged 32 at a time in rounds, so no task sees more. With up to ``size`` distinct values nothing is
    shortened and the cuts are exact. Otherwise a cut's rank is off by at most s / size of the total weight,
    s being the times an entry was shortened: about log2(rows of a task / 16,384) + log32(tasks).
    Cuts reach the driver: a model's worth, at most ``bins`` numbers a feature.
    """
    if not 1 < bins <= MAX_BINS:
        raise ValueError(f"bins must be from 2 to {MAX_BINS}, not {bins}")
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(as_array(df, features).alias("x"), given.alias("w"))
    parts = rows.rdd.getNumPartitions()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, list[Summary]]] = []
        part = TaskContext.get().partitionId()

        def add(x: np.ndarray, w: np.ndarray) -> None:
            stack.append((0, [shorten(summarize(c, w), size) for c in x.T]))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                age, top = stack.pop()
                stack[-1] = (age + 1, [merge(pair, size) for pair in zip(stack[-1][1], top, strict=True)])

        for batch in batches:
            x, w = matrix(batch["x"]), batch["w"].to_numpy(zero_copy_only=False)
            for at in range(0, len(x), CHUNK):
                add(x[at : at + CHUNK], w[at : at + CHUNK])
        if stack:
            merged = [merge(each, size) for each in zip(*(s for _, s in stack), strict=True)]
            columns = [range(len(merged)), [part] * len(merged), [m[0].tobytes() for m in merged], [m[1].tobytes() for m in merged]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["f", "part", "v", "w"])

    schema = "f int, part int, v binary, w binary"

    def read(pdf: pd.DataFrame) -> Summary:
        return merge([(np.frombuffer(v), np.frombuffer(w)) for v, w in zip(pdf["v"], pdf["w"], strict=True)], size)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        values, weights = read(pdf)
        return pd.DataFrame({"f": pdf["f"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "v": [values.tobytes()], "w": [weights.tobytes()]})

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"f": pdf["f"].iloc[:1], "cuts": [cuts_of(read(pdf), bins).tolist()]})

    found = rows.mapInArrow(summaries, schema)
    while parts > FAN_IN:
        found = found.groupBy("f", F.floor(F.col("part") / FAN_IN)).applyInPandas(merged, schema)
        parts = -(-parts // FAN_IN)
    cuts = {r["f"]: np.array(r["cuts"], dtype=np.float64) for r in found.groupBy("f").applyInPandas(finished, "f int, cuts array<double>").collect()}
    return [cuts[f] for f in range(len(cuts))]


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin codes of a matrix: how many cuts lie below a value, 255 for missing ones."""
    codes = np.empty(x.shape, dtype=np.uint8)
    for f, at in enumerate(cuts):
        codes[:, f] = np.searchsorted(at, x[:, f], side="left")
        codes[np.isnan(x[:, f]), f] = MISSING
    return codes


def binned(df: DataFrame, keep: Sequence[Column], cuts: Sequence[np.ndarray], features: str = "features") -> DataFrame:
    """The ``keep`` columns and ``bins``, one byte per feature."""
    rows = df.select(*keep, as_array(df, features).alias("__x"))
    kept, bounds = rows.columns[:-1], list(cuts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = to_bins(matrix(batch["__x"]), bounds)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array([row.tobytes() for row in codes], pa.binary())], [*kept, "bins"])

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(coded, f"{schema}, bins binary")
