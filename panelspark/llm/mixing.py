"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import WHITE_RUN, fresh, frozen, numbered, small, whole, words_of

#: Words in a block, blocks of all sources in a shard (about), and children of a node of the tree.
BLOCK_WORDS = 64
SHARD_BLOCKS = 2048
FAN_OUT = 256
#: Above this numpy's exact sampler refuses; the split is then drawn from its normal limit.
EXACT_BLOCKS = 400_000_000


def split_quota(counts: Sequence[int], quota: int, rng: np.random.Generator) -> list[int]:
    """Share ``quota`` draws without replacement among children that own ``counts`` blocks.

    Halves are drawn recursively, so the whole is one multivariate-hypergeometric draw. The parts sum
    to the quota, and no child gets more than it has.
    """
    if len(counts) == 1:
        return [int(quota)]
    middle = len(counts) // 2
    left, right = int(sum(counts[:middle])), int(sum(counts[middle:]))
    if max(left, right) < EXACT_BLOCKS:
        first = int(rng.hypergeometric(left, right, quota)) if left and right else min(left, quota)
    else:
        total = left + right
        mean = quota * left / total
        spread = (mean * (right / total) * (total - quota) / max(1, total - 1)) ** 0.5
        first = int(np.clip(round(rng.normal(mean, spread)), max(0, quota - right), min(left, quota)))
    return split_quota(counts[:middle], first, rng) + split_quota(counts[middle:], quota - first, rng)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, n_blocks) of each source; weights repeat over sources by code point, null last.

    The targets share ``share`` times all words by weight. A target stops at ``most`` times its source's
    size, and what is cut goes to the others by weight, until none is above. Each round of that is one
    aggregation to three numbers; rounds end when no further source reaches its stop.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n_blocks").alias("n_blocks"))
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = frozen(numbered(by_source, *order).withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most))))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while total:
        row = table.agg(
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(full, F.col("stop")).otherwise(0.0)).alias("used"),
        ).first()
        if not row["open"]:
            break
        higher = (share * total - row["used"]) / row["open"]
        if higher <= level:
            break
        level, full = higher, F.col("stop") <= F.col("weight") * F.lit(higher)
    target = F.least(F.col("stop"), F.col("weight") * F.lit(level)) if total else F.lit(0.0)
    return table.select("source", "source_size", "n_blocks", target.alias("target"))


def _descend(quotas: DataFrame, leaves: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(source_no, shard, n, quota): each source's quota split among the shards, level by level."""
    depth = 0
    while FAN_OUT**depth < n_shards:
        depth += 1
    nodes = quotas.select("source_no", F.lit(0).cast("long").alias("node"), "quota")

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        rng = np.random.default_rng([seed, int(frame["source_no"].iloc[0]), int(frame["parent"].iloc[0]), int(frame["level"].iloc[0])])
        frame["quota"] = split_quota(frame["n"].tolist(), int(frame["quota"].iloc[0]), rng)
        return frame[["source_no", "node", "quota"]]

    for level in range(depth - 1, -1, -1):
        below = leaves.groupBy("source_no", F.expr(f"shard div {FAN_OUT**level}L").alias("node")).agg(F.sum("n").alias("n"))
        children = below.withColumn("parent", F.expr(f"node div {FAN_OUT}L"))
        parents = nodes.select("source_no", F.col("node").alias("parent"), "quota")
        joined = children.join(parents, ["source_no", "parent"]).withColumn("level", F.lit(level))
        nodes = joined.groupBy("source_no", "parent").applyInPandas(split, "source_no long, node long, quota long")
    return nodes.select("source_no", F.col("node").alias("shard"), "quota")


def mix_plan(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 0,
) -> DataFrame:
    """What the mix takes of each document.

    Columns: doc_id, text_hash, source, size, source_size, target, full (whole passes over the document),
    shard, drawn (array of (block, place), the blocks of ``block_words`` words taken once more, each with
    its place in the shuffled shard), taken (words, repeats counted).

    A source's target is reached by whole passes over it and, for the rest, an exact quota of its blocks.
    The quota goes down a tree to the output shards; a shard owns the blocks of the documents hashed to
    it, so shards draw disjointly, from a local permutation by hash. A source of any size is spread over
    all shards; about ``shard_blocks`` blocks meet in one. No block is taken more than ``ceil(most)``
    times. Everything random is a function of ``seed`` and the rows, so reruns agree.

    Null texts have no words; a null source is a source. Rows that agree in id, source and text are one
    document. Without words all targets are 0. Other columns are not read.
    """
    size = F.size(words_of(whole(F.col(text_col)), WHITE_RUN)).cast("long")
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), F.col(source_col).alias("source"), size.alias("size")
    )
    blocks = F.ceil(F.col("size") / block_words).cast("long")
    sizes = frozen(rows.dropDuplicates().withColumn("n_blocks", blocks))
    targets = frozen(numbered(source_targets(sizes, weights, share, most), F.col("source").isNull(), F.col("source"), name="source_no"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("full", F.floor(ratio)).withColumn("quota", F.round((ratio - F.floor(ratio)) * F.col("n_blocks")).cast("long"))
    n_sources, n_blocks = targets.agg(F.count("*"), F.coalesce(F.sum("n_blocks"), F.lit(0))).first()
    n_shards = max(1, -(-n_blocks // shard_blocks))

    to_source = small(targets.drop("n_blocks").withColumnRenamed("source", "of"), n_sources)
    docs = sizes.join(to_source, sizes["source"].eqNullSafe(F.col("of"))).drop("of")
    docs = docs.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(n_shards)))
    leaves = docs.where("n_blocks > 0").groupBy("source_no", "shard").agg(F.sum("n_blocks").alias("n"))
    shares = _descend(targets.where("quota > 0"), leaves, n_shards, seed)

    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")
    pool = docs.where("n_blocks > 0").select("doc_id", "text_hash", "source_no", "shard", "size", block)
    pool = pool.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    shuffled = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash", "block"), "doc_id", "text_hash", "block")
    ranked = pool.withColumn("place", F.row_number().over(shuffled)).join(shares, ["source_no", "shard"]).where("place <= quota")
    document = F.struct("source_no", "doc_id", "text_hash").alias("document")
    drawn = ranked.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("block", "place"))).alias("drawn"), F.sum("words").alias("extra"))
    taken = (F.col("full") * F.col("size") + F.coalesce("extra", F.lit(0))).cast("long")
    return docs.withColumn("document", document).join(drawn, "document", "left").select(
        "doc_id",
        "text_hash",
        "source",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        "full",
        "shard",
        F.coalesce("drawn", F.expr("array()").cast("array<struct<block:bigint,place:int>>")).alias("drawn"),
        taken.alias("taken"),
    )


def block_text(text: Column, drawn: Column, block_words: int = BLOCK_WORDS) -> Column:
    """The text of the drawn blocks, in their order, with the white space of the original."""
    white, black = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    blocks = F.regexp_extract_all(text, F.lit(f"((?:{white}*{black}+){{1,{block_words}}}{white}*)"), F.lit(1))
    return F.array_join(F.transform(drawn, lambda d: F.get(blocks, d["block"].cast("int"))), "")


def mix_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``documents``, once per whole pass, and once more with the text of the drawn blocks.

    Columns are those of ``documents``; only the text of the last kind of row differs. Documents of which
    nothing is taken go. Options as in ``mix_plan``.
    """
    plan = mix_plan(documents, id_col, text_col, source_col, **options).where("taken > 0")
    of, mix, copy = fresh(documents, "_of", "_mix", "_copy")
    plan = plan.select(F.struct("doc_id", "text_hash", "source").alias(of), F.struct("full", "drawn").alias(mix))
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), F.col(source_col).alias("source"))
    rows = documents.withColumn(of, key).dropDuplicates([of]).join(plan, of)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{mix}.full"))))
    again = F.col(copy) < F.col(f"{mix}.full")
    part = block_text(whole(F.col(text_col)), F.col(f"{mix}.drawn"), options.get("block_words", BLOCK_WORDS))
    rows = rows.where(again | (F.size(f"{mix}.drawn") > 0))
    return rows.withColumn(text_col, F.when(again, F.col(text_col)).otherwise(part)).select(*documents.columns)
