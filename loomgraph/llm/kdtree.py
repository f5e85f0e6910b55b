"""Sharding by a k-d tree whose splits are exact distributed weighted medians.

A node of k leaves is split along its widest metadata dimension at the weight fraction
(k // 2) / k, until every node is one leaf.  The order along a dimension is total: the
dimension's coordinate, then a hash of the row, so a value that a third of all rows
share can be split as finely as any other and leaves come out equal to within one
document.  A median is found by refining a 62-bit sort key 16 bits at a time: each pass
is one partial aggregation of weights into at most 65,536 cells a node, and only one
number a node comes back to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.store import materialize

COORD_BITS, HASH_BITS, ROW_BITS, STEP_BITS = 16, 24, 22, 16
KEY_BITS = COORD_BITS + HASH_BITS + ROW_BITS
MAX_NODES = 1 << 16  # of the tree that is broadcast at once, 40 bytes each; beyond it parts of the tree grow one after the other
ROWS_A_BUCKET = 1 << 16


@dataclass
class Node:
    first_leaf: int
    leaves: int
    weight: int = 0
    dim: int = 0
    prefix: int = 0  # of the split key, as far as it is known
    below: int = 0  # weight of the keys under the prefix
    left: int = 0  # weight of the left child
    split: int = field(default=0)  # keys under it go left


def _coordinates(df: DataFrame, dims: dict[str, Column], bounds) -> list[Column]:
    """Each dimension scaled to 16 bits over the whole table; null is the lowest."""
    out = []
    for name in dims:
        lo, hi = bounds[f"{name}_lo"], bounds[f"{name}_hi"]
        if lo is None or hi <= lo:
            out.append(F.lit(0))
        else:
            out.append(F.coalesce(F.floor((F.col(f"_d_{name}") - lo) / (hi - lo) * 65534) + 1, F.lit(0)).cast("int"))
    return out


def kd_shards(df: DataFrame, weight: Column, dims: dict[str, Column], identity: list[Column], keep: list[Column], target_bytes: int | None = None, leaves: int | None = None) -> DataFrame:
    """``keep`` plus (weight long, shard int, slot long) for each row of ``df``.

    ``weight`` must be at least 1.  ``dims`` are numeric metadata; null sorts lowest.
    Give the number of ``leaves``, or ``target_bytes`` for as many as bring every leaf
    to the target.  ``identity`` columns order rows of equal coordinates; rows equal in
    them too are told apart by a number that is fixed when the rows are first written.
    Slots are gapless from 0 in each shard.  An empty table gives an empty result, and
    kept columns named weight, shard or slot are replaced.
    """
    spark = df.sparkSession
    named = [f"_d_{k}" for k in dims]
    stated = df.select(F.struct(*keep).alias("_keep"), weight.cast("long").alias("_weight"), *[v.cast("double").alias(n) for n, v in zip(named, dims.values())], F.xxhash64(*identity).alias("_h"))
    rows = materialize(stated.withColumn("_u", F.xxhash64(F.monotonically_increasing_id())), "kd")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("w"), *[f(n).alias(f"{k}_{a}") for k, n in zip(dims, named) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    total = about["w"] or 0
    if leaves is None:
        leaves = max(1, -(-total // target_bytes))
    coords = _coordinates(rows, dims, about)
    low = F.shiftrightunsigned("_h", 64 - HASH_BITS) * (1 << ROW_BITS) + F.shiftrightunsigned("_u", 64 - ROW_BITS)
    table = rows.select("_keep", "_weight", "_h", "_u", *[c.alias(f"_c{i}") for i, c in enumerate(coords)], low.alias("_low"), F.lit(0).cast("long").alias("_node"))
    placed = _grow(spark, table, {0: Node(0, leaves, total)}, len(dims)) if total else table.withColumn("shard", F.lit(0))
    n_buckets = max(1, about["n"] // leaves // ROWS_A_BUCKET)
    spread = placed.withColumn("_b", F.pmod(F.xxhash64("_h", "_u"), F.lit(n_buckets))).select("_keep", "_weight", "shard", "_b", "_h", "_u")
    starts = spread.groupBy("shard", "_b").count().withColumn("_from", F.sum("count").over(W.partitionBy("shard").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).drop("count")
    numbered = spread.withColumn("_rn", F.row_number().over(W.partitionBy("shard", "_b").orderBy("_h", "_u"))).join(starts, ["shard", "_b"])
    kept = [F.col(f"_keep.`{c}`") for c in rows.schema["_keep"].dataType.names if c not in ("weight", "shard", "slot")]
    return numbered.select(*kept, F.col("_weight").alias("weight"), "shard", (F.col("_from") + F.col("_rn") - 1).cast("long").alias("slot"))


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of numbers that the driver holds, as one JSON literal, which Spark parses at once."""
    columns = [c.split() for c in schema.split(", ")]
    text = json.dumps([dict(zip([c for c, _ in columns], r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{c}: {t}' for c, t in columns)}>>")))


def _grow(spark: SparkSession, table: DataFrame, nodes: dict[int, Node], n_dims: int) -> DataFrame:
    """Split until every node is one leaf, and give each row its ``shard``."""
    while any(x.leaves > 1 for x in nodes.values()):
        if 2 * len(nodes) > MAX_NODES and len(nodes) > 1:
            ids, few = sorted(nodes), max(1, MAX_NODES // 8)
            parts = [ids[i : i + few] for i in range(0, len(ids), few)]
            own = lambda part: table.join(F.broadcast(_values(spark, [(k,) for k in part], "_node bigint")), "_node", "left_semi")
            return reduce(DataFrame.unionByName, [_grow(spark, materialize(own(part), "kd"), {k: nodes[k] for k in part}, n_dims) for part in parts])
        table, nodes = _split(spark, table, nodes, n_dims)
    leaf = _values(spark, [(k, x.first_leaf) for k, x in nodes.items()], "_node bigint, shard int")
    return table.join(F.broadcast(leaf), "_node").select("_keep", "_weight", "_h", "_u", "shard")


def _split(spark: SparkSession, table: DataFrame, nodes: dict[int, Node], n_dims: int) -> tuple[DataFrame, dict[int, Node]]:
    """Split every node of more than one leaf; children of node x are 2x+1 and 2x+2."""
    active = {k: x for k, x in nodes.items() if x.leaves > 1}
    growing = F.broadcast(_values(spark, [(k,) for k in active], "_node bigint"))
    spans = table.join(growing, "_node", "left_semi").groupBy("_node").agg(*[(F.max(f"_c{i}") - F.min(f"_c{i}")).alias(f"s{i}") for i in range(n_dims)]).collect()
    for r in spans:
        active[r["_node"]].dim = max(range(n_dims), key=lambda i: (r[f"s{i}"], -i)) if n_dims else 0
    dim_of = F.broadcast(_values(spark, [(k, x.dim) for k, x in nodes.items()], "_node bigint, _dim int"))
    coord = F.get(F.array(*[F.col(f"_c{i}") for i in range(n_dims)]), F.col("_dim")) if n_dims else F.lit(0)
    keyed = table.join(dim_of, "_node").withColumn("_key", coord.cast("long") * (1 << (HASH_BITS + ROW_BITS)) + F.col("_low"))
    shift = KEY_BITS
    while shift > 0:
        step = min(STEP_BITS, shift)
        known = _values(spark, [(k, x.prefix, x.below, x.weight * (x.leaves // 2) / x.leaves) for k, x in active.items()], "_node bigint, _p bigint, _below bigint, _goal double")
        cells = keyed.join(F.broadcast(known), "_node").where(F.shiftright("_key", shift) == F.col("_p"))
        sums = cells.groupBy("_node", "_below", "_goal", F.shiftright("_key", shift - step).alias("_cell")).agg(F.sum("_weight").alias("_w"))
        upto = sums.withColumn("_upto", F.col("_below") + F.sum("_w").over(W.partitionBy("_node").orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)))
        found = upto.where(F.col("_upto") >= F.col("_goal")).groupBy("_node").agg(F.min(F.struct("_cell", "_upto", "_w")).alias("x")).collect()
        for r in found:
            x, node = r["x"], active[r["_node"]]
            node.prefix, node.below = x["_cell"], x["_upto"] - x["_w"]
            if shift == step:  # the crossing key itself goes to the nearer side
                goal = node.weight * (node.leaves // 2) / node.leaves
                goes_left = x["_upto"] - goal <= goal - node.below
                node.split, node.left = node.prefix + goes_left, x["_upto"] if goes_left else node.below
        shift -= step
    out = {k: x for k, x in nodes.items() if x.leaves == 1}
    for k, x in active.items():
        half = x.leaves // 2
        out[2 * k + 1] = Node(x.first_leaf, half, x.left)
        out[2 * k + 2] = Node(x.first_leaf + half, x.leaves - half, x.weight - x.left)
    cuts = F.broadcast(_values(spark, [(k, x.split if x.leaves > 1 else -1) for k, x in nodes.items()], "_node bigint, _cut bigint"))
    child = F.when(F.col("_cut") < 0, F.col("_node")).when(F.col("_key") < F.col("_cut"), 2 * F.col("_node") + 1).otherwise(2 * F.col("_node") + 2)
    # Written at each level: plans stay small, and a lost executor costs one level at most.
    return materialize(keyed.join(cuts, "_node").withColumn("_node", child.cast("long")).drop("_dim", "_key", "_cut"), "kd"), out


def name_place(name: Column) -> Column:
    """A number that grows with the name's first six UTF-8 bytes; null for null."""
    head = F.rpad(F.hex(F.substring(F.encode(name.cast("string"), "utf-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def document_shards(docs: DataFrame, leaves: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Documents over (n_chars, source, lang, doc_id); size is the text's UTF-8 bytes plus 1 (null text: 1).

    Names lie by the order of their first letters, n_chars by its logarithm.  Null metadata
    sorts lowest; repeated rows are dealt out like others; further columns don't matter.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    dims = {
        "n_chars": F.log1p(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double")),
        "source": name_place(F.col("source")),
        "lang": name_place(F.col("lang")),
        "doc_id": F.col("doc_id"),
    }
    crc = F.crc32("text")
    keep = [F.col("doc_id"), crc.alias("text_crc32")]
    return kd_shards(docs, size, dims, [F.col("doc_id"), crc, size], keep, target_bytes, leaves).withColumnRenamed("weight", "size")


def op3_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    out = document_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
