"""Probabilistic counting: distinct values, and how many vertices each vertex reaches.

Bitmaps are combined with bit_or, so partial aggregation runs before any shuffle.
"""

from __future__ import annotations

import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.sketch import A, B, Q, TOP_BIT, bucket_of, estimate, linear_hash, lowest_set, lowest_unset, reach_bit, stream_bit, tail_of
from loomgraph.operators.stats import RunStats
from loomgraph.plans.store import materialize, ship_package

BUDGET = 100_000
RUN = 100_000  # nodes of a run of the checksum, about
PART = 400_000  # arcs of a shuffle's partition, about, in the search for many numbers of buckets


def pcsa_buckets(values: DataFrame, ks: list[int]) -> DataFrame:
    """(k, bucket, bm, r): each bucket's bitmap over ``values`` (value) and its lowest unset bit."""
    h = linear_hash(F.col("value"))
    spread = values.where("value is not null").select(h.alias("h"), F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k"))
    bits = spread.select("k", bucket_of(F.col("h"), F.col("k")).alias("bucket"), stream_bit(tail_of(F.col("h"), F.col("k"))).alias("bit"))
    return bits.groupBy("k", "bucket").agg(F.bit_or("bit").alias("bm")).withColumn("r", lowest_unset(F.col("bm")).cast("long"))


def approx_distinct(values: DataFrame, ks: list[int]) -> DataFrame:
    """(k, estimate) for each number of buckets; buckets that no value hits count as 0."""
    return pcsa_buckets(values, ks).groupBy("k").agg(F.sum("r").alias("s")).select("k", estimate(F.col("k"), F.col("s")).alias("estimate"))


def _own_bits(nodes: DataFrame, k: int) -> DataFrame:
    h, width = linear_hash(F.col("node")), F.lit(k).cast("long")
    return nodes.select("node", bucket_of(h, width).alias("bucket"), reach_bit(tail_of(h, width)).alias("bm"))


def _fixpoint(k: int):
    def run(batches):
        after, before = defaultdict(list), defaultdict(list)
        for b in batches:
            for u, v in zip(b["src"].tolist(), b["dst"].tolist()):
                after[u].append(v)
                before[v].append(u)
        state = {}
        for v in {*after, *before}:
            h = (A * (v % Q) + B) % Q
            t = h // k
            bit = 0 if t == 0 else min(t & -t, 1 << TOP_BIT)
            state[v] = {h % k: bit}
        work = set(before)
        while work:
            v = work.pop()
            for u in before[v]:
                own, grown = state[u], False
                for bucket, bm in state[v].items():
                    if (new := own.get(bucket, 0) | bm) != own.get(bucket):
                        own[bucket] = new
                        grown = True
                if grown and u in before:
                    work.add(u)
        rows = [(v, b, bm) for v, s in state.items() if v in after for b, bm in s.items()]
        yield pd.DataFrame(rows, columns=["node", "bucket", "bm"]).astype("int64")

    return run


def reach_bitmaps(edges: DataFrame, k: int, budget: int = BUDGET, stop: str = "bitmap", rounds: list | None = None, stats: list | None = None) -> DataFrame:
    """(node, bucket, bm) for every node with an out-edge, over what it reaches, itself included.

    ``stop="bitmap"`` runs to the fixpoint of the bitmaps; ``"estimate"`` ends with the first
    round that changes no estimate.  ``rounds`` gets each round's number and how many nodes
    changed in it, and ``stats`` the same as run statistics.  Small graphs are finished in one task.
    """
    ship_package(edges.sparkSession)
    arcs = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "arcs")
    if stop == "bitmap" and arcs.count() <= budget:
        return arcs.coalesce(1).mapInPandas(_fixpoint(k), "node long, bucket long, bm long")
    nodes = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    state = materialize(_own_bits(nodes, k), "state")
    turn = 0
    while True:
        turn, began = turn + 1, time.time()
        pulled = arcs.join(state, arcs["dst"] == state["node"]).select(F.col("src").alias("node"), "bucket", "bm")
        grown = materialize(state.unionByName(pulled).groupBy("node", "bucket").agg(F.bit_or("bm").alias("bm")), "state")
        old, new = (state, grown) if stop == "bitmap" else (_node_estimates(state, k), _node_estimates(grown, k))
        votes = new.join(old, new.columns, "left_anti").select("node").distinct().count()
        state = grown
        if rounds is not None:
            rounds.append((turn, votes))
        if stats is not None:
            stats.append(RunStats("reach_bitmaps", turn, arcs.count(), remaining=votes, seconds=time.time() - began))
        if not votes:
            break
    return state.join(arcs.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node", "bucket", "bm")


def _node_estimates(bitmaps: DataFrame, k: int) -> DataFrame:
    total = bitmaps.groupBy("node").agg(F.sum(lowest_unset(F.col("bm")).cast("long")).alias("s"))
    return total.select("node", estimate(F.lit(k).cast("long"), F.col("s")).alias("estimate"))


def estimate_reachable(edges: DataFrame, k: int, **how) -> DataFrame:
    """(node, estimate) of how many vertices each node with an out-edge reaches."""
    return _node_estimates(reach_bitmaps(edges, k, **how), k)


def _fold_run(batches):
    """(start, a, b): the affine map of a partition's nodes, which come in order."""
    a, b, start = 1, 0, None
    for batch in batches:
        for node, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = node if start is None else start
            a, b = a * A % Q, (A * ((b + e) % Q) + B) % Q
    if start is not None:
        yield pa.RecordBatch.from_pydict({"start": [start], "a": [a], "b": [b]})


def ordered_checksum(estimates: DataFrame) -> DataFrame:
    """(checksum): c becomes h(c + estimate) over the nodes in order, from 0.

    h is affine, so a run of nodes is an affine map c -> a * c + b.  Nodes are dealt by range to
    runs of about RUN rows, whatever their ids, each is folded as a stream, and only the runs' maps meet.
    """
    ship_package(estimates.sparkSession)
    rows = materialize(estimates.select("node", "estimate"), "estimates")
    runs = rows.repartitionByRange(max(1, -(-rows.count() // RUN)), "node").sortWithinPartitions("node").mapInArrow(_fold_run, "start long, a long, b long")
    order = runs.agg(F.sort_array(F.collect_list(F.struct("start", "a", "b"))).alias("xs"))
    big = lambda c: c.cast("decimal(38,0)")
    whole = F.aggregate("xs", F.lit(0).cast("long"), lambda c, x: ((big(x["a"]) * big(c) + big(x["b"])) % F.lit(Q).cast("decimal(38,0)")).cast("long"))
    return order.select(whole.alias("checksum"))


def _hashed(rows: DataFrame, node: str, k: int, levels: int) -> DataFrame:
    """``rows`` with the bit and the mask of its bucket that the hash of ``node`` sets, in a projection of its own."""
    h, width = linear_hash(F.col(node)), F.lit(k).cast("long")
    tail, mask = tail_of(h, width), F.call_function("shiftleft", F.lit(1).cast("long"), bucket_of(h, width).cast("int"))
    return rows.withColumns({"level": F.when(tail == 0, F.lit(levels)).otherwise(lowest_set(tail).cast("int")), "mask": mask})


def _own_masks(levels: int) -> list[Column]:
    """(m0, m1, ..., zero) of hashed rows: of the masks of buckets, one for each bit of a bitmap, the one that the node's hash sets.

    ``zero`` has the buckets of zero tails, which set no bit of k buckets but may set one of fewer.
    """
    return [F.when(F.col("level") == i, F.col("mask")).otherwise(F.lit(0).cast("long")).alias(f"m{i}") for i in range(levels + 1)]


def _reach_masks(arcs: DataFrame, k: int, levels: int, rounds: list | None, stats: list | None) -> DataFrame:
    """(node, masks) to the fixpoint, for every node with an out-edge; ``arcs`` are distinct.

    Successors' own bits come without a join, and then only nodes that changed are sent on.
    Joins are told to sort: masks are mostly zeros, so their files are small, and by the files' size
    the planner would have the driver broadcast the ids of all nodes.
    """
    names = [f"m{i}" for i in range(levels + 1)]
    size = sum((F.bit_count(c).cast("long") for c in names[1:]), F.bit_count(names[0]).cast("long"))
    merged = [F.bit_or(c).alias(c) for c in names]
    began, n = time.time(), arcs.count()
    first = _hashed(arcs, "dst", k, levels).select(F.col("src").alias("node"), *_own_masks(levels)).groupBy("node").agg(*merged)
    own = _hashed(first, "node", k, levels).select("node", *[F.col(c).bitwiseOR(x).alias(c) for c, x in zip(names, _own_masks(levels))])
    state = materialize(own.select("node", F.lit(1).cast("long").alias("was"), size.alias("bits"), *names), "masks")
    # Arcs to nodes without out-edges have said all they can.
    inner = materialize(arcs.join(state.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi"), "inner")
    asked = materialize(inner.select(F.col("dst").alias("node")).distinct(), "asked")
    turn, grew = 0, state
    while True:
        turn, votes = turn + 1, grew.join(asked.hint("merge"), "node", "left_semi").count()
        if rounds is not None:
            rounds.append((turn, votes))
        if stats is not None:
            stats.append(RunStats("reach_summary", turn, n, remaining=votes, seconds=time.time() - began))
        if not votes:
            return state
        began = time.time()
        told = inner.join(grew.select(F.col("node").alias("dst"), *names).hint("merge"), "dst").select(F.col("src").alias("node"), F.lit(0).cast("long").alias("was"), *names)
        both = state.select("node", F.col("bits").alias("was"), *names).unionByName(told).groupBy("node").agg(F.max("was").alias("was"), *merged)
        state = materialize(both.select("node", "was", size.alias("bits"), *names), "masks")
        grew = state.where("bits > was")  # bits are only ever added


def _fold_masks(ks: list[int], k: int, levels: int):
    """(node, sum for each of ``ks``) of lowest unset bits: what a search with k buckets tells about fewer.

    A hash t * k + b falls to bucket b % few, with the tail t * (k / few) + b // few.
    """

    def run(batches):
        for batch in batches:
            masks = [batch.column(i + 1).to_numpy().view(np.uint64) for i in range(levels + 1)]
            some = np.bitwise_or.reduce(masks)
            out = []
            for few in ks:
                low, shift = np.uint64((1 << few) - 1), (k // few).bit_length() - 1
                bits = [np.zeros(len(some), np.uint64) for _ in range(TOP_BIT + 1)]
                for c in range(1, k // few):
                    bits[(c & -c).bit_length() - 1] |= (some >> np.uint64(few * c)) & low
                for i in range(levels):
                    bits[min(i + shift, TOP_BIT)] |= masks[i] & low
                total, full = np.zeros(len(some), np.int64), np.full(len(some), low)
                for x in bits:
                    full = full & x
                    total += np.bitwise_count(full)
                out.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["node", *[f"s{x}" for x in ks]])

    return run


def _all_estimates(arcs: DataFrame, ks: list[int], rounds: list | None = None, stats: list | None = None) -> DataFrame:
    """(node, e1, e4, ...) the estimates for all numbers of buckets, powers of 2 up to 64, by one search with the most."""
    spark, k = arcs.sparkSession, max(ks)
    levels = Q.bit_length() - (k.bit_length() - 1)  # a tail is less than 2 ** levels
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-arcs.count() // PART))))  # a partition's masks fit a task
    try:
        masks = _reach_masks(arcs, k, levels, rounds, stats)
    finally:
        spark.conf.set(name, before)
    sums = masks.select("node", *[f"m{i}" for i in range(levels + 1)]).mapInArrow(_fold_masks(ks, k, levels), "node long" + "".join(f", s{x} long" for x in ks))
    return materialize(sums.select("node", *[estimate(F.lit(x).cast("long"), F.col(f"s{x}")).alias(f"e{x}") for x in ks]), "estimates")


def reach_summary(edges: DataFrame, ks: list[int], budget: int = BUDGET, stop: str = "bitmap", rounds: list | None = None, stats: list | None = None) -> DataFrame:
    """(k, nodes, least, most, mean, checksum) for each number of buckets.

    Powers of 2 up to 64 share one search to the fixpoint, unless the graph fits ``budget``.
    """
    ship_package(edges.sparkSession)
    arcs = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    arcs = materialize(arcs.hint("rebalance", "src"), "arcs")  # a node's arcs side by side, those of a hot one in parts
    found = None
    if stop == "bitmap" and all(0 < k <= 64 and k & (k - 1) == 0 for k in ks) and arcs.count() > budget:
        found = _all_estimates(arcs, sorted(set(ks)), rounds, stats)
    out = None
    for k in ks:
        est = found.select("node", F.col(f"e{k}").alias("estimate")) if found is not None else materialize(estimate_reachable(arcs, k, budget=budget, stop=stop, rounds=rounds, stats=stats), "estimates")
        row = est.agg(F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("nodes"), F.min("estimate").alias("least"), F.max("estimate").alias("most"), F.round(F.avg("estimate")).cast("long").alias("mean"))
        row = row.withColumn("checksum", ordered_checksum(est).scalar())
        out = row if out is None else out.unionByName(row)
    return out
