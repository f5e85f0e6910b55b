"""Greedy maximal matching in a stated order of the edges, and exact maximum matching.

The order is (weight, src, dst), or the text of ``WEIGHT<TAB>SRC``, or a column that the
caller supplies, such as the line number of the input; ties go by (src, dst).  An edge that comes first at both of its ends is in the greedy matching; such edges are
taken together round by round until the rest fits ``budget`` edges and one task.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.blossom import maximum_pairs, parts_without
from loomgraph.operators.components import label_nodes
from loomgraph.operators.model import canonical, sample_edges, vertices, without_vertices
from loomgraph.operators.stats import RunStats
from loomgraph.plans.store import discard, materialize, ship_package

BUDGET = 200_000
MOST = 300_000  # edges that one task matches: a component, or a share of the core of larger ones
PICKS = 2  # edges of a vertex that enter a core at once, at most


def _greedy(batches):
    table = pd.concat([b for b in batches] or [pd.DataFrame(columns=["rank", "weight", "src", "dst"])]).sort_values(["rank", "src", "dst"])
    taken: set = set()
    keep = []
    for u, v in zip(table["src"].tolist(), table["dst"].tolist()):
        free = u not in taken and v not in taken
        keep.append(free)
        if free:
            taken.add(u)
            taken.add(v)
    table = table[["weight", "src", "dst"]]
    yield table[keep] if keep else table


def _finish(edges: DataFrame) -> DataFrame:
    return edges.select("rank", "weight", "src", "dst").coalesce(1).mapInPandas(_greedy, edges.select("weight", "src", "dst").schema)


def ranked(edges: DataFrame, order: str = "weight") -> DataFrame:
    """Simple edges (rank, weight, src, dst); of parallel ones the first in the order stays."""
    rank = F.concat(F.col("weight").cast("string"), F.lit("\t"), F.col("src").cast("string")) if order == "text" else F.col(order)
    named = edges.where("src <> dst").select(rank.alias("rank"), "weight", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return named.groupBy("src", "dst").agg(F.min(F.struct("rank", "weight")).alias("e")).select("e.rank", "e.weight", "src", "dst")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def maximal_matching(edges: DataFrame, budget: int = BUDGET, order: str = "weight", stats: list | None = None) -> DataFrame:
    """(weight, src, dst): what a sequential greedy pass in the order takes."""
    ship_package(edges.sparkSession)
    rest = materialize(ranked(edges, order), "edges")
    found = []
    while (n := rest.count()) > budget:
        began = time.time()
        ends = rest.select(F.explode(F.array("src", "dst")).alias("v"), F.struct("rank", "src", "dst", "weight").alias("e"))
        firsts = ends.groupBy("v").agg(F.min("e").alias("e"))
        picks = materialize(firsts.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e.weight", "e.src", "e.dst"), "picks")
        found.append(picks)
        fresh = materialize(without_vertices(rest, vertices(picks)), "edges")
        discard(rest)
        rest = fresh
        if stats is not None:
            stats.append(RunStats("maximal_matching", len(found), n, matched=picks.count(), remaining=rest.count(), seconds=time.time() - began))
    began, last = time.time(), _finish(rest)
    if stats is not None:
        last = materialize(last, "picks")
        stats.append(RunStats("maximal_matching", len(found) + 1, n, matched=last.count(), remaining=0, seconds=time.time() - began))
    return _union([*found, last])


def maximal_matching_by_filtering(edges: DataFrame, budget: int = 25_000, seed: int = 1, order: str = "weight", stats: list | None = None) -> DataFrame:
    """A maximal matching by sampling to the budget, matching the sample in one task, and filtering.

    Valid and maximal, but another matching than the greedy one over all edges.
    """
    ship_package(edges.sparkSession)
    rest = materialize(ranked(edges, order), "edges")
    found = []
    while True:
        n, began = rest.count(), time.time()
        sample = sample_edges(rest, budget, n, seed + len(found))
        picks = materialize(_finish(sample), "picks")
        found.append(picks)
        fresh = None if n <= budget else materialize(without_vertices(rest, vertices(picks)), "edges")
        if stats is not None:
            stats.append(RunStats("maximal_matching_by_filtering", len(found), n, sample.count(), picks.count(), 0 if fresh is None else fresh.count(), time.time() - began))
        if fresh is None:
            return _union(found)
        discard(rest)
        rest = fresh


def _picks(edges: DataFrame, seed: int, most: int) -> DataFrame:
    """Of each vertex PICKS edges at most, by hashes; if that makes more than ``most``, only those to a vertex of lower degree.

    So the number follows the hubs and not the many vertices around them; the highest degree always picks.
    """
    ends = edges.select("weight", F.xxhash64("src", "dst", F.lit(seed)).alias("h"), F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("w")), F.struct(F.col("dst").alias("v"), F.col("src").alias("w")))).alias("e"))
    ends = ends.select("weight", "e.v", "e.w", *[F.xxhash64("h", F.lit(i)).alias(f"h{i}") for i in range(PICKS)])
    firsts = [F.min_by(c, f"h{i}").alias(f"{c}{i}") for i in range(PICKS) for c in ("weight", "w")]
    picked = materialize(ends.groupBy("v").agg(F.count(F.lit(1)).alias("degree"), *firsts), "picks")
    each = picked.select("v", "degree", F.explode(F.array(*[F.struct(F.col(f"weight{i}").alias("weight"), F.col(f"w{i}").alias("w")) for i in range(PICKS)])).alias("e")).select("v", "degree", "e.weight", "e.w").distinct()
    named = ["weight", F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst")]
    if (every := each.select(*named).distinct()).count() <= most:
        return every
    lower = picked.select(F.col("v").alias("w"), F.col("degree").alias("other")).hint("merge")
    return each.join(lower, "w").where("degree > other or degree = other and v > w").select(*named).distinct()


def _solve(table: pd.DataFrame) -> pd.DataFrame:
    """The matching, the barrier and the parts without it, of one or more components."""
    table = table.sort_values(["weight", "src", "dst"])
    ends = list(zip(table["src"].tolist(), table["dst"].tolist()))
    pairs, barrier = maximum_pairs(ends)
    chosen = table[[p in pairs for p in ends]][["weight", "src", "dst"]]
    blank = {"weight": None, "src": None, "dst": None}
    parts = parts_without(ends, barrier)
    named = pd.DataFrame({**blank, "barrier": None, "vertex": list(parts), "part": list(parts.values())})
    return pd.concat([chosen.assign(barrier=None, vertex=None, part=None), pd.DataFrame({**blank, "barrier": barrier, "vertex": None, "part": None}), named]).astype(object)


def _dealt(core: DataFrame, most: int) -> DataFrame:
    """The core in groups (component) of about ``most`` edges that share no vertex; more that hang together raise an error."""
    groups = -(-core.count() // most)
    if groups < 2:
        return core.withColumn("component", F.lit(0).cast("long"))
    owned = core.join(label_nodes(core).withColumnRenamed("node", "src").hint("merge"), "src")
    big = owned.groupBy("component").count().agg(F.max("count")).first()[0]
    if big > most:
        raise ValueError(f"a component's core has {big} edges that hang together; one worker takes {most}")
    return owned.select("weight", "src", "dst", F.pmod(F.xxhash64("component"), F.lit(groups)).cast("long").alias("component"))


def _across(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges between two parts of a solved core without the barrier."""
    barrier = materialize(found.where("barrier is not null").select("barrier"), "barrier")
    how = "broadcast" if barrier.count() <= BUDGET else "merge"
    left = edges
    for side in ("dst", "src"):
        left = left.join(barrier.withColumnRenamed("barrier", side).hint(how), side, "left_anti")
    for side in ("src", "dst"):
        part = found.where("vertex is not null").select(F.col("vertex").alias(side), F.col("part").alias(f"part_{side}"))
        left = left.join(part.hint("merge"), side, "left")
    return left.where(F.coalesce("part_src", "src") != F.coalesce("part_dst", "dst")).select("weight", "src", "dst")


def _solved(edges: DataFrame, most: int, stats: list | None = None) -> DataFrame:
    """(weight, src, dst, barrier, ...): the edges of a maximum matching and, in rows of their own, the vertices that prove it.

    Of a component with more than ``most`` edges workers get a core only: a few edges of its
    vertices.  The barrier of a core's matching proves it for the component too, unless an edge
    joins two parts that the core keeps apart without the barrier; a vertex outside the core is
    a part of its own.  A few such edges enter the core, and it is solved again, until there are
    none.  A core of more than ``most`` edges is dealt out by its own components.
    """
    ship_package(edges.sparkSession)
    began = time.time()
    simple = materialize(canonical(edges), "edges")
    labels = materialize(label_nodes(simple).withColumnRenamed("node", "src"), "labels")
    counts = simple.groupBy("src").count().join(labels, "src").groupBy("component").agg(F.sum("count").alias("n"))
    sizes = materialize(counts.select("component", (F.col("n") > most).alias("large")), "sizes")
    kind = simple.schema["weight"].dataType.simpleString()
    schema = f"weight {kind}, src long, dst long, barrier long, vertex long, part long"
    solve = lambda some: materialize(some.groupBy("component").applyInPandas(_solve, schema), "maximum")
    kinds = {r["large"] for r in sizes.select("large").distinct().collect()}
    rest = simple
    if kinds != {True}:
        owned = simple.join(labels.join(sizes.hint("merge"), "component").hint("merge"), "src").select("weight", "src", "dst", "component", "large")
        if True in kinds:
            owned = materialize(owned, "owned")
        rest, out = owned.where("large").select("weight", "src", "dst"), solve(owned.where("not large").select("weight", "src", "dst", "component"))
    core, turn = materialize(_picks(rest, 0, most), "core") if True in kinds else None, 0
    while core is not None:
        turn += 1
        found = solve(_dealt(core, most))
        across = materialize(_across(rest, found), "across")
        if across.isEmpty():
            out, core = found if kinds == {True} else out.unionByName(found), None
        else:
            core = materialize(core.unionByName(_picks(across, turn, most)).distinct(), "core")
    if stats is not None:
        stats.append(RunStats("maximum_matching", max(turn, 1), simple.count(), matched=out.where("src is not null").count(), remaining=0, seconds=time.time() - began))
    return out


def maximum_matching(edges: DataFrame, most: int = MOST, stats: list | None = None) -> DataFrame:
    """(weight, src, dst) of a matching with the most edges: one blossom search a component.

    A component of more than ``most`` edges is solved by a core of its edges that grows as far
    as the proof needs; more than ``most`` edges of it that hang together raise an error.
    """
    return _solved(edges, most, stats).where("src is not null").select("weight", "src", "dst")


def maximum_matching_proof(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(edges, bound): the size of a maximum matching, and the most that its barrier allows (Tutte and Berge).

    The bound is (vertices + barrier - odd components without the barrier) / 2; equal
    numbers prove the matching, whatever found it.
    """
    simple = materialize(canonical(edges), "edges")
    solved = _solved(simple, most)
    barrier = solved.where("barrier is not null").select(F.col("barrier").alias("vertex"))
    rest = without_vertices(simple, barrier)
    left = vertices(simple).join(barrier, "vertex", "left_anti").join(label_nodes(rest).withColumnRenamed("node", "vertex"), "vertex", "left")
    odd = left.groupBy(F.coalesce("component", "vertex").alias("component")).count().where("count % 2 = 1").agg(F.count(F.lit(1)).alias("n"))
    whole = vertices(simple).agg(F.count(F.lit(1)).alias("n"))
    size = solved.agg(F.count("src").alias("edges"), F.count("barrier").alias("barrier"))
    return size.select("edges", ((whole.scalar() + F.col("barrier") - odd.scalar()) / 2).cast("long").alias("bound"))


def check_matching(edges: DataFrame, matching: DataFrame) -> DataFrame:
    """(valid, maximal): no vertex twice and only edges of the graph; no edge left with two free ends."""
    simple = canonical(edges)
    ends = matching.select(F.explode(F.array("src", "dst")).alias("vertex"))
    twice = ends.groupBy("vertex").count().where("count > 1").agg(F.count(F.lit(1)).alias("twice"))
    strange = matching.join(simple, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("strange"))
    free = without_vertices(simple, ends.distinct()).agg(F.count(F.lit(1)).alias("free"))
    return matching.sparkSession.range(1).select(((twice.scalar() == 0) & (strange.scalar() == 0)).alias("valid"), (free.scalar() == 0).alias("maximal"))
