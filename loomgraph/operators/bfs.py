"""Level-synchronous breadth-first search from any number of sources.

The frontier is joined with the edges, visited vertices are dropped, and what is new
becomes the next frontier.  A source may start at a distance of its own, and joins the
frontier when the search is that deep.  A graph of at most ``budget`` edges is searched
in one task.
"""

from __future__ import annotations

import time
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.stats import RunStats
from loomgraph.plans.store import materialize, ship_package

BUDGET = 200_000


def _search(batches):
    near, starts = defaultdict(list), defaultdict(list)
    for b in batches:
        for u, v, d in zip(b["u"].tolist(), b["v"].tolist(), b["distance"].tolist()):
            if d == d and d is not None:  # a row with a distance names a source
                starts[int(d)].append(int(v))
            else:
                near[int(u)].append(int(v))
    found: dict = {}
    level, depth = [], min(starts, default=0)
    while level or starts:
        if not level:
            depth = min(starts)
        level = [v for v in dict.fromkeys(level + starts.pop(depth, [])) if v not in found]
        found.update(dict.fromkeys(level, depth))
        level = [w for v in level for w in near.get(v, ()) if w not in found]
        depth += 1
    yield pd.DataFrame({"vertex": pd.Series(list(found), dtype="int64"), "distance": pd.Series(list(found.values()), dtype="int32")})


def bfs(edges: DataFrame, sources: DataFrame, directed: bool = False, budget: int = BUDGET, max_depth: int | None = None, stats: list | None = None) -> DataFrame:
    """(vertex, distance) of the vertices that ``sources`` (vertex) reach over (src, dst).

    If the sources have a column ``distance``, each starts at its own (null: 0), and the least
    distance from any of them counts.  ``stats`` gets a row for each level.
    """
    ship_package(edges.sparkSession)
    arcs = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    arcs = materialize((arcs if directed else arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))).distinct(), "arcs")
    own = F.coalesce(F.col("distance").cast("int"), F.lit(0)) if "distance" in sources.columns else F.lit(0)
    starts = sources.where("vertex is not null").groupBy("vertex").agg(F.min(own).alias("distance"))
    if max_depth is None and stats is None and arcs.count() <= budget:
        marked = arcs.withColumn("distance", F.lit(None).cast("int")).unionByName(starts.select(F.lit(None).cast("long").alias("u"), F.col("vertex").alias("v"), "distance"))
        return marked.coalesce(1).mapInPandas(_search, "vertex long, distance int")
    starts = materialize(starts, "starts")
    depths = sorted(r[0] for r in starts.select("distance").distinct().collect())  # as many as there are starting distances
    if not depths:
        return starts
    depth, began = depths.pop(0), time.time()
    level = materialize(starts.where(F.col("distance") == depth), "level")
    seen, levels, turn = level, [level], 0
    # A neighbour of an undirected level lies at most one level from it, so two levels tell what is new.
    brief = not directed and not depths
    while max_depth is None or depth < max_depth:
        turn += 1
        if stats is not None:
            stats.append(RunStats("bfs", turn, arcs.count(), matched=level.count(), seconds=time.time() - began))
            began = time.time()
        depth += 1
        new = level.join(arcs, level["vertex"] == arcs["u"]).select(F.col("v").alias("vertex")).distinct()
        if depths and depths[0] == depth:
            new = new.union(starts.where(F.col("distance") == depths.pop(0)).select("vertex")).distinct()
        past = levels[-1] if len(levels) < 2 else levels[-1].unionByName(levels[-2])
        new = new.join(past if brief else seen, "vertex", "left_anti")
        level = materialize(new.withColumn("distance", F.lit(depth)), "level")
        if level.isEmpty():
            if not depths:
                break
            depth = depths[0] - 1
            continue
        seen = seen.unionByName(level)
        levels = [*levels[-1:], level]
    return seen


def bfs_records(records: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Search records (id, edges, distance, color): GRAY rows are sources, each at its own distance (null: 0).

    Neighbours without a record get one.  Of a row's own and its reached distance the lesser
    stays.  GRAY and reached rows become BLACK, rows that were BLACK stay so and are not
    searched again, and the others keep WHITE.
    """
    arcs = records.select("id", "color", F.explode("edges").alias("dst"))
    sources = records.where("color = 'GRAY'").select(F.col("id").alias("vertex"), "distance")
    reached = bfs(arcs.where("color <> 'BLACK'").select(F.col("id").alias("src"), "dst"), sources, directed=True, budget=budget)
    ids = records.select("id").union(arcs.select("dst")).distinct()
    out = ids.join(records, "id", "left").join(reached.select(F.col("vertex").alias("id"), F.col("distance").alias("_d")), "id", "left")
    return out.select("id", F.coalesce("edges", F.array().cast("array<bigint>")).alias("edges"), F.least("distance", "_d").cast("int").alias("distance"),
                      F.when(F.col("_d").isNotNull() | (F.col("color") == "BLACK"), "BLACK").otherwise("WHITE").alias("color"))
