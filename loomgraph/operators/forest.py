"""Minimum spanning forest under the order (weight, src, dst), which makes it unique.

While the edges exceed ``budget``: every component takes its least edge (Boruvka), the
components are contracted, and of edges between the same two components only the least
is kept.  The rest is finished by Kruskal's algorithm in one task.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import label_nodes
from loomgraph.operators.model import canonical
from loomgraph.operators.stats import RunStats
from loomgraph.plans.store import discard, materialize, ship_package

BUDGET = 200_000


def _kruskal(batches):
    table = pd.concat([b for b in batches] or [pd.DataFrame(columns=["weight", "src", "dst", "u", "v"])])
    table = table.sort_values(["weight", "src", "dst"])
    parent: dict = {}
    keep = []
    for u, v in zip(table["u"].tolist(), table["v"].tolist()):
        roots = []
        for x in (u, v):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            roots.append(x)
        keep.append(roots[0] != roots[1])
        parent[roots[0]] = roots[1]
    yield table[keep][["weight", "src", "dst"]] if keep else table[["weight", "src", "dst"]]


def spanning_forest(edges: DataFrame, budget: int = BUDGET, stats: list | None = None) -> DataFrame:
    """(weight, src, dst) of the minimum spanning forest."""
    ship_package(edges.sparkSession)
    rest = materialize(canonical(edges).selectExpr("weight", "src", "dst", "src as u", "dst as v"), "edges")
    kind = rest.schema["weight"].dataType.simpleString()
    found = []
    while (n := rest.count()) > budget:
        began = time.time()
        ends = rest.select(F.explode(F.array("u", "v")).alias("c"), "weight", "src", "dst", "u", "v")
        picks = materialize(ends.groupBy("c").agg(F.min(F.struct("weight", "src", "dst", "u", "v")).alias("e")).select("e.*").distinct(), "picks")
        found.append(picks.select("weight", "src", "dst"))
        labels = materialize(label_nodes(picks, "u", "v"), "labels")
        to = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))  # noqa: E731, B023
        moved = rest.join(to("u"), "u").join(to("v"), "v").where("cu <> cv")
        least = moved.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.min(F.struct("weight", "src", "dst")).alias("e"))
        fresh = materialize(least.select("e.*", "u", "v"), "edges")
        if stats is not None:
            stats.append(RunStats("spanning_forest", len(found), n, matched=picks.count(), remaining=fresh.count(), seconds=time.time() - began))
        discard(rest)
        rest = fresh
    began, last = time.time(), rest.coalesce(1).mapInPandas(_kruskal, f"weight {kind}, src long, dst long")
    if stats is not None:
        last = materialize(last, "picks")
        stats.append(RunStats("spanning_forest", len(found) + 1, n, matched=last.count(), remaining=0, seconds=time.time() - began))
    found.append(last)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
