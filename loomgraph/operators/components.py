"""Connected components by contraction.

Each round every node takes the least of itself and its neighbours as its parent, parents
are followed a few steps (pointer jumping), and edges are renamed to their ends' parents;
loops and repeats vanish, so the edge table shrinks from round to round.  Once it is
under ``budget`` edges, one task finishes it with a union-find.  A component's label is
its least node, because the least node is always its own parent.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.stats import RunStats
from loomgraph.plans.store import discard, materialize, ship_package

BUDGET = 50_000
JUMPS = 3
MAX_ROUNDS = 200


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    if nodes:
        yield pd.DataFrame({"node": nodes, "parent": [root(x) for x in nodes]})


def label_nodes(edges: DataFrame, src: str = "src", dst: str = "dst", budget: int = BUDGET, stats: list | None = None) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    Rows with a null end and loops name no link; ``edges`` may repeat and run either way.
    ``stats`` gets a row for each round.
    """
    ship_package(edges.sparkSession)
    kind = edges.schema[src].dataType
    links = edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct()
    links = materialize(links, "links")
    steps: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        n, began = links.count(), time.time()
        if n <= budget:
            schema = f"node {kind.simpleString()}, parent {kind.simpleString()}"
            steps.append(materialize(links.coalesce(1).mapInPandas(_union_find, schema), "parents"))
            if stats is not None:
                stats.append(RunStats("connected_components", turn + 1, n, remaining=0, seconds=time.time() - began))
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent"))
        for _ in range(JUMPS):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parents = materialize(parents.join(up, "parent").select("node", F.col("above").alias("parent")), "parents")
        steps.append(parents)
        to = lambda side: parents.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))  # noqa: E731, B023
        moved = links.join(to("u"), "u").join(to("v"), "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        fresh = materialize(moved, "links")
        discard(links)
        links = fresh
        if stats is not None:
            stats.append(RunStats("connected_components", turn + 1, n, remaining=links.count(), seconds=time.time() - began))
    else:
        raise RuntimeError("components did not settle")
    out = steps[0].withColumnRenamed("parent", "component")
    for s in steps[1:]:
        up = s.select(F.col("node").alias("component"), F.col("parent").alias("above"))
        out = out.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return out


def connected_components(edges: DataFrame, budget: int = BUDGET, stats: list | None = None) -> DataFrame:
    """(node, component = least node) for every end of an edge; a node with loops only is its own component."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    return nodes.join(label_nodes(edges, budget=budget, stats=stats), "node", "left").select("node", _own("component").alias("component"))


def _own(label: str) -> Column:
    return F.coalesce(F.col(label), F.col("node"))
