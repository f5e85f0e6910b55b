"""Vertex covers and edge covers that follow from a matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.matching import maximal_matching, maximum_matching
from loomgraph.operators.model import canonical, vertices


def _matching(edges: DataFrame, maximum: bool, stats: list | None) -> DataFrame:
    return maximum_matching(edges, stats=stats) if maximum else maximal_matching(edges, stats=stats)


def vertex_cover(edges: DataFrame, matching: DataFrame | None = None, maximum: bool = False, stats: list | None = None) -> DataFrame:
    """(vertex): the ends of a maximal matching, at most twice as many as needed."""
    return vertices(matching if matching is not None else _matching(edges, maximum, stats))


def cover_topup(edges: DataFrame, matching: DataFrame) -> DataFrame:
    """The first edge in (weight, src, dst) order of each vertex that the matching leaves out."""
    simple = canonical(edges)
    ends = simple.select(F.explode(F.array("src", "dst")).alias("vertex"), F.struct("weight", "src", "dst").alias("e"))
    return ends.join(vertices(matching), "vertex", "left_anti").groupBy("vertex").agg(F.min("e").alias("e")).select("e.*")


def edge_cover(edges: DataFrame, matching: DataFrame | None = None, maximum: bool = False, stats: list | None = None) -> DataFrame:
    """(weight, src, dst): the matching and one edge more for each vertex that it leaves out."""
    chosen = matching if matching is not None else _matching(edges, maximum, stats)
    return chosen.unionByName(cover_topup(edges, chosen))


def check_vertex_cover(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(covers): whether every edge has an end in ``cover``."""
    left = canonical(edges)
    for side in ("src", "dst"):
        left = left.join(cover.select(F.col("vertex").alias(side)), side, "left_anti")
    return left.agg((F.count(F.lit(1)) == 0).alias("covers"))
