"""Edge tables (weight, src, dst) and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: src < dst, one row a pair with its least weight; loops and null ends go."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight")).select("weight", "src", "dst")


def unit_weights(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit(1).cast("bigint").alias("weight"), "src", "dst")


def jittered(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Weights as doubles with up to 1e-9 more, by a hash, so that nearly all ties are broken and reruns agree.

    Cut to integers, whole weights are what they were.
    """
    share = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return edges.withColumn("weight", F.col("weight").cast("double") + share * 1e-9)


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).where("vertex is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex"))
    return ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))


def graph_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All edges of both graphs; a pair that both hold keeps its least weight."""
    return canonical(a.unionByName(b))


def adjacency(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Search records (id, edges, distance, color): ``sources`` (vertex) are GRAY at 0, the rest WHITE."""
    out = both_directions(edges).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("edges"))
    if sources is None:
        return out.select("id", "edges", F.lit(None).cast("int").alias("distance"), F.lit("WHITE").alias("color"))
    marked = out.join(sources.select(F.col("vertex").alias("id"), F.lit(True).alias("_s")).distinct(), "id", "left")
    return marked.select("id", "edges", F.when(F.col("_s"), 0).cast("int").alias("distance"), F.when(F.col("_s"), "GRAY").otherwise("WHITE").alias("color"))


def without_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end in ``gone`` (vertex), with all their columns."""
    columns = edges.columns
    for side in ("src", "dst"):
        edges = edges.join(gone.select(F.col("vertex").alias(side)), side, "left_anti")
    return edges.select(columns)


def uncovered_edges(edges: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges with both ends outside ``covered`` (vertex)."""
    return without_vertices(edges, covered).select("weight", "src", "dst")


def edges_from(edges: DataFrame, vertex: int) -> DataFrame:
    """(vertex): the neighbours of one vertex."""
    return both_directions(edges).where((F.col("src") == vertex) & (F.col("dst") != vertex)).select(F.col("dst").alias("vertex")).distinct()


def has_edge(edges: DataFrame, a: int, b: int) -> bool:
    return not remaining(edges, a, b, keep=True).isEmpty()


def remaining(edges: DataFrame, a: int, b: int, keep: bool = False) -> DataFrame:
    """The edges without those between a and b, or those alone if ``keep``."""
    between = (F.least("src", "dst") == min(a, b)) & (F.greatest("src", "dst") == max(a, b))
    return edges.where(between if keep else ~between)


def half_covered_edges(edges: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges with at least one end outside ``covered`` (vertex)."""
    mark = lambda side: covered.select(F.col("vertex").alias(side), F.lit(True).alias(f"_{side}")).distinct()
    return edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").where("_src is null or _dst is null").select("weight", "src", "dst")


def sample_edges(edges: DataFrame, budget: int, total: int | None = None, seed: int = 1) -> DataFrame:
    """Keep each edge with probability min(1, budget / total), by a hash, so reruns agree."""
    total = edges.count() if total is None else total
    if total <= budget:
        return edges
    span = 1 << 30
    return edges.where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(span)) < int(span * budget / total))
