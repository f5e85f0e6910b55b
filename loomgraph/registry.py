"""The registered graph queries and their SQL oracles (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.sketch import A, B, PHI, Q, TOP_BIT
from loomgraph.operators import bfs as search
from loomgraph.operators import components as cc
from loomgraph.operators import cover, forest, grouping, matching, model, sketch
from loomgraph.operators.stats import stats_frame
from loomgraph.plans.fixtures import graph, graph_sql
from loomgraph.plans.store import materialize, scratch_path
from loomgraph.sources import files, text
from loomgraph.sources.text import decode_adjacency, encode_adjacency

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _c(name: str) -> str:
    """The canonical edges of a graph, ranked, as the start of a WITH clause."""
    return (
        f"RECURSIVE raw AS ({graph_sql(name)}), e AS (SELECT min(weight) AS weight, least(src, dst) AS src, greatest(src, dst) AS dst FROM raw WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst)), "
        "k AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS i FROM e), u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)"
    )


LABELS = "r(v, l) AS (SELECT a, a FROM u UNION SELECT u.b, r.l FROM r JOIN u ON r.v = u.a WHERE r.l < u.b), c AS (SELECT v AS node, min(l) AS component FROM r GROUP BY v)"
GREEDY = (
    "g(i, used, hit) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT k.i, CASE WHEN list_contains(g.used, k.src) OR list_contains(g.used, k.dst) THEN g.used ELSE list_concat(g.used, [k.src, k.dst]) END, "
    "NOT (list_contains(g.used, k.src) OR list_contains(g.used, k.dst)) FROM g JOIN k ON k.i = g.i + 1), m AS (SELECT k.weight, k.src, k.dst FROM g JOIN k ON k.i = g.i WHERE g.hit)"
)
FOREST = (
    "vs AS (SELECT list(DISTINCT a) AS vs FROM u), ix AS (SELECT unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS p FROM vs), kk AS (SELECT k.*, x.p AS sp, y.p AS dp FROM k JOIN ix x ON k.src = x.v JOIN ix y ON k.dst = y.v), "
    "f(i, m, hit) AS (SELECT 0::BIGINT, range(1, len(vs) + 1), false FROM vs UNION ALL SELECT kk.i, CASE WHEN f.m[kk.sp] = f.m[kk.dp] THEN f.m ELSE list_transform(f.m, lambda x: CASE WHEN x = greatest(f.m[kk.sp], f.m[kk.dp]) THEN least(f.m[kk.sp], f.m[kk.dp]) ELSE x END) END, "
    "f.m[kk.sp] <> f.m[kk.dp] FROM f JOIN kk ON kk.i = f.i + 1), t AS (SELECT k.weight, k.src, k.dst FROM f JOIN k ON k.i = f.i WHERE f.hit)"
)
TOPUP = "b AS (SELECT src AS v FROM m UNION SELECT dst FROM m), tu AS (SELECT DISTINCT weight, src, dst FROM (SELECT k.*, u.a, row_number() OVER (PARTITION BY u.a ORDER BY k.i) AS n FROM k JOIN u ON (u.a = k.src AND u.b = k.dst) OR (u.a = k.dst AND u.b = k.src) WHERE u.a NOT IN (SELECT v FROM b)) WHERE n = 1)"


@_add("edge_scan_canonical", f"WITH {_c('sparse')} SELECT weight, src, dst FROM e")
def edge_scan_canonical(spark: SparkSession, d: str) -> DataFrame:
    return model.canonical(graph(spark, d, "sparse"))


@_add("unit_weight_edges", f"WITH {_c('sparse')} SELECT 1::BIGINT AS weight, src, dst FROM e")
def unit_weight_edges(spark, d):
    return model.unit_weights(model.canonical(graph(spark, d, "sparse")))


@_add("jittered_weights", f"WITH {_c('full')} SELECT weight, src, dst, true AS near FROM e")
def jittered_weights(spark, d):
    """Jitter, cut off again, and whether it stays within a billionth (and a double's rounding)."""
    spread = model.jittered(model.canonical(graph(spark, d, "full")).withColumn("before", F.col("weight")))
    return spread.select(F.col("weight").cast("bigint").alias("weight"), "src", "dst", F.col("weight").between(F.col("before"), F.col("before") + 1e-6).alias("near"))


@_add("edge_sample_whole", f"WITH {_c('sparse')} SELECT weight, src, dst FROM e")
def edge_sample_whole(spark, d):
    """A budget over the number of edges keeps them all."""
    return model.sample_edges(model.canonical(graph(spark, d, "sparse")), 10**9)


@_add("graph_union", f"WITH a AS ({graph_sql('sparse')} UNION ALL {graph_sql('orders')}) SELECT min(weight) AS weight, least(src, dst) AS src, greatest(src, dst) AS dst FROM a GROUP BY ALL")
def graph_union(spark, d):
    return model.graph_union(graph(spark, d, "sparse"), graph(spark, d, "orders"))


@_add("vertex_count", f"WITH {_c('full')} SELECT count(DISTINCT a) AS vertices FROM u")
def vertex_count(spark, d):
    return model.vertices(graph(spark, d, "full")).agg(F.count(F.lit(1)).alias("vertices"))


@_add("vertex_degree", f"WITH {_c('full')} SELECT a AS vertex, count(*) AS degree FROM u GROUP BY a")
def vertex_degree(spark, d):
    return model.degrees(model.canonical(graph(spark, d, "full")))


ADJACENCY = f"WITH {_c('sparse')} SELECT a || chr(9) || string_agg(b::VARCHAR, ',' ORDER BY b) || '|' || CASE WHEN a = (SELECT min(a) FROM u) THEN '0|GRAY' ELSE 'Integer.MAX|WHITE' END AS record FROM u GROUP BY a"


def _records(spark, d):
    edges = model.canonical(graph(spark, d, "sparse"))
    return model.adjacency(edges, _first(edges))


def _first(edges):
    return edges.agg(F.min(F.least("src", "dst")).alias("vertex"))


@_add("adjacency_records", ADJACENCY)
def adjacency_records(spark, d):
    return _records(spark, d).select(encode_adjacency().alias("record"))


@_add("adjacency_roundtrip", ADJACENCY)
def adjacency_roundtrip(spark, d):
    lines = _records(spark, d).select(encode_adjacency().alias("value"))
    return lines.select(*decode_adjacency(F.col("value"))).select(encode_adjacency().alias("record"))


def _labels(spark, d, name="sparse"):
    return cc.connected_components(graph(spark, d, name))


@_add("components", f"WITH {_c('sparse')}, {LABELS} SELECT node, component FROM c")
def components(spark, d):
    return _labels(spark, d)


@_add("components_orders", f"WITH {_c('orders')}, {LABELS} SELECT node, component FROM c")
def components_orders(spark, d):
    return _labels(spark, d, "orders")


@_add("component_members", f"WITH {_c('sparse')}, {LABELS} SELECT component, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM c GROUP BY component")
def component_members(spark, d):
    return grouping.component_members(_labels(spark, d)).select("component", F.array_join("members", ",").alias("members"))


@_add("component_edges", f"WITH {_c('sparse')}, {LABELS} SELECT component, src, dst FROM e JOIN c ON e.src = c.node")
def component_edges(spark, d):
    edges = model.canonical(graph(spark, d, "sparse"))
    return grouping.component_edges(edges, cc.connected_components(edges))


@_add("component_count", f"WITH {_c('orders')}, {LABELS} SELECT count(DISTINCT component) AS components FROM c")
def component_count(spark, d):
    return grouping.component_count(_labels(spark, d, "orders"))


@_add("msf_edges", f"WITH {_c('sparse')}, {FOREST} SELECT * FROM t")
def msf_edges(spark, d):
    return forest.spanning_forest(graph(spark, d, "sparse"))


@_add("msf_total_weight", f"WITH {_c('sparse')}, {FOREST} SELECT sum(weight)::BIGINT AS weight, count(*) AS edges FROM t")
def msf_total_weight(spark, d):
    return forest.spanning_forest(graph(spark, d, "sparse")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("edges"))


@_add("msf_full")
def msf_full(spark, d):
    return forest.spanning_forest(graph(spark, d, "full"))


def _bfs_sql(start: str) -> str:
    return f"WITH {_c('sparse')}, r(v, dist) AS (SELECT a, 0 FROM u WHERE {start} UNION SELECT u.b, r.dist + 1 FROM r JOIN u ON r.v = u.a WHERE r.dist < 40), h AS (SELECT v AS vertex, min(dist) AS distance FROM r GROUP BY v)"


ONE, MANY = "a = (SELECT min(a) FROM u)", "a % 97 = 1"


@_add("bfs_levels", f"{_bfs_sql(ONE)} SELECT vertex, distance FROM h")
def bfs_levels(spark, d):
    edges = graph(spark, d, "sparse")
    return search.bfs(edges, _first(edges))


@_add("bfs_frontier_sizes", f"{_bfs_sql(ONE)} SELECT distance, count(*) AS vertices FROM h GROUP BY distance")
def bfs_frontier_sizes(spark, d):
    return bfs_levels(spark, d).groupBy("distance").agg(F.count(F.lit(1)).alias("vertices"))


@_add("bfs_multi_source", f"{_bfs_sql(MANY)} SELECT vertex, distance FROM h")
def bfs_multi_source(spark, d):
    edges = graph(spark, d, "sparse")
    return search.bfs(edges, model.vertices(edges).where("vertex % 97 = 1"))


@_add("bfs_records", f"{_bfs_sql(ONE)} SELECT DISTINCT a AS id, distance, CASE WHEN distance IS NULL THEN 'WHITE' ELSE 'BLACK' END AS color FROM u LEFT JOIN h ON u.a = h.vertex")
def bfs_records(spark, d):
    return search.bfs_records(_records(spark, d)).select("id", "distance", "color")


@_add("maximal_matching", f"WITH {_c('sparse')}, {GREEDY} SELECT * FROM m")
def maximal_matching(spark, d):
    return matching.maximal_matching(graph(spark, d, "sparse"))


@_add("matched_vertex_filter", f"WITH {_c('sparse')}, {GREEDY}, b AS (SELECT src AS v FROM m WHERE weight % 2 = 0 UNION SELECT dst FROM m WHERE weight % 2 = 0) SELECT weight, src, dst FROM e WHERE src NOT IN (SELECT v FROM b) AND dst NOT IN (SELECT v FROM b)")
def matched_vertex_filter(spark, d):
    edges = model.canonical(graph(spark, d, "sparse"))
    return model.uncovered_edges(edges, model.vertices(matching.maximal_matching(edges).where("weight % 2 = 0")))


@_add("uncovered_edge_filter", f"WITH {_c('sparse')}, {GREEDY}, b AS (SELECT src AS v FROM m WHERE weight % 2 = 0 UNION SELECT dst FROM m WHERE weight % 2 = 0) SELECT weight, src, dst FROM e WHERE src NOT IN (SELECT v FROM b) OR dst NOT IN (SELECT v FROM b)")
def uncovered_edge_filter(spark, d):
    edges = model.canonical(graph(spark, d, "sparse"))
    return model.half_covered_edges(edges, model.vertices(matching.maximal_matching(edges).where("weight % 2 = 0")))


@_add("maximal_matching_filter_check", "SELECT true AS valid, true AS maximal")
def maximal_matching_filter_check(spark, d):
    edges = graph(spark, d, "full")
    return matching.check_matching(edges, matching.maximal_matching_by_filtering(edges, budget=20_000))


@_add("vertex_cover", f"WITH {_c('sparse')}, {GREEDY} SELECT src AS vertex FROM m UNION SELECT dst FROM m")
def vertex_cover(spark, d):
    return cover.vertex_cover(graph(spark, d, "sparse"))


@_add("edge_cover", f"WITH {_c('sparse')}, {GREEDY}, {TOPUP} SELECT * FROM m UNION ALL SELECT * FROM tu")
def edge_cover(spark, d):
    return cover.edge_cover(graph(spark, d, "sparse"))


@_add("edge_cover_topup", f"WITH {_c('sparse')}, {GREEDY}, {TOPUP} SELECT * FROM tu")
def edge_cover_topup(spark, d):
    edges = graph(spark, d, "sparse")
    return cover.cover_topup(edges, matching.maximal_matching(edges))


@_add("maximum_matching_size")
def maximum_matching_size(spark, d):
    return matching.maximum_matching(graph(spark, d, "sparse")).agg(F.count(F.lit(1)).alias("edges"))


@_add("vertex_cover_maximum_check", "SELECT true AS covers")
def vertex_cover_maximum_check(spark, d):
    edges = graph(spark, d, "sparse")
    return cover.check_vertex_cover(edges, cover.vertex_cover(edges, maximum=True))


@_add("edge_cover_maximum_size")
def edge_cover_maximum_size(spark, d):
    return cover.edge_cover(graph(spark, d, "sparse"), maximum=True).agg(F.count(F.lit(1)).alias("edges"))


@_add("edge_cover_maximum_check", "SELECT true AS covers, true AS least")
def edge_cover_maximum_check(spark, d):
    """An edge cover is least if it has as many edges as the vertices that a proven matching leaves and its own."""
    edges = materialize(graph(spark, d, "users"), "users")
    chosen = materialize(cover.edge_cover(edges, maximum=True), "cover")
    every, held = model.vertices(edges), model.vertices(chosen)
    left = every.join(held, "vertex", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    proof = matching.maximum_matching_proof(edges)
    n, size = every.agg(F.count(F.lit(1)).alias("n")), chosen.agg(F.count(F.lit(1)).alias("n"))
    return proof.select((left.scalar() == 0).alias("covers"), ((F.col("edges") == F.col("bound")) & (size.scalar() == n.scalar() - F.col("bound"))).alias("least"))


@_add("maximum_matching_check", "SELECT true AS valid, true AS maximal, true AS maximum")
def maximum_matching_check(spark, d):
    """Over users, whose graph is full of odd cycles: a matching, and the barrier that proves it the largest."""
    edges = materialize(graph(spark, d, "users"), "users")
    proof = matching.maximum_matching_proof(edges)
    held = matching.check_matching(edges, matching.maximum_matching(edges))
    return held.crossJoin(F.broadcast(proof)).select("valid", "maximal", (F.col("edges") == F.col("bound")).alias("maximum"))


@_add("msf_full_check", "SELECT true AS spans, true AS acyclic, true AS minimal")
def msf_full_check(spark, d):
    """A forest is the least one if below every weight it leaves as many components as the graph does."""
    edges = materialize(model.canonical(graph(spark, d, "full")), "edges")
    tree = materialize(forest.spanning_forest(edges), "tree")
    n = model.vertices(edges).count()
    cuts = edges.agg(F.percentile_approx("weight", [0.01, 0.1, 0.5, 1.0], 1000).alias("w")).first()["w"]  # four numbers
    merged = [n - _components_below(edges, w, n) for w in cuts]
    held = [tree.where(F.col("weight") <= w).count() for w in cuts]
    within = tree.join(edges, ["weight", "src", "dst"], "left_anti").count() == 0
    own = n - _components_below(tree, cuts[-1], n)
    return spark.range(1).select(F.lit(within and own == merged[-1]).alias("spans"), F.lit(tree.count() == own).alias("acyclic"), F.lit(held == merged).alias("minimal"))


def _components_below(edges, weight, n):
    """Components of all n vertices, joined by the edges up to a weight."""
    labels = cc.connected_components(edges.where(F.col("weight") <= weight)).agg(F.count(F.lit(1)).alias("v"), F.countDistinct("component").alias("c")).first()
    return n - labels["v"] + labels["c"]


@_add("edge_sample_check", "SELECT true AS within, true AS repeats, true AS expected")
def edge_sample_check(spark, d):
    """A sample holds edges of the graph, is the same on every run, and its size lies within six deviations."""
    edges = materialize(model.canonical(graph(spark, d, "full")), "edges")
    total, budget = edges.count(), 1_000
    one, two = (materialize(model.sample_edges(x, budget), "sample") for x in (edges, edges.repartition(3)))
    size, p = one.count(), min(1.0, budget / total)
    same = one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    return spark.range(1).select(F.lit(one.join(edges, edges.columns, "left_anti").isEmpty()).alias("within"), F.lit(same).alias("repeats"), F.lit(abs(size - total * p) <= 6 * (total * p * (1 - p)) ** 0.5).alias("expected"))


TEXT_ORDER = "weight::VARCHAR || chr(9) || src::VARCHAR"
INPUT_ORDER = "(src * 7919 + dst * 104729) % 1000003"


def _greedy_by(order: str) -> str:
    return f"WITH RECURSIVE raw AS ({graph_sql('sparse')}), k AS (SELECT weight, least(src, dst) AS src, greatest(src, dst) AS dst, row_number() OVER (ORDER BY {order}, least(src, dst), greatest(src, dst)) AS i FROM raw), {GREEDY} SELECT * FROM m"


@_add("maximal_matching_text_order", _greedy_by(TEXT_ORDER))
def maximal_matching_text_order(spark, d):
    return matching.maximal_matching(graph(spark, d, "sparse"), order="text")


@_add("maximal_matching_input_order", _greedy_by(INPUT_ORDER))
def maximal_matching_input_order(spark, d):
    edges = graph(spark, d, "sparse").withColumn("line", F.expr(INPUT_ORDER))
    return matching.maximal_matching(edges, order="line")


# The distributed rounds to their end, with no budget for one task, under the same SQL.
@_add("components_rounds", f"WITH {_c('sparse')}, {LABELS} SELECT node, component FROM c")
def components_rounds(spark, d):
    return cc.connected_components(graph(spark, d, "sparse"), budget=0)


@_add("msf_rounds", f"WITH {_c('sparse')}, {FOREST} SELECT * FROM t")
def msf_rounds(spark, d):
    return forest.spanning_forest(graph(spark, d, "sparse"), budget=0)


@_add("matching_rounds", f"WITH {_c('sparse')}, {GREEDY} SELECT * FROM m")
def matching_rounds(spark, d):
    return matching.maximal_matching(graph(spark, d, "sparse"), budget=0)


@_add("bfs_rounds", f"{_bfs_sql(ONE)} SELECT vertex, distance FROM h")
def bfs_rounds(spark, d):
    edges = graph(spark, d, "sparse")
    return search.bfs(edges, _first(edges), budget=0)


RESUMED = f"WITH {_c('sparse')}, r(v, dist) AS (SELECT a, (a % 5)::INT FROM u WHERE {MANY} UNION SELECT u.b, r.dist + 1 FROM r JOIN u ON r.v = u.a WHERE r.dist < 40), h AS (SELECT v, min(dist) AS distance FROM r GROUP BY v) SELECT DISTINCT a AS id, distance, CASE WHEN distance IS NULL THEN 'WHITE' ELSE 'BLACK' END AS color FROM u LEFT JOIN h ON u.a = h.v"


def _resumed(spark, d, budget):
    records = model.adjacency(model.canonical(graph(spark, d, "sparse")))
    gray = F.col("id") % 97 == 1
    records = records.withColumns({"distance": F.when(gray, F.col("id") % 5).cast("int"), "color": F.when(gray, "GRAY").otherwise("WHITE")})
    return search.bfs_records(records, budget).select("id", "distance", "color")


@_add("bfs_records_resumed", RESUMED)
def bfs_records_resumed(spark, d):
    """Sources that already have distances of their own."""
    return _resumed(spark, d, search.BUDGET)


@_add("bfs_records_resumed_rounds", RESUMED)
def bfs_records_resumed_rounds(spark, d):
    return _resumed(spark, d, 0)


SWEEP = [1, 2, 4, 8, 16, 32, 64]


def _bits_sql(values: str, ks: list[int]) -> str:
    return (
        f"WITH h AS (SELECT ({A}::BIGINT * (v % {Q}) + {B}) % {Q} AS h, k FROM ({values}), (SELECT unnest({ks})::BIGINT AS k)), t AS (SELECT k, h % k AS bucket, h // k AS t FROM h), "
        "bm AS (SELECT k, bucket, bit_or(CASE WHEN t = 0 THEN 1 ELSE t & -t END)::BIGINT AS bm FROM t GROUP BY k, bucket), b AS (SELECT *, bit_count((~bm & (bm + 1)) - 1)::BIGINT AS r FROM bm)"
    )


def _estimate_sql(k: str, s: str) -> str:
    return f"floor({k} / {PHI}::DOUBLE * pow(2.0, {s} / {k}))::BIGINT"


def _column(spark, d, column):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col(column).alias("value"))


PARTKEYS, ORDERKEYS = "SELECT l_partkey AS v FROM lineitem", "SELECT l_orderkey AS v FROM lineitem"


@_add("pcsa_distinct", f"{_bits_sql(ORDERKEYS, [64])} SELECT k, {_estimate_sql('k', 'sum(r)')} AS estimate FROM b GROUP BY k")
def pcsa_distinct(spark, d):
    return sketch.approx_distinct(_column(spark, d, "l_orderkey"), [64])


@_add("pcsa_sweep", f"{_bits_sql(PARTKEYS, SWEEP)} SELECT k, {_estimate_sql('k', 'sum(r)')} AS estimate FROM b GROUP BY k")
def pcsa_sweep(spark, d):
    return sketch.approx_distinct(_column(spark, d, "l_partkey"), SWEEP)


@_add("pcsa_buckets", f"{_bits_sql(PARTKEYS, [16])} SELECT k, bucket, bm, r FROM b")
def pcsa_buckets(spark, d):
    return sketch.pcsa_buckets(_column(spark, d, "l_partkey"), [16])


REACH_KS = [1, 4, 16, 64]


def _reach_sql(ks: list[int]) -> str:
    return (
        f"WITH RECURSIVE e AS ({graph_sql('directed')}), r(u, v) AS (SELECT src, src FROM e UNION SELECT r.u, e.dst FROM r JOIN e ON r.v = e.src), "
        f"h AS (SELECT u, k, ({A}::BIGINT * (v % {Q}) + {B}) % {Q} AS h FROM r, (SELECT unnest({ks})::BIGINT AS k)), t AS (SELECT u, k, h % k AS bucket, h // k AS t FROM h), "
        f"bm AS (SELECT u, k, bucket, bit_or(CASE WHEN t = 0 THEN 0 ELSE least(t & -t, {1 << TOP_BIT}) END)::BIGINT AS bm FROM t GROUP BY u, k, bucket), "
        f"s AS (SELECT u AS node, k, {_estimate_sql('k', 'sum(bit_count((~bm & (bm + 1)) - 1)::BIGINT)')} AS estimate FROM bm GROUP BY u, k)"
    )


FOLD = f"list_reduce(list_prepend(0::BIGINT, list(estimate ORDER BY node)), lambda c, x: ({A}::BIGINT * ((c + x) % {Q}) + {B}) % {Q})"


@_add("reach_bitmaps", f"{_reach_sql([16])} SELECT u AS node, bucket, bm FROM bm")
def reach_bitmaps(spark, d):
    return sketch.reach_bitmaps(graph(spark, d, "directed"), 16)


@_add("reach_estimates", f"{_reach_sql([16])} SELECT node, estimate FROM s")
def reach_estimates(spark, d):
    return sketch.estimate_reachable(graph(spark, d, "directed"), 16)


@_add("reach_summary", f"{_reach_sql(REACH_KS)} SELECT k, count(*) AS nodes, min(estimate) AS least, max(estimate) AS most, round(avg(estimate))::BIGINT AS mean, {FOLD} AS checksum FROM s GROUP BY k")
def reach_summary(spark, d):
    return sketch.reach_summary(graph(spark, d, "directed"), REACH_KS)


@_add("reach_checksum", f"{_reach_sql([16])} SELECT {FOLD} AS checksum FROM s")
def reach_checksum(spark, d):
    return sketch.ordered_checksum(sketch.estimate_reachable(graph(spark, d, "directed"), 16))


@_add("reach_rounds", f"{_reach_sql([16])} SELECT node, estimate FROM s")
def reach_rounds(spark, d):
    return sketch.estimate_reachable(graph(spark, d, "directed"), 16, budget=0)


@_add("run_statistics", "SELECT * FROM (VALUES ('bfs', true), ('connected_components', true), ('maximal_matching', true), ('maximum_matching', true), ('reach_bitmaps', true), ('spanning_forest', true)) t(operator, complete)")
def run_statistics(spark, d):
    """Whether each operator's statistics number its rounds from 1 and tell the edges that each began with."""
    rows: list = []
    edges = materialize(graph(spark, d, "sparse"), "edges")
    cc.connected_components(edges, budget=0, stats=rows).count()
    forest.spanning_forest(edges, budget=0, stats=rows).count()
    cover.vertex_cover(edges, stats=rows).count()
    matching.maximal_matching(edges, budget=0, stats=rows).count()
    cover.edge_cover(edges, maximum=True, stats=rows).count()
    search.bfs(edges, _first(edges), stats=rows).count()
    sketch.estimate_reachable(graph(spark, d, "directed"), 16, budget=0, stats=rows).count()
    told = stats_frame(spark, rows).groupBy("operator")
    return told.agg(((F.min("round") == 1) & (F.max("round") == F.countDistinct("round")) & (F.min("input_edges") >= 0) & (F.max("input_edges") > 0)).alias("complete"))


# Sources and sinks: what is written in the scratch folder and read again.
@_add("scan_weighted_edges", f"WITH {_c('full')} SELECT weight, src, dst FROM e")
def scan_weighted_edges(spark, d):
    path = scratch_path(spark, "edges")
    text.write_edges(model.canonical(graph(spark, d, "full")), path)
    return text.read_weighted_edges(spark, path, "bigint")


@_add("scan_whole_weights", "SELECT floor(l_extendedprice)::BIGINT AS weight, l_orderkey AS src, l_partkey AS dst FROM lineitem")
def scan_whole_weights(spark, d):
    path = scratch_path(spark, "whole")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").alias("weight"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    text.write_edges(lines, path, whole_weights=True)
    return text.read_weighted_edges(spark, path, "bigint")


@_add("scan_directed_edges", graph_sql("directed"))
def scan_directed_edges(spark, d):
    path = scratch_path(spark, "arcs")
    text.write_lines(graph(spark, d, "directed"), path, "src", "dst", separator=" ")
    return text.read_directed_edges(spark, path)


@_add("scan_adjacency", f"{_bfs_sql(ONE).split(', r(v, dist)')[0]} SELECT a AS id, string_agg(b::VARCHAR, ',' ORDER BY b) AS edges, CASE WHEN a = (SELECT min(a) FROM u) THEN 0 END AS distance, CASE WHEN a = (SELECT min(a) FROM u) THEN 'GRAY' ELSE 'WHITE' END AS color FROM u GROUP BY a")
def scan_adjacency(spark, d):
    path = scratch_path(spark, "adjacency")
    text.write_adjacency(_records(spark, d), path)
    return text.read_adjacency(spark, path).withColumn("edges", F.array_join("edges", ","))


@_add("scan_integers", "SELECT l_partkey AS value, count(*) AS lines FROM lineitem GROUP BY l_partkey")
def scan_integers(spark, d):
    path = scratch_path(spark, "integers")
    text.write_lines(_column(spark, d, "l_partkey"), path)
    return text.read_integers(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


@_add("scan_lenient", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT END AS value FROM nation")
def scan_lenient(spark, d):
    """Every other line is no number, and null where that is allowed."""
    path = scratch_path(spark, "lenient")
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.col("n_name")).alias("value"))
    text.write_lines(lines, path)
    return text.read_integers(spark, path, lenient=True)


@_add("dump_sequence_file", 'SELECT n_nationkey::BIGINT AS "key", n_name AS value FROM nation')
def dump_sequence_file(spark, d):
    path = scratch_path(spark, "sequence")
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").collect()  # a table of 25 rows
    spark.sparkContext.parallelize([tuple(r) for r in rows], 2).saveAsSequenceFile(path)
    return text.read_sequence_file(spark, path)


@_add("dump_members", f"WITH {_c('sparse')}, {LABELS} SELECT component || chr(9) || '[' || string_agg(node::VARCHAR, ', ' ORDER BY node) || ']' AS value FROM c GROUP BY component")
def dump_members(spark, d):
    path = scratch_path(spark, "members")
    text.write_members(grouping.component_members(_labels(spark, d)), path)
    return text.read_lines(spark, path)


@_add("dump_vertex_set", f"WITH {_c('sparse')}, {GREEDY} SELECT src AS value FROM m UNION SELECT dst FROM m")
def dump_vertex_set(spark, d):
    path = scratch_path(spark, "vertices")
    text.write_lines(cover.vertex_cover(graph(spark, d, "sparse")), path)
    return text.read_integers(spark, path)


@_add("merged_parts", f"WITH {_c('full')} SELECT 1::BIGINT AS files, count(*) AS edges FROM e")
def merged_parts(spark, d):
    path = scratch_path(spark, "merged")
    text.write_edges(model.canonical(graph(spark, d, "full")), path, single_file=True)
    found = len(files.list_files(spark, f"{path}/part-*"))
    return text.read_weighted_edges(spark, path).agg(F.lit(found).cast("long").alias("files"), F.count(F.lit(1)).alias("edges"))


@_add("each_input_totals", " UNION ALL ".join(f"SELECT '{n}' AS input, count(*) AS edges, sum(weight)::BIGINT AS weight FROM ({graph_sql(n)})" for n in ("sparse", "orders")))
def each_input_totals(spark, d):
    paths = {scratch_path(spark, n): n for n in ("sparse", "orders")}
    for path, n in paths.items():
        text.write_edges(graph(spark, d, n), path)
    totals = text.each_input(list(paths), lambda p: text.read_weighted_edges(spark, p, "bigint").agg(F.lit(paths[p]).alias("input"), F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")))
    one, two = totals.values()
    return one.unionByName(two)


@_add("files_round_trip", "SELECT true AS copied, true AS told, 1::BIGINT AS listed, true AS deleted, true AS gone, true AS home")
def files_round_trip(spark, d):
    """A local file copied in with progress, listed by pattern and deleted."""
    folder, told = scratch_path(spark, "files"), []
    files.copy_from_local(spark, __file__, f"{folder}/copy.txt", lambda name, done: told.append(done), piece=4096)
    size = spark.read.format("binaryFile").load(f"{folder}/copy.txt").first()["length"]
    listed = len(files.list_files(spark, f"{folder}/*.txt"))
    deleted = files.delete(spark, folder)
    flags = {"copied": told[-1] == size, "told": len(told) > 1 and told == sorted(told), "listed": listed, "deleted": deleted, "gone": not files.list_files(spark, f"{folder}/*"), "home": bool(files.user_name(spark))}
    return spark.range(1).select(*[F.lit(v).cast("long" if k == "listed" else "boolean").alias(k) for k, v in flags.items()])


@_add("edge_sample_hash")
def edge_sample_hash(spark, d):
    edges = model.canonical(graph(spark, d, "full"))
    return model.sample_edges(edges, 10_000)


def _even_ends(edges):
    return model.vertices(matching.maximal_matching(edges).where("weight % 2 = 0"))


def _searched(edges):
    simple = model.canonical(edges)
    return search.bfs_records(model.adjacency(simple, _first(simple))).select("id", "distance", "color")


def _size(found):
    return found.agg(F.count(F.lit(1)).alias("edges"))


#: The operators over all rows of lineitem and orders; recursion in SQL is too slow for these.
ROWS = {
    "components": cc.connected_components,
    "component_members": lambda e: grouping.component_members(cc.connected_components(e)).select("component", F.array_join("members", ",").alias("members")),
    "component_edges": lambda e: grouping.component_edges(model.canonical(e), cc.connected_components(e)),
    "component_count": lambda e: grouping.component_count(cc.connected_components(e)),
    "msf_edges": forest.spanning_forest,
    "msf_total_weight": lambda e: forest.spanning_forest(e).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("edges")),
    "bfs_levels": lambda e: search.bfs(e, _first(e)),
    "bfs_frontier_sizes": lambda e: search.bfs(e, _first(e)).groupBy("distance").agg(F.count(F.lit(1)).alias("vertices")),
    "bfs_multi_source": lambda e: search.bfs(e, model.vertices(e).where("vertex % 97 = 1")),
    "bfs_records": _searched,
    "maximal_matching": matching.maximal_matching,
    "matched_vertex_filter": lambda e: model.uncovered_edges(model.canonical(e), _even_ends(e)),
    "uncovered_edge_filter": lambda e: model.half_covered_edges(model.canonical(e), _even_ends(e)),
    "vertex_cover": cover.vertex_cover,
    "edge_cover": cover.edge_cover,
    "edge_cover_topup": lambda e: cover.cover_topup(e, matching.maximal_matching(e)),
    "reach_bitmaps": lambda e: sketch.reach_bitmaps(e, 16),
    "reach_estimates": lambda e: sketch.estimate_reachable(e, 16),
    "reach_summary": lambda e: sketch.reach_summary(e, REACH_KS),
    "reach_checksum": lambda e: sketch.ordered_checksum(sketch.estimate_reachable(e, 16)),
}
for _name, _f in ROWS.items():
    QUERIES[f"{_name}_rows"] = lambda spark, d, f=_f: f(graph(spark, d, "rows"))

#: One blossom search a component, whose vertices must fit a worker: over all lineitem rows, without the orders.
FULL = {
    "maximum_matching_size": lambda e: _size(matching.maximum_matching(e)),
    "edge_cover_maximum_size": lambda e: _size(cover.edge_cover(e, maximum=True)),
    "vertex_cover_maximum_check": lambda e: cover.check_vertex_cover(e, cover.vertex_cover(e, maximum=True)),
}
for _name, _f in FULL.items():
    QUERIES[f"{_name}_full"] = lambda spark, d, f=_f: f(graph(spark, d, "full"))
