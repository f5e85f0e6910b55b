"""Operators over all rows of the tables against brute force."""

import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from loomgraph.operators.model import canonical
from loomgraph.plans.fixtures import graph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def run(spark, name):
    return sorted(map(tuple, entry.queries()[name](spark, DATA).collect()))


def test_whole_tables_match_brute_force(spark):
    arcs = graph(spark, DATA, "rows")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
    pairs = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()
    assert arcs.count() == lines + pairs + spark.read.parquet(f"{DATA}/orders.parquet").count()
    edges = sorted(map(tuple, canonical(arcs).select("weight", "src", "dst").collect()))
    near, parent, used = defaultdict(set), {}, set()
    for _, a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    tree, greedy = [], []
    for e in edges:
        a, b = root(e[1]), root(e[2])
        if a != b:
            parent[max(a, b)] = min(a, b)
            tree.append(e)
        if not {e[1], e[2]} & used:
            used |= {e[1], e[2]}
            greedy.append(e)
    assert run(spark, "components_rows") == sorted((x, root(x)) for x in near)
    assert run(spark, "msf_edges_rows") == sorted(tree)
    assert run(spark, "maximal_matching_rows") == sorted(greedy)
    assert run(spark, "vertex_cover_rows") == sorted((x,) for x in used)
    level, depth, seen = {min(near)}, 0, {}
    while level:
        seen |= dict.fromkeys(level, depth)
        level, depth = {y for x in level for y in near[x]} - set(seen), depth + 1
    assert run(spark, "bfs_levels_rows") == sorted(seen.items())


def test_maximum_matching_of_all_lineitem_rows(spark):
    near = defaultdict(list)
    for r in graph(spark, DATA, "full").collect():
        near[r["src"]].append(r["dst"])
    mate = {}

    def grow(x, seen):
        for y in near[x]:
            if y not in seen:
                seen.add(y)
                if y not in mate or grow(mate[y], seen):
                    mate[y] = x
                    return True
        return False

    size = sum(grow(x, set()) for x in near)
    assert run(spark, "maximum_matching_size_full") == [(size,)]
