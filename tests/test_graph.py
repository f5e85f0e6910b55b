"""Graph operators on small graphs: the one-task finish and the distributed rounds agree with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import bfs, components, cover, forest, matching, model, sketch
from loomgraph.operators.stats import stats_frame

GRAPHS = {
    "empty": [],
    "single": [(1, 1, 2)],
    "self_loop": [(1, 1, 1), (2, 1, 2), (3, 9, 9)],
    "parallel": [(5, 1, 2), (3, 2, 1)],
    "path4": [(2, 1, 2), (1, 2, 3), (2, 3, 4)],
    "star_with_zero": [(i, 0, i) for i in range(1, 6)],
    "two_parts": [(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 7, 8)],
}
rng = random.Random(4)
GRAPHS["random"] = [(rng.randrange(40), rng.randrange(60), rng.randrange(60)) for _ in range(70)]
GRAPHS["long_path"] = [(1, i, i + 1) for i in range(40)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "weight long, src long, dst long").repartition(3)


def simple(rows):
    least = {}
    for w, a, b in rows:
        if a != b:
            e = (min(a, b), max(a, b))
            least[e] = min(w, least.get(e, w))
    return sorted((w, a, b) for (a, b), w in least.items())


def labels(rows):
    label = {x: x for _, a, b in rows for x in (a, b)}
    changed = True
    while changed:
        changed = False
        for _, a, b in rows:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def greedy(rows):
    used, out = set(), []
    for w, a, b in simple(rows):
        if not {a, b} & used:
            used |= {a, b}
            out.append((w, a, b))
    return out


def kruskal(rows):
    out = []
    for e in simple(rows):
        label = labels([*out, (0, e[1], e[1]), (0, e[2], e[2])])
        if label[e[1]] != label[e[2]]:
            out.append(e)
    return sorted(out)


def tuples(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("budget", [0, 1000])
def test_components(spark, name, budget):
    rows = GRAPHS[name]
    assert tuples(components.connected_components(frame(spark, rows), budget)) == sorted(labels(rows).items())


@pytest.mark.parametrize("name", ["self_loop", "parallel", "two_parts", "random", "long_path"])
@pytest.mark.parametrize("budget", [0, 1000])
def test_forest_and_matching(spark, name, budget):
    rows = GRAPHS[name]
    assert tuples(forest.spanning_forest(frame(spark, rows), budget)) == kruskal(rows)
    assert tuples(matching.maximal_matching(frame(spark, rows), budget)) == sorted(greedy(rows))


@pytest.mark.parametrize("name", ["empty", "star_with_zero", "two_parts", "random"])
def test_covers_and_filtering(spark, name):
    rows, df = GRAPHS[name], frame(spark, GRAPHS[name])
    assert tuple(cover.check_vertex_cover(df, cover.vertex_cover(df)).first()) == (True,)
    chosen = cover.edge_cover(df).collect()
    assert {x for _, a, b in chosen for x in (a, b)} == {x for _, a, b in simple(rows) for x in (a, b)}
    stats = []
    found = matching.maximal_matching_by_filtering(df, budget=20, stats=stats)
    assert tuple(matching.check_matching(df, found).first()) == (True, True)
    assert stats and stats[-1].input_edges <= 20 and stats[-1].remaining == 0
    assert stats_frame(spark, stats).count() == len(stats)


def test_matching_orders(spark):
    rows = [(10, 1, 2, 3), (9, 2, 3, 2), (100, 3, 4, 1), (9, 5, 6, 4)]
    df = spark.createDataFrame(rows, "weight long, src long, dst long, line long")
    assert {e[1:] for e in tuples(matching.maximal_matching(df))} == {(2, 3), (5, 6)}
    for budget in (0, 100):  # as text, "10" and "100" come before "9"
        assert {e[1:] for e in tuples(matching.maximal_matching(df, budget, order="text"))} == {(1, 2), (3, 4), (5, 6)}
        assert {e[1:] for e in tuples(matching.maximal_matching(df, budget, order="line"))} == {(3, 4), (1, 2), (5, 6)}


def test_graph_lookups(spark):
    df = frame(spark, GRAPHS["two_parts"])
    assert tuples(model.edges_from(df, 2)) == [(1,), (3,)]
    assert model.has_edge(df, 8, 7) and not model.has_edge(df, 1, 8)
    assert model.remaining(df, 2, 1).count() == 3


def test_edge_cover_of_a_star_needs_all_edges(spark):
    assert cover.edge_cover(frame(spark, GRAPHS["star_with_zero"])).count() == 5


def test_maximum_matching_is_never_smaller(spark):
    df = frame(spark, GRAPHS["random"])
    best = matching.maximum_matching(df)
    assert best.count() >= len(greedy(GRAPHS["random"]))
    assert tuple(matching.check_matching(df, best).first()) == (True, True)
    with pytest.raises(ValueError):
        matching.maximum_matching(df, most=3)


def test_path_of_four(spark):
    df = frame(spark, GRAPHS["path4"])
    assert matching.maximal_matching(df).count() == 1
    assert matching.maximum_matching(df).count() == 2


@pytest.mark.parametrize("budget", [0, 1000])
def test_bfs(spark, budget):
    df = frame(spark, GRAPHS["long_path"][:9] + GRAPHS["two_parts"][3:])
    sources = spark.createDataFrame([(0,), (4,), (4,)], "vertex long")
    got = dict(tuples(bfs.bfs(df, sources, budget=budget)))
    assert got == {i: min(i, abs(i - 4)) for i in range(10)}
    assert dict(tuples(bfs.bfs(df, sources.where("vertex = 4"), directed=True, budget=budget))) == {i: i - 4 for i in range(4, 10)}


@pytest.mark.parametrize("budget", [0, 1000])
@pytest.mark.parametrize("directed", [False, True])
def test_bfs_from_distances_of_their_own(spark, budget, directed):
    arcs = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)]
    starts = [(0, 3), (20, 0), (9, 6), (100, 50), (0, 7), (200, None)]
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        if not directed:
            near.setdefault(b, set()).add(a)
    want = {}
    for v, d in starts:
        level, d = {v}, d or 0
        seen = set()
        while level:
            for x in level:
                want[x] = min(want.get(x, 999), d)
            seen |= level
            level, d = {y for x in level for y in near.get(x, ())} - seen, d + 1
    edges, sources = spark.createDataFrame(arcs, "src long, dst long"), spark.createDataFrame(starts, "vertex long, distance int")
    assert dict(tuples(bfs.bfs(edges, sources, directed=directed, budget=budget))) == want


@pytest.mark.parametrize("budget", [0, 1000])
def test_bfs_records_go_on_from_their_distance(spark, budget):
    rows = [(1, [2], 3, "GRAY"), (2, [3], None, "WHITE"), (4, [5], 1, "BLACK"), (6, [4, 2], None, "GRAY"), (5, [], None, "WHITE")]
    df = spark.createDataFrame(rows, "id long, edges array<long>, distance int, color string")
    got = {r["id"]: (r["distance"], r["color"]) for r in bfs.bfs_records(df, budget).collect()}
    assert got == {1: (3, "BLACK"), 2: (1, "BLACK"), 3: (2, "BLACK"), 4: (1, "BLACK"), 5: (None, "WHITE"), 6: (None, "BLACK")} | {6: (0, "BLACK")}


def test_bfs_records(spark):
    rows = [(1, [2, 3], 0, "GRAY"), (2, [], None, "WHITE"), (5, [1], None, "WHITE"), (6, [7], 0, "GRAY")]
    df = spark.createDataFrame(rows, "id long, edges array<long>, distance int, color string")
    got = {r["id"]: (r["distance"], r["color"]) for r in bfs.bfs_records(df).collect()}
    assert got == {1: (0, "BLACK"), 2: (1, "BLACK"), 3: (1, "BLACK"), 5: (None, "WHITE"), 6: (0, "BLACK"), 7: (1, "BLACK")}


def test_filters_union_sample(spark):
    df = model.canonical(frame(spark, GRAPHS["random"]))
    covered = spark.createDataFrame([(1,), (2,), (3,)], "vertex long")
    rows = simple(GRAPHS["random"])
    assert tuples(model.uncovered_edges(df, covered)) == [e for e in rows if not {e[1], e[2]} & {1, 2, 3}]
    assert tuples(model.half_covered_edges(df, covered)) == [e for e in rows if not {e[1], e[2]} <= {1, 2, 3}]
    assert tuples(model.graph_union(df, df.withColumn("weight", F.col("weight") + 1))) == rows
    assert model.sample_edges(df, 10_000).count() == len(rows)
    assert tuples(model.sample_edges(df, 20)) == tuples(model.sample_edges(df.repartition(7), 20))


H = lambda v: (1073741827 * v + 17179869209) % 4294967291


def low_zero(bm):
    r = 0
    while bm >> r & 1:
        r += 1
    return r


def test_distinct_estimates(spark):
    values = [0, 0, 3, 17, 17, 9999, 123456, None]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    got = dict(tuples(sketch.approx_distinct(df, [1, 4, 64])))
    for k in (1, 4, 64):
        maps = {}
        for v in {v for v in values if v is not None}:
            t = H(v) // k
            maps[H(v) % k] = maps.get(H(v) % k, 0) | (1 if t == 0 else t & -t)
        assert got[k] == int(k / 0.77351 * 2 ** (sum(map(low_zero, maps.values())) / k))


def test_zero_tail_conventions(spark):
    zero = spark.createDataFrame([(0,)], "value long")
    assert H(0) == 45  # with 64 buckets the tail of value 0 is 0: it sets bit 0 in the distinct count ...
    assert sketch.pcsa_buckets(zero, [64]).select("bucket", "bm").first() == (45, 1)
    arcs = spark.createDataFrame([(0, 0)], "src long, dst long")
    assert tuples(sketch.reach_bitmaps(arcs, 64)) == [(0, 45, 0)]  # ... and no bit in the reachability sketch


@pytest.mark.parametrize("budget", [0, 1000])
def test_reachability(spark, budget):
    rng = random.Random(8)
    arcs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    df = spark.createDataFrame(arcs, "src long, dst long")
    reach = {}
    for s in {a for a, _ in arcs}:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in arcs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    want = []
    for s, seen in reach.items():
        maps = {}
        for v in seen:
            t = H(v) // 4
            maps[H(v) % 4] = maps.get(H(v) % 4, 0) | (0 if t == 0 else min(t & -t, 1 << 30))
        want += [(s, b, bm) for b, bm in maps.items()]
    assert tuples(sketch.reach_bitmaps(df, 4, budget=budget)) == sorted(want)
    est = sketch.estimate_reachable(df, 4, budget=budget)
    c = 0
    for _, e in tuples(est):
        c = H(c + e)
    assert sketch.ordered_checksum(est).first()[0] == c
    rounds = []
    sketch.reach_bitmaps(df, 4, stop="estimate", rounds=rounds).count()
    assert rounds[-1][1] == 0


def test_one_search_tells_all_numbers_of_buckets(spark):
    """Also of nodes whose hash has no bits beyond the bucket, of cycles and of repeated and null arcs."""
    rng, ks = random.Random(5), [1, 64, 4, 16, 2]
    odd = [(h - sketch.B) * pow(sketch.A, -1, sketch.Q) % sketch.Q for h in (0, 1, 2, 4, 6, 16, 32, 48, 63, 64, 128, 1 << 31)]
    assert [H(v) for v in odd] == [0, 1, 2, 4, 6, 16, 32, 48, 63, 64, 128, 1 << 31]
    for nodes, n in ((odd, 8), (odd + list(range(40)), 60), (list(range(300)), 330)):
        arcs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(n)]
        df = spark.createDataFrame(arcs + arcs[:3] + [(None, 1), (1, None)], "src long, dst long")
        reach = {a: {a} for a, _ in arcs}
        for _ in range(len(arcs)):
            for a, b in arcs:
                reach[a] |= reach.get(b, {b})
        stats = []
        got = tuples(sketch.reach_summary(df, ks, budget=0, stats=stats))
        assert [r.round for r in stats] == list(range(1, len(stats) + 1)) and stats[-1].remaining == 0
        assert got == tuples(sketch.reach_summary(df, ks, budget=1000))
        for k, count, least, most, *_ in got:
            est = []
            for seen in reach.values():
                maps = dict.fromkeys(range(k), 0)
                for v in seen:
                    t = H(v) // k
                    maps[H(v) % k] |= 0 if t == 0 else min(t & -t, 1 << 30)
                est.append(int(k / 0.77351 * 2.0 ** (sum((~bm & (bm + 1)).bit_length() - 1 for bm in maps.values()) / k)))
            assert (count, least, most) == (len(reach), min(est), max(est))


def test_masks_meet_without_a_broadcast(spark, monkeypatch):
    """Files of masks are small for the nodes they hold, so the planner would send all nodes to the driver."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    kind = type(spark.range(1))
    written, count = sketch.materialize, kind.count
    monkeypatch.setattr(sketch, "materialize", lambda df, tag="t": (plan(df), written(df, tag))[1])
    monkeypatch.setattr(kind, "count", lambda df: (plan(df), count(df))[1])
    arcs = spark.createDataFrame([(a, a + 1) for a in range(200) if a % 4 < 3], "src long, dst long")
    got = sketch._all_estimates(written(arcs, "arcs"), [4, 64])
    assert count(got) == 150
    assert sum("Join" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
