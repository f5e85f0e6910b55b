"""The blossom kernel against brute force on small random graphs."""

import random

import pytest

from loomgraph.operators.blossom import maximum_pairs


def best(edges):
    """Size of the largest matching, trying every choice."""
    edges = [e for e in dict.fromkeys(edges) if e[0] != e[1]]
    if not edges:
        return 0
    (u, v), rest = edges[0], edges[1:]
    return max(best(rest), 1 + best([e for e in rest if not {u, v} & set(e)]))


FIXED = {
    "empty": ([], 0),
    "single": ([(1, 2)], 1),
    "self_loop": ([(1, 1), (1, 2)], 1),
    "path4": ([(1, 2), (2, 3), (3, 4)], 2),
    "triangle": ([(1, 2), (2, 3), (1, 3)], 1),
    "flower": ([(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (1, 6)], 3),
    "star": ([(0, i) for i in range(1, 6)], 1),
    "k4": ([(a, b) for a in range(4) for b in range(a)], 2),
    "two_parts": ([(1, 2), (2, 3), (1, 3), (7, 8)], 2),
}


@pytest.mark.parametrize("name", FIXED)
def test_fixed(name):
    edges, size = FIXED[name]
    assert len(maximum_pairs(edges)[0]) == size


def test_random_graphs():
    rng = random.Random(11)
    for _ in range(400):
        n = rng.randrange(2, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 14))]
        got, barrier = maximum_pairs(edges)
        ends = [x for e in {tuple(sorted(e)) for e in got} for x in e]
        assert len(ends) == len(set(ends)) and all(e in edges for e in got)
        assert len(ends) // 2 == best([tuple(sorted(e)) for e in edges]), edges
        assert len(ends) // 2 == bound(edges, set(barrier)), edges


def bound(edges, barrier):
    """(vertices + barrier - odd components without it) / 2."""
    names = {x for e in edges for x in e}
    left, odd = names - barrier, 0
    while left:
        part, more = set(), {left.pop()}
        while more:
            part |= more
            more = {y for e in edges for x, y in (e, e[::-1]) if x in more} - part - barrier
        left -= part
        odd += len(part) % 2
    return (len(names) + len(barrier) - odd) // 2


def test_larger_graphs_of_odd_cycles_are_proven():
    rng = random.Random(5)
    for _ in range(20):
        edges = [(a, (a + rng.choice([1, 2, 3, 40])) % 150) for a in range(150) for _ in range(2) if rng.random() < 0.6]
        pairs, barrier = maximum_pairs(edges)
        assert len({frozenset(e) for e in pairs}) == bound(edges, set(barrier))


def test_cost_follows_the_tree():
    """Many separate paths: a search touches its own only."""
    import time

    edges = [(3 * i + j, 3 * i + j + 1) for i in range(60_000) for j in range(2)]
    began = time.time()
    assert len(maximum_pairs(edges)[0]) == 60_000
    assert time.time() - began < 20


@pytest.mark.parametrize("kind", ["odd", "sparse", "bipartite"])
def test_components_of_more_edges_than_one_task_takes(spark, kind):
    """All edges count, though a worker gets a core of them only."""
    from loomgraph.operators import matching

    rng = random.Random(kind)
    if kind == "odd":
        edges = {(a, (a + s) % 151) for a in range(151) for s in range(1, 12)}
    elif kind == "sparse":  # cliques of odd size around few hubs: the barrier isn't empty
        edges = {(1000 + 7 * i + a, 1000 + 7 * i + b) for i in range(40) for a in range(7) for b in range(a)}
        edges |= {(h, 1000 + rng.randrange(280)) for h in range(12) for _ in range(60)}
    else:
        edges = {(2 * rng.randrange(300) + 1, 2 * rng.randrange(40) + 2) for _ in range(3000)}
    edges = sorted(edges)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "weight long, src long, dst long")
    most = len(edges) - 100
    size = len(maximum_pairs(edges)[0])
    got = matching.maximum_matching(df, most=most)
    assert tuple(matching.check_matching(df, got).first()) == (True, True) and got.count() == size
    assert tuple(matching.maximum_matching_proof(df, most=most).first()) == (size, size)


def test_cores_follow_the_hubs(spark):
    """Not the many vertices around them, so that a core fits though an edge of each vertex would not."""
    from loomgraph.operators import matching

    rng = random.Random("hubs")
    edges = sorted({(2 * rng.randrange(400) + 1, 2 * rng.randrange(30) + 2) for _ in range(3000)})
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "weight long, src long, dst long")
    got = matching.maximum_matching(df, most=200)
    assert tuple(matching.check_matching(df, got).first()) == (True, True) and got.count() == len(maximum_pairs(edges)[0])
