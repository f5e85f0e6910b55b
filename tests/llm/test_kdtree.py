import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import kdtree


def table(spark):
    rows = [(i, "x" * (i * 37 % 400), "en" if i % 3 else "de", "hot" if i % 3 else f"s{i % 7}", i * 37 % 400) for i in range(900)]
    rows += [(1, "same", "en", "hot", 4)] * 300 + [(None, None, None, None, None), (7, "é漢", None, "hot", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("leaves", [1, 2, 3, 16])
def test_leaves_are_even_and_slots_gapless(spark, leaves):
    rows, df = table(spark)
    got = kdtree.document_shards(df, leaves=leaves).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(leaves))
    total = sum(len((r[1] or "").encode()) + 1 for r in rows)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / leaves) <= 401 * 2
    sizes = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    assert sizes == sorted((str(r[0]), len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)


def test_leaves_reach_the_target(spark):
    _, df = table(spark)
    got = kdtree.document_shards(df, leaves=None, target_bytes=20_000).groupBy("shard").sum("size").collect()
    assert all(r[1] <= 20_000 + 401 for r in got) and len(got) > 3


def brute(rows, leaves):
    """Shard of each (id, weight, coordinates), all coordinates of a dimension different."""
    out = {}

    def split(part, first, leaves):
        if leaves == 1:
            out.update((r[0], first) for r in part)
            return
        spans = [max(r[2][d] for r in part) - min(r[2][d] for r in part) for d in range(len(part[0][2]))]
        dim = spans.index(max(spans))
        goal, at, left = sum(r[1] for r in part) * (leaves // 2) / leaves, 0, []
        part = sorted(part, key=lambda r: r[2][dim])
        for i, r in enumerate(part):
            if at + r[1] >= goal:
                i += at + r[1] - goal <= goal - at
                break
            at += r[1]
        left, right = part[:i], part[i:]
        split(left, first, leaves // 2)
        split(right, first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, leaves)
    return out


@pytest.mark.parametrize("leaves,most", [(2, 1 << 16), (7, 1 << 16), (16, 1 << 16), (16, 4)])
def test_tree_matches_brute_force_over_three_dimensions(spark, monkeypatch, leaves, most):
    """Also when parts of the tree grow one after the other."""
    monkeypatch.setattr(kdtree, "MAX_NODES", most)
    rng = random.Random(leaves)
    grids = [rng.sample(range(65535), 300) for _ in range(3)]
    for g, (lo, hi) in zip(grids, ((0, 65534), (0, 65534), (0, 65534))):
        g[0], g[1] = lo, hi  # every dimension spans its whole scale
    # The second is narrow inside most of the table, so different nodes split along different dimensions.
    grids[1] = [x // 8 if 1 < i < 250 else x for i, x in enumerate(grids[1])]
    grids[1] = [x if grids[1].index(x) == i else None for i, x in enumerate(grids[1])]
    free = iter(sorted(set(range(65535)) - set(grids[1])))
    grids[1] = [next(free) if x is None else x for x in grids[1]]
    rows = [(i, rng.randrange(1, 60), *(g[i] for g in grids)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, w long, x long, y long, z long").repartition(4)
    got = kdtree.kd_shards(df, F.col("w"), {c: F.col(c) for c in "xyz"}, [F.col("id")], [F.col("id")], leaves=leaves).collect()
    scaled = [(i, w, tuple(int(v / 65534 * 65534) + 1 for v in c)) for i, w, *c in rows]
    assert {r["id"]: r["shard"] for r in got} == brute(scaled, leaves)
    assert len({r["shard"] for r in got}) == leaves


def test_kept_columns_may_clash_and_texts_be_long(spark):
    df = spark.createDataFrame([(i, "x" * (1_000_000 if i == 3 else i), "en", "s", i, 5, 6, 7) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long, shard int, weight int, _node int")
    out = kdtree.kd_shards(df, F.length("text") + 1, {"n": F.col("n_chars")}, [F.col("doc_id")], [F.col(c) for c in df.columns if c != "text"], leaves=2)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_node", "weight", "shard", "slot"]
    assert sorted(r["weight"] for r in out.collect())[-1] == 1_000_001
    assert kdtree.document_shards(df, leaves=4).count() == 40


def test_name_places_keep_the_order(spark):
    names = ["", "a", "ab", "abc", "b", "books", "zeta", "\u00e9", "\u6f22"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(kdtree.name_place(F.col("n"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(names)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert kdtree.document_shards(empty).count() == 0
