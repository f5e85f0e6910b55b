import random
from collections import defaultdict

from loomgraph.llm import mixing


def levels(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def table(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), f"s{i % 5}" if i % 3 else "s0") for i in range(300)]
    rows += [(400, None, "s1"), (401, "a b", None), (402, "", "nul"), (None, "a b c", "s2"), (403, "x y z", None), (5, "w " * 5, "s0"), (5, "w " * 5, "s0")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_targets_and_taken(spark):
    rows, df = table(spark)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = levels(dict(sizes))
    got = mixing.mix_sources(df, carry=True).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0) == (r["position"] is None)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix_sources(df.repartition(9), carry=True).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=True).collect()
    at = defaultdict(list)
    for r in got:
        at[r["row"]["source"]] += [p for p in (r["position"], r["second_position"]) if p is not None]
    for s, slope in (("s0", -0.5), ("s1", 0.0), ("s2", 0.5)):
        early = sum(p < 0.5 for p in at[s]) / len(at[s])
        assert abs(early - (0.5 - slope / 4)) < 0.02, s  # the schedule's integral over the first half


def test_mixed_documents_keep_columns(spark):
    _, df = table(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, source string, target double")
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_very_long_text_and_clashing_names(spark):
    rows = [(1, "w " * 600_000, "a", 5, 7.0, "h"), (2, "x y z", "a", 5, 7.0, "h"), (2, "x y z", "a", 5, 7.0, "h"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double, _h string")
    out = mixing.mix_sources(df).collect()
    assert sorted(r["size"] for r in out) == [0, 3, 3, 600_000] and sum(r["taken"] for r in out) == 900_009
    kept = mixing.mixed_documents(df)
    assert kept.columns == df.columns and {r["size"] for r in kept.collect()} == {5}


def test_texts_are_shuffled_once_to_the_same_order(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, "w " * rng.randrange(40), f"s{i % 5}" if i % 11 else None, i) for i in range(1500)]
    rows += [(7, "same text", "s1", -1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    once = mixing.mixed_documents(df)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1
    monkeypatch.setattr(mixing, "CUTS", 0)
    # Rows that repeat are interchangeable, so columns that the order doesn't know don't count.
    plain = lambda x: [(r["doc_id"], r["text"], r["source"]) for r in x.collect()]
    one, two = plain(once), plain(mixing.mixed_documents(df))
    assert sorted(one, key=str) == sorted(two, key=str) and len(one) > 1500
    apart = [abs(i - two.index(x)) for i, x in enumerate(one) if one.count(x) == 1]
    assert max(apart) <= 300  # rows of equal order aren't cut, all others are in their place
    assert sum(x > 0 for x in apart) < 0.35 * len(apart)
