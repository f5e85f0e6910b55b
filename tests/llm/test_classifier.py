import math
import random

import numpy as np
import pyarrow as pa

from loomgraph.llm import classifier


def tables(spark, n=900):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(["the", "of", "and", "to"]) + rng.choice(["", "er", "ing", "tion"]) + str(rng.randrange(30)) * (rng.random() < 0.05) for _ in range(rng.randrange(1, 90))]
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            w = [x + "!!" if kind == 0 else x.upper() if kind == 1 else x + " |" for x in w]
        docs.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, int(good), 0))
    docs += [(n, None), (n + 1, ""), (None, "the of"), (5, docs[5][1])]
    labels += [(None, 1, 0), (n, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    model = classifier.fit(docs, labels)
    scored = classifier.score(docs, model)
    rows = scored.join(labels.where("quality is not null"), "doc_id").where(classifier.held_out()).collect()
    assert len(rows) > 80
    assert np.mean([(r["score"] >= classifier.THRESHOLD) == r["quality"] for r in rows]) > 0.95
    every = scored.collect()
    assert len(every) == docs.count() and all(0 <= r["score"] <= 1 for r in every)
    again = classifier.score(docs, classifier.fit(docs.repartition(7), labels)).collect()
    key = lambda r: (str(r["doc_id"]), round(r["score"], 9))
    assert sorted(map(key, every)) == sorted(map(key, again))


def test_held_out_labels_are_never_read(spark):
    docs, labels = tables(spark, 200)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = classifier.fit(docs, labels), classifier.fit(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and (a.slope, a.shift) == (b.slope, b.shift)


def test_one_class_and_empty_tables(spark):
    docs, labels = tables(spark, 60)
    model = classifier.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in classifier.score(docs, model).collect()} == {0.5}
    assert classifier.score(docs.limit(0), model).count() == 0
    assert classifier.score(docs, classifier.fit(docs, labels.where("quality = 1"))).where("score < 0.5").count() == 0


def test_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 20, 6)) for _ in range(300)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    w, b = classifier.descend(rows, y, np.ones(20), cost=100, epochs=300)
    assert np.mean([np.sign(w[r].sum() + b) == t for r, t in zip(rows, y)]) == 1


def test_descent_reaches_the_least_loss():
    """Against plain subgradient steps on the primal loss of the same scaled rows."""
    rng = np.random.default_rng(4)
    ratio = rng.normal(size=30)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    y = np.array([1.0 if ratio[r].sum() + rng.normal() > 0 else -1.0 for r in rows])
    x = np.zeros((200, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 30] = 1
    cost = np.array([min(4.0, 200 / (2 * (y == t).sum())) for t in y])
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    w, b = classifier.descend(rows, y, ratio, cost=1.0, epochs=400)
    v, least = np.zeros(31), np.inf
    for t in range(1, 40_000):
        v = v - (v - ((cost * y * (y * (x @ v) < 1)) @ x)) / (t + 100)
        least = min(least, loss(v)) if t % 50 == 0 else least
    assert loss(np.append(w, b)) <= least * 1.002


def test_log_count_ratios_match_brute_force(spark):
    docs, labels = tables(spark, 120)
    model = classifier.fit(docs, labels)
    kind = {r["doc_id"]: r["quality"] for r in labels.where(~classifier.held_out()).collect() if r["doc_id"] is not None and r["quality"] is not None}
    held = {0: {}, 1: {}}
    for r in docs.collect():
        if r["doc_id"] in kind:
            for x in next(classifier.features(pa.array([r["text"]], pa.string()))).tolist():
                held[kind[r["doc_id"]]][x] = held[kind[r["doc_id"]]].get(x, 0) + 1
    total = [sum(held[c].values()) + classifier.SIZE for c in (0, 1)]
    for x in {*held[0], *held[1], 5}:
        want = math.log((held[1].get(x, 0) + 1) / total[1]) - math.log((held[0].get(x, 0) + 1) / total[0])
        assert abs(model.ratio[x] - want) < 1e-9


def test_repeated_ids_long_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(classifier, "MAX_BYTES", 20_000)
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = [(i % 50, long if i == 7 else f"the text {i} " * 5, 1, 2.0) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(50)] + [(3, 0, "z")], "doc_id long, quality int, text string")
    a, b = classifier.fit(docs, labels), classifier.fit(docs.repartition(5), labels)
    assert np.array_equal(a.weight, b.weight)
    got = classifier.score(docs, a)
    assert got.columns == ["doc_id", "score"] and got.count() == 150
