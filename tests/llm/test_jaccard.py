import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import jaccard
from loomgraph.llm.wordhash import distinct, mix, shingles, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        groups[root(a)].append(i)
    return sorted((i, len(s), min(groups[root(a)])) for a, (i, s) in enumerate(sets))


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(300)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            op = rng.randrange(3)
            if op == 0:
                w[at] = f"x{rng.randrange(40)}"
            elif op == 1:
                del w[at]
            else:
                w.insert(at, f"y{rng.randrange(40)}")
        out.append(" ".join(w))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "One", "one two", "ONE TWO", "a b c", "A  b\nc", "d e f g"]
    texts += ["same text in many rows " * 3] * 12
    texts += family(rng, 90, 120, 7) + family(rng, 12, 40, 4) + family(rng, 6, 700, 40)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"q{rng.randrange(500)}" for _ in range(25)) + " " + passage for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k,num,small,block", [(3, 90, 4, 20), (5, 80, 2, 8), (5, 80, 64, 512)])
def test_components_and_links_match_brute_force(spark, monkeypatch, k, num, small, block):
    """Limits so small that regions become cells, and cells many blocks; and those of production."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(7)
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    kinds = {s: min(i for i, x in sets if x == s) for _, s in sets if s}
    links = {s: sum(x != s and 100 * len(s & x) >= num * len(s | x) for x in kinds) for s in kinds}
    want = [(i, n, kinds.get(s, i), c, links.get(s, 0)) for (i, n, c), (_, s) in zip(brute(rows, k, num, 100), sorted(sets))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, num, 100)
    assert sorted(map(tuple, got.collect())) == want


def test_the_sketch_finds_common_elements_at_6_gb(spark):
    """1.5 billion shingles: elements that 200 documents hold stand out from what others add to their counters."""
    rng, width, tasks = np.random.default_rng(4), (1 << jaccard.SKETCH_BITS) // jaccard.SKETCH_PARTS, 50
    common = rng.choice(width, 100, replace=False)
    rows = [(1_500_000_000, None, None)]
    for _ in range(tasks):
        counts = rng.poisson(1.5e9 / (1 << jaccard.SKETCH_BITS) / tasks, width).astype(np.uint8)
        counts[common] += 200 // tasks
        rows.append((None, 3, zlib.compress(counts)))
    info = spark.createDataFrame(rows, "n long, part int, counts binary")
    levels = np.frombuffer(zlib.decompress(jaccard._levels(info)), np.uint8)[3 * width : 4 * width]
    assert (levels[common] > 0).all() and np.count_nonzero(levels) < 100 + width / 1000


def test_linked_sets_share_a_prefix_element():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 3, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for num, den in ((90, 100), (80, 100)):
        for n in (1, 2, 5, 9, 10, 19, 20, 50, 95, 141, 400, 1500):
            s = distinct(mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
            for _ in range(6):
                keep = s[rng.random(n) > rng.random() * 0.12]
                extra = mix(rng.integers(0, 1 << 62, int(n * rng.random() * 0.12)).astype(np.uint64))
                t = distinct(np.concatenate((keep, extra)))
                common = len(np.intersect1d(s, t))
                if len(t) and den * common >= num * (len(s) + len(t) - common):
                    assert np.intersect1d(jaccard.prefix(s, num, den, levels), jaccard.prefix(t, num, den, levels)).size


def test_overlaps_of_rows():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 400, rng.integers(0, 120))).astype(np.uint64) for _ in range(70)]
    want = [[0 if i == j else len(np.intersect1d(x, y)) for j, y in enumerate(rows)] for i, x in enumerate(rows)]
    assert (jaccard.overlaps(rows) == np.array(want)).all()


def test_common_elements_come_last(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for i in range(200)]
    info = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(jaccard._info(3), "doc_id long, n long, h1 long, h2 long, " + "".join(f"{c} long, " for c in jaccard.PARITY) + "part int, counts binary")
    levels = np.frombuffer(zlib.decompress(jaccard._levels(info)), np.uint8)
    common = distinct(shingles(next(words(pa.array([passage])))[1], 3))
    assert (levels[jaccard._counter(common)] > 0).all() and np.count_nonzero(levels) <= len(common)


def test_elements_of_rare_words_come_first(spark):
    """Phrases of common words, too few for the sketch to tell, don't make regions of documents that have rare words."""
    rng = random.Random(12)
    phrases = [" ".join(f"c{rng.randrange(12)}" for _ in range(8)) for _ in range(40)]
    rows = [(i, " ".join(f"{rng.choice(phrases)} r{i}x{j}" for j in range(20))) for i in range(60)]
    twin = rows[0][1].split()
    rows.append((60, " ".join(twin[:-3])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    info = df.mapInArrow(jaccard._info(5), "doc_id long, n long, h1 long, h2 long, " + "".join(f"{c} long, " for c in jaccard.PARITY) + "part int, counts binary")
    classes = info.where("n > 0").selectExpr("doc_id as cls", "n", "h1", "h2", *jaccard.PARITY)
    nothing_common = zlib.compress(np.zeros(1 << jaccard.SKETCH_BITS, np.uint8))
    regions = jaccard._Join(df, classes, (nothing_common, jaccard._word_ranks(info)), 5, 80, 100).regions()
    assert {r["cls"] for r in regions.select("cls").collect()} == {0, 60}
    got = jaccard.jaccard_components(df, 5, 80, 100).where("n_links > 0").collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(0, 0, 1), (60, 0, 1)]


def test_the_sieve_of_shared_elements(spark):
    """It misses none, keeps most others away, and no literal of its size goes to every task."""
    rng = np.random.default_rng(3)
    sig = mix(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    df = spark.createDataFrame([(int(x),) for x in sig[:10_000].view(np.int64)], "sig long").repartition(3)
    held = jaccard._held(sig, np.frombuffer(zlib.decompress(jaccard._sieve(df)), np.uint8))
    assert held[:10_000].all() and np.count_nonzero(held[10_000:]) < 10
    assert not np.frombuffer(zlib.decompress(jaccard._sieve(df.limit(0))), np.uint8).any()


def test_empty_null_ids_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty, 3, 90, 100).count() == 0
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (4, "a b c d", 3), (5, "x y z", 4), (5, "x y z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    got = jaccard.jaccard_components(df, 3, 90, 100).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4), (None, 4), (4, 4), (5, 5), (5, 5)], key=str)
    kept = jaccard.one_of_each(df, 3, 90, 100)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "a b c d", 1), (None, "a b c d", 2), (4, "a b c d", 3), (5, "x y z", 4)], key=str)


def test_one_of_each_keeps_the_least_id(spark):
    """With clashing names and a column of maps; equal rows become one."""
    rows = [(i, t, i, "x", 2.0, {"a": 1}) for i, t in corpus(9)]
    df = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, key int, dropped string, component_id double, m map<string, int>")
    kept = jaccard.one_of_each(df)
    want = sorted(i for i, _, c in brute([r[:2] for r in rows], 5, 80, 100) if i == c)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_repeated_rows_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rows = corpus(4)
    rows = [(None, t) if i % 9 == 0 else (i, t) for i, t in rows for _ in range(2)]
    twin = " ".join(f"t{i}" for i in range(90))
    rows += [(1000, "another text of this id " * 9), (1000, twin), (999, twin + " end"), (None, twin), (998, twin)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = jaccard.jaccard_components(df, 3, 90, 100).select("doc_id", "n_shingles", "component_id").collect()
    least = [(10**6 if i is None else i, t) for i, t in rows]
    empty = lambda r: r[1] == 0
    got = sorted((10**6 if i is None else i, n, 10**6 if c is None else c) for i, n, c in found)
    assert [x for x in got if not empty(x)] == [x for x in brute(least, 3, 90, 100) if not empty(x)]


def test_the_row_that_stands_for_a_class(spark):
    """Null ids and ids with two texts lose no link, in one partition or many."""
    base = [f"w{i}" for i in range(200)]
    a, b, other = " ".join(base), " ".join(base[:-1]), "quite another text of seven words"
    for rows, want in (([(None, a), (4, a), (9, b)], {(4, 4), (9, 4)}), ([(7, a), (7, other), (3, a), (9, b)], {(7, 3), (7, 7), (3, 3), (9, 3)})):
        for parts in (1, 2):
            got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 3, 90, 100)
            assert {(r["doc_id"], r["component_id"]) for r in got.where("doc_id is not null").collect()} == want


def test_very_long_text(spark):
    rng = random.Random(6)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-500])), (3, " ".join(w[:1000]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got.collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker():
    """The sketch and the sieve cost a worker some MB, even if a task gets all their parts."""
    text = [" ".join(f"w{i * j % 997}" for i in range(300)) for j in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(text)], ["doc_id", "text"])
    assert peak_mb(lambda: [None for _ in jaccard._info(5)([batch])]) < 48
    spots = next(jaccard._set_spots([pa.RecordBatch.from_arrays([pa.array(np.random.default_rng(1).integers(0, 1 << 63, 20_000))], ["sig"])]))
    assert len(set(spots.column(0).to_pylist())) == jaccard.SIEVE_PARTS
    assert peak_mb(lambda: [None for _ in jaccard._fill_parts([spots])]) < 24


def test_sketch_and_sieve_parts():
    """Counts saturate at 255; the parts of the sieve hold the bits that were set and no others."""
    total, want = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8), np.zeros(1 << jaccard.SKETCH_BITS, np.int64)
    rng, same = np.random.default_rng(2), np.arange(300, dtype=np.uint64)
    for _ in range(9):
        for s in (same[:40], same + np.uint64(7 << 50), distinct(rng.integers(0, 1 << 63, 5000).astype(np.uint64)), same[:1]):
            jaccard._tally(total, s)
            np.add.at(want, jaccard._counter(s), 1)
    assert want.max() > 255 and (total == np.minimum(want, 255)).all()
    sig = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    batches = [b for half in (sig[:1500], sig[1000:]) for b in jaccard._set_spots([pa.RecordBatch.from_arrays([pa.array(half.view(np.int64))], ["sig"])])]
    bits = np.zeros((jaccard.SIEVE_PARTS, (1 << jaccard.SIEVE_BITS) // jaccard.SIEVE_PARTS // 8), np.uint8)
    for b in jaccard._fill_parts(batches):
        bits[b.column(0)[0].as_py()] = np.frombuffer(zlib.decompress(b.column(1)[0].as_buffer()), np.uint8)
    assert (np.flatnonzero(np.unpackbits(bits.ravel())) == np.unique(jaccard._spots(sig))).all()
    assert jaccard._held(sig, bits.ravel()).all()
