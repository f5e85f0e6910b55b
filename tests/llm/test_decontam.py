import random
import re

from loomgraph.llm import decontam


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def nearest(item, text):
    """Least edit distance of the item to any run of the text's words."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def tables(seed=6):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 8, 16, 24, 40, 70])))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "Éa ñ 漢 x y z 1 2 3"), (None, "no id item here at all ok fine"), (50, "one two three four five six seven eight nine ten")]
    docs = [(0, None), (1, ""), (2, "... ---")]
    for d in range(3, 90):
        text = [word() for _ in range(rng.randrange(120))]
        if d % 2:
            held = tokens(items[rng.randrange(len(items))][1])
            for _ in range(rng.randrange(8)):
                if held:
                    at = rng.randrange(len(held))
                    held[at : at + 1] = rng.choice([[], ["zz"], [held[at], "yy"]])
            at = rng.randrange(len(text) + 1)
            text[at:at] = held
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in text)))
    docs += [docs[5], (None, items[4][1])]
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        for k, x in items:
            item = tokens(x)
            if item and (far := nearest(item, tokens(t))) <= len(item) // decontam.WORDS_AN_EDIT:
                want.append((i, k, far, len(item)))
    got = decontam.find_leaks(d, q).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in got), key=str) == sorted(want, key=str)
    assert any(far > 0 for _, _, far, _ in want)
    texts = dict(docs[:-2])
    for r in got:  # the place reported is within the distance reported
        if r["doc_id"] is not None and r["item_id"] not in (None, 50):
            part = tokens(texts[r["doc_id"]])[r["first_word"] : r["end_word"]]
            item = tokens(dict(items)[r["item_id"]])
            assert nearest(item, part) <= r["distance"]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = tables(8)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontam.find_leaks(d, q).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert sorted(map(str, decontam.find_leaks(d, q).collect())) == whole
    leaky = {r["doc_id"] for r in decontam.find_leaks(d, q).collect()}
    kept = decontam.drop_leaks(d, q)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - leaky


def test_long_text_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    long_text = ("filler word " * 120_000) + passage + (" more filler" * 50_000)
    d = spark.createDataFrame([(1, long_text), (2, "x" * 3_000_000)], "doc_id long, text string")
    q = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert [tuple(r) for r in decontam.find_leaks(d, q).collect()] == [(1, 9, 0, 240_000, 240_040, 40)]
    assert decontam.find_leaks(d.limit(0), q).count() == 0
    assert decontam.find_leaks(d, q.limit(0)).count() == 0


def test_first_word_missing_at_the_start(spark):
    item = [f"p{i}" for i in range(38)]
    d = spark.createDataFrame([(1, " ".join(item[1:] + ["tail"] * 20))], "doc_id long, text string")
    q = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontam.find_leaks(d, q).collect()] == [(1, 9, 1, 0, 37, 38)]
    assert decontam.drop_leaks(d, q).count() == 0


def test_drop_leaks_keeps_extra_columns_nulls_and_repeats(spark):
    rows = [(1, "one two three four", 5, "a"), (1, "clean words only", 6, "b"), (None, None, 7, "c"), (2, "clean words only", 6, "b"), (2, "clean words only", 6, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id int, distance string")
    q = spark.createDataFrame([(9, "two three four"), (None, None)], "item_id long, text string")
    kept = decontam.drop_leaks(d, q)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    assert decontam.drop_leaks(d.limit(0), q).count() == 0 and decontam.drop_leaks(d, q.limit(0)).count() == 5
