import random
import re

from loomgraph.llm import rules

SPACE = "[\x20\x09-\x0D]"


def brute(text):
    text = text or ""
    words = [w for w in re.split(SPACE + "+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é ü ñ 漢字 😀 a\x0bb\x0cc\rd", "l one\nl one\n\nl one\nl two", "#* $%&|<> a"]
    out += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(30)]
    out += ["\n".join(rng.choice(["one line here", "other line", "third one"]) for _ in range(40))]
    out += [" ".join(f"w{rng.randrange(2000)}" for _ in range(3000))]
    return out


def test_metrics_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.quality_rules(df).collect()}
    for i, t in enumerate(texts()):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t
        n, *_, repeat = brute(t)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_kept_rows_keep_columns(spark):
    rng = random.Random(5)
    good = " ".join(rng.choice(["the", "of", "and", "in"]) if i % 3 == 0 else f"word{rng.randrange(500)}" for i in range(120))
    df = spark.createDataFrame([(1, good, 5, None), (2, "short", 6, "x"), (3, "# " * 90 + good, 7, "y"), (1, good, 5, None), (4, None, 1, "z")], "doc_id long, text string, n_words int, _q_words string")
    kept = rules.kept_rows(df)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [(1, good, 5, None)] * 2
    judged = rules.quality_rules(df)
    assert "_q_words" in judged.columns and judged.columns.count("n_words") == 1
    assert [(r["_q_words"], r["kept"]) for r in judged.orderBy("doc_id").collect()] == [(None, True), (None, True), ("x", False), ("y", False), ("z", False)]
    assert rules.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
