import pytest

from loomgraph.llm import cascade

URLS = {
    "https://a.example.com/en/123": ("a.example.com", "/en/123", "com/en/", "block"),
    "https://A.Example.COM/en/7x?q=/de/": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
    "http://x.net/de/5#f": ("x.net", "/de/5", "net/de/", "allow"),
    "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
    "http://notexample.net/de/81": ("notexample.net", "/de/81", "net/de/", "allow"),
    "http://m.ads.org/fr/1": ("m.ads.org", "/fr/1", None, "block"),
    "http://ads.org/fr/1": ("ads.org", "/fr/1", None, "block"),
    "http://x.y.M.ads.org": ("x.y.m.ads.org", "", None, "block"),
    "http://bads.org/fr/1": ("bads.org", "/fr/1", None, "allow"),
    "http://ads.org.uk/": ("ads.org.uk", "/", None, "allow"),
    "http://long.org/" + "x" * 100_000: ("long.org", "/" + "x" * 100_000, None, "allow"),
    "http://nice.org/fr/1": ("nice.org", "/fr/1", None, "allow"),
    "http://com/en/1": ("com", "/en/1", "com/en/", "block"),
    "http://telecom/en/1": ("telecom", "/en/1", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "http://host?x=1": ("host", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
}


@pytest.mark.parametrize("most", [1 << 26, 32])
def test_verdicts(spark, monkeypatch, most):
    """Also when the keys need several cascades."""
    monkeypatch.setattr(cascade, "MAX_BITS", most)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(99, None), (0, list(URLS)[0])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("ads.org",), (None,), ("other.org",), ("ads.org",)], "key string")
    got = cascade.judge_urls(df, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ("", "", None, "allow") if r["url"] is None else URLS[r["url"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want, r["url"]


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(cascade, "BITS_A_KEY", 3)  # many false positives, so many levels
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = keys.where("cast(substring(key, 2) as int) % 3 = 0")
    (built,) = cascade.build_cascades(keys.union(keys), listed)
    assert len(built.levels) > 2
    held = keys.where(built.holds(keys["key"]))
    assert {r[0] for r in held.collect()} == {r[0] for r in listed.collect()}


def test_a_list_too_large_for_one_cascade(spark, monkeypatch):
    monkeypatch.setattr(cascade, "MAX_BITS", 1024)
    keys = spark.range(600).selectExpr("concat('k', id) as key")
    listed = keys.where("cast(substring(key, 2) as int) % 2 = 0")
    built = cascade.build_cascades(keys, listed)
    assert len(built) > 1
    held = set()
    for part, one in enumerate(built):
        held |= {r[0] for r in keys.where((cascade.part_of(keys["key"], len(built)) == part) & one.holds(keys["key"])).collect()}
    assert held == {r[0] for r in listed.collect()}


def test_empty_sides_and_clashing_names(spark):
    none = spark.createDataFrame([], "key string")
    some = spark.createDataFrame([("a",), (None,)], "key string")
    (nothing,), (one,) = cascade.build_cascades(some, none), cascade.build_cascades(none, some)
    assert some.where(nothing.holds(some["key"])).count() == 0
    assert some.where(one.holds(some["key"])).count() == 1
    empty = spark.createDataFrame([], "page_id long, url string")
    assert cascade.judge_urls(empty, none).count() == 0
    clash = spark.createDataFrame([(1, "http://a.org/x", 7, "y", 2.0)], "key long, url string, host int, rule string, listed double")
    out = cascade.judge_urls(clash, some)
    assert out.columns == ["key", "url", "listed", "host", "path", "rule", "verdict"]
    assert tuple(out.first()) == (1, "http://a.org/x", 2.0, "a.org", "/x", None, "allow")
