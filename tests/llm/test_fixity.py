from pyspark.sql import functions as F

from loomgraph.llm import fixity

SCHEMA = "page_id long, url string, html string"


def record():
    return fixity.warc_record(F.col("url"), F.col("html"))


def run(spark, a, b):
    got = fixity.audit(spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA).repartition(5), "page_id", record())
    return {(r["position"], r["status"], r["copies"], r["replica_copies"]) for r in got.where("status <> 'moved'").collect()}


BASE = [(i, f"http://x/{i}", "body " * (i % 9)) for i in range(2500)] + [(7, "http://x/7", "body " * 7), (70_000, None, None), (70_001, "", "")]


def test_equal_replicas_give_nothing(spark):
    assert run(spark, BASE, list(reversed(BASE))) == set()
    assert run(spark, [], []) == set()


def test_faults_are_located(spark):
    bad = [(i, u, "rot" if i == 1500 else h) for i, u, h in BASE if i != 33] + [(99_999, "http://new", "x")]
    bad.remove((7, "http://x/7", "body " * 7))
    assert run(spark, BASE, bad) == {(1500, "corrupt", 1, 1), (33, "missing", 1, 0), (99_999, "extra", 0, 1), (7, "missing", 1, 0)}


def test_null_and_empty_fields_differ(spark):
    assert run(spark, [(1, None, "a")], [(1, "", "a")]) == {(1, "corrupt", 1, 1)}


def test_records_without_position(spark):
    got = run(spark, [(None, "u", "a"), (None, "u", "b")], [(None, "u", "a"), (None, "u", "c")])
    assert sorted(x[1] for x in got) == ["extra", "missing"]


def test_only_differing_branches_are_joined(spark):
    a = spark.createDataFrame(BASE, SCHEMA)
    b = a.withColumn("html", F.when(F.col("page_id") == 2100, "rot").otherwise(F.col("html")))
    got = fixity.audit(a, b, "page_id", record()).collect()
    assert {r["file"] for r in got} == {2100 // fixity.FILE}
    assert [r["position"] for r in got if r["status"] == "corrupt"] == [2100]
    assert all(r["position"] > 2100 for r in got if r["status"] == "moved")


def test_query_returns_moved_records(spark, tmp_path):
    pages = [(i, f"http://x/{i}", "body " * (i % 9)) for i in range(600)] + [(7, "http://x/7", "body " * 7)]
    df = spark.createDataFrame(pages, SCHEMA)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    size = lambda u, h: len(f"WARC/1.1\r\nWARC-Target-URI: ={u}\r\n\r\n={h}\r\n\r\n")
    copy = fixity.damaged_copy(df).collect()
    starts = []
    for side in (pages, copy):
        at, found = 0, {}
        for i, u, h in sorted(map(tuple, side)):
            found.setdefault(i, (at, h))
            at += size(u, h)
        starts.append(found)
    mine, other = starts
    want = {(i, o, other[i][0]) for i, (o, h) in mine.items() if i in other and other[i][1] == h and other[i][0] != o}
    got = fixity.op1_fixity_audit(spark, str(tmp_path)).collect()
    assert want and {(r["page_id"], r["offset"], r["replica_offset"]) for r in got if r["status"] == "moved"} == want
    assert {r["page_id"] for r in got if r["status"] == "missing"} == set(mine) - set(other)
    twice = [(r["copies"], r["replica_copies"]) for r in got if r["page_id"] == 7 and r["status"] == "moved"]
    assert twice == [(2, 2)] * (7 in {i for i, _, _ in want})


def test_hot_position_is_dealt_out(spark, monkeypatch):
    """A third of all records at one position: the same result, and no group holds them all."""
    hot = [(500, f"http://h/{i}", f"body {i * 7919 % 300}") for i in range(400)]
    a = BASE[:900] + hot
    b = [(p, u, h + "!" if u and u.endswith("/17") else h) for p, u, h in a if u != "http://h/33"]
    audit = lambda: sorted(map(str, fixity.audit(spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA).repartition(2), "page_id", record()).collect()))
    whole = audit()
    monkeypatch.setattr(fixity, "HOT", 20)
    assert audit() == whole and len(whole) > 100
    ledger = fixity.with_offsets(fixity.record_ledger(spark.createDataFrame(a, SCHEMA), "page_id", record()))
    assert ledger.groupBy("file", "at", "deal").count().agg({"count": "max"}).first()[0] < 60
    same = spark.createDataFrame(a, SCHEMA)
    assert fixity.audit(same, same.repartition(4), "page_id", record()).count() == 0


def test_long_records_and_clashing_names(spark):
    long = "x" * 3_000_000
    schema = "page_id long, url string, html string, position string, digest int, file int"
    a = spark.createDataFrame([(1, "u", long, "p", 1, 2), (2, "u", "b", "p", 1, 2)], schema)
    b = spark.createDataFrame([(1, "u", long + "y", "p", 1, 2), (2, "u", "b", "p", 1, 2)], schema)
    got = fixity.audit(a, b, "page_id", record()).collect()
    assert {(r["position"], r["status"]) for r in got} == {(1, "corrupt"), (2, "moved")}
