"""Text formats there and back, and file helpers."""

import pytest

from loomgraph.plans import store
from loomgraph.sources import files, text
from loomgraph.operators.sketch import pcsa_buckets
from loomgraph.streaming.sketch import streaming_buckets, windowed_buckets


def test_weighted_edges_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 1, 2), (2.0, 3, 4)], "weight double, src long, dst long")
    text.write_edges(df, f"{tmp_path}/e")
    assert sorted(map(tuple, text.read_weighted_edges(spark, f"{tmp_path}/e").collect())) == [(1.5, 1, 2), (2.0, 3, 4)]
    text.write_edges(df, f"{tmp_path}/w", whole_weights=True, single_file=True)
    assert len(files.list_files(spark, f"{tmp_path}/w/part-*")) == 1
    assert sorted(map(tuple, text.read_weighted_edges(spark, f"{tmp_path}/w", "bigint").collect())) == [(1, 1, 2), (2, 3, 4)]


def test_directed_edges_and_integers(spark, tmp_path):
    (tmp_path / "d").write_text("1 2\n3\t4\n\n")
    assert sorted(map(tuple, text.read_directed_edges(spark, str(tmp_path / "d")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "i").write_text("7\nx\n")
    assert sorted(map(tuple, text.read_integers(spark, str(tmp_path / "i"), lenient=True).collect()), key=str) == [(7,), (None,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_integers(spark, str(tmp_path / "i")).collect()


def test_adjacency_round_trip(spark, tmp_path):
    lines = ["1\t2,3|0|GRAY", "2\t|Integer.MAX|WHITE", "3\t1,|4|BLACK"]
    (tmp_path / "a").write_text("\n".join(lines))
    df = text.read_adjacency(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, df.collect())) == [(1, [2, 3], 0, "GRAY"), (2, [], None, "WHITE"), (3, [1], 4, "BLACK")]
    text.write_adjacency(df, f"{tmp_path}/out")
    assert sorted(r[0] for r in text.read_lines(spark, f"{tmp_path}/out").collect()) == [lines[0], lines[1], "3\t1|4|BLACK"]


def test_members_and_inputs(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "component long, members array<long>")
    text.write_members(df, f"{tmp_path}/m")
    found = text.each_input([f"{tmp_path}/m"], lambda p: text.read_lines(spark, p))
    assert found[f"{tmp_path}/m"].first()[0] == "1\t[1, 2]"


def test_sequence_file(spark, tmp_path):
    spark.sparkContext.parallelize([(1, "a"), (2, "b")]).saveAsSequenceFile(f"{tmp_path}/s")
    assert sorted(map(tuple, text.read_sequence_file(spark, f"{tmp_path}/s").collect())) == [(1, "a"), (2, "b")]


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a").write_text("1" * 2500)
    (tmp_path / "x" / "b").write_text("")
    seen = []
    files.copy_from_local(spark, str(tmp_path / "x"), str(tmp_path / "y"), lambda name, done: seen.append((name[-1], done)), piece=1000)
    assert seen == [("a", 1000), ("a", 2000), ("a", 2500)] and (tmp_path / "y" / "a").read_text() == "1" * 2500 and (tmp_path / "y" / "b").read_text() == ""
    assert files.delete(spark, str(tmp_path / "y")) and not files.delete(spark, str(tmp_path / "y"))
    assert files.user_name(spark)


def test_scratch_scope(spark):
    with store.scratch_scope(spark) as keep:
        one = store.materialize(spark.range(3))
        two = keep(store.materialize(spark.range(4)))
        assert one.count() == 3
    assert two.count() == 4
    with pytest.raises(Exception, match="(?i)not.?found|does not exist"):
        one.collect()


def test_scratch_tables(spark):
    df = store.materialize(spark.range(5).toDF("x"))
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString()
    store.discard(df)
    again = store.materialize(spark.range(2))
    store.clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not.?found|does not exist"):
        again.collect()


def test_streaming_sketch(spark, tmp_path):
    spark.range(50).selectExpr("id as value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("value long").parquet(f"{tmp_path}/in")
    query = streaming_buckets(stream, [4]).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    try:
        query.processAllAvailable()
        assert spark.table("buckets").count() == 4
    finally:
        query.stop()


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = spark.range(600).selectExpr("id as value", "timestamp_seconds(id) as at")
    rows.where("value < 300").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    rows.where("value >= 300").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema("value long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = windowed_buckets(stream, 4, "at", "60 seconds", "10 seconds").writeStream.outputMode("append").format("memory").queryName("windows").start()
    try:
        query.processAllAvailable()
        got = {(r["start"].timestamp(), r["bucket"], r["bm"], r["r"]) for r in spark.table("windows").collect()}
    finally:
        query.stop()
    want = set()
    for first in range(0, 540, 60):  # the last window is still open
        part = rows.where(f"value >= {first} and value < {first + 60}").select("value")
        want |= {(float(first), r["bucket"], r["bm"], r["r"]) for r in pcsa_buckets(part, [4]).collect()}
    assert got == want
