"""Readers and writers of the engine's text formats; every reader gives a typed DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The token that stands for an infinite distance in search records (a fixed value of the format).
INFINITE = "Integer.MAX"


def _parsed(lines: DataFrame, pattern: str, kinds: list[tuple[str, str]], lenient: bool) -> DataFrame:
    parts = F.split(F.btrim("value"), pattern)
    cast = (lambda c, t: c.try_cast(t)) if lenient else (lambda c, t: c.cast(t))
    return lines.where("btrim(value) <> ''").select(*[cast(F.get(parts, F.lit(i)), t).alias(n) for i, (n, t) in enumerate(kinds)])


def read_weighted_edges(spark: SparkSession, path, weight: str = "double", lenient: bool = False) -> DataFrame:
    """WEIGHT<TAB>SRC<TAB>DST.  A bad field raises, or is null if ``lenient``."""
    return _parsed(spark.read.text(path), "\t", [("weight", weight), ("src", "bigint"), ("dst", "bigint")], lenient)


def read_directed_edges(spark: SparkSession, path, lenient: bool = False) -> DataFrame:
    """SRC DST, separated by white space."""
    return _parsed(spark.read.text(path), r"\s+", [("src", "bigint"), ("dst", "bigint")], lenient)


def read_integers(spark: SparkSession, path, lenient: bool = False) -> DataFrame:
    """One integer a line."""
    return _parsed(spark.read.text(path), r"\s+", [("value", "bigint")], lenient)


def decode_adjacency(value: Column) -> list[Column]:
    """ID<TAB>n1,n2,..|DIST|COLOR as (id, edges, distance, color); an infinite distance is null."""
    head = F.split(value, "\t")
    body = F.split(F.get(head, F.lit(1)), r"\|")
    near = F.filter(F.split(F.get(body, F.lit(0)), ","), lambda x: x != "")
    far = F.get(body, F.lit(1))
    return [
        F.get(head, F.lit(0)).cast("bigint").alias("id"),
        F.transform(near, lambda x: x.cast("bigint")).alias("edges"),
        F.when(far != INFINITE, far.cast("int")).alias("distance"),
        F.get(body, F.lit(2)).alias("color"),
    ]


def encode_adjacency() -> Column:
    """The record of (id, edges, distance, color) as one line."""
    far = F.coalesce(F.col("distance").cast("string"), F.lit(INFINITE))
    return F.concat(F.col("id").cast("string"), F.lit("\t"), F.array_join("edges", ","), F.lit("|"), far, F.lit("|"), F.col("color"))


def read_adjacency(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).where("btrim(value) <> ''").select(*decode_adjacency(F.col("value")))


def read_sequence_file(spark: SparkSession, path) -> DataFrame:
    """(key, value) of a SequenceFile of integers and texts; Spark reads the format through its RDD interface only."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), "key bigint, value string", verifySchema=False)


def read_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str, *columns: str, separator: str = "\t", single_file: bool = False) -> None:
    """Columns joined by ``separator``, one row a line; ``single_file`` merges all parts into one."""
    line = F.concat_ws(separator, *[F.col(c).cast("string") for c in columns or df.columns])
    out = df.select(line.alias("value"))
    (out.coalesce(1) if single_file else out).write.text(path)


def write_edges(edges: DataFrame, path: str, whole_weights: bool = False, **how) -> None:
    """WEIGHT<TAB>SRC<TAB>DST; ``whole_weights`` cuts weights to integers."""
    shown = edges.withColumn("weight", F.col("weight").cast("bigint")) if whole_weights else edges
    write_lines(shown, path, "weight", "src", "dst", **how)


def write_members(members: DataFrame, path: str, **how) -> None:
    """COMPONENT<TAB>[a, b, ..]."""
    shown = members.select("component", F.concat(F.lit("["), F.array_join("members", ", "), F.lit("]")).alias("members"))
    write_lines(shown, path, **how)


def write_adjacency(records: DataFrame, path: str) -> None:
    records.select(encode_adjacency().alias("value")).write.text(path)


def each_input(paths: list[str], run: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The result of ``run`` for each input path."""
    return {p: run(p) for p in paths}
