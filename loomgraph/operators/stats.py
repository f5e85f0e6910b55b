"""Run statistics: one row for each round of an operator."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class RunStats:
    operator: str
    round: int
    input_edges: int
    sampled: int | None = None
    matched: int | None = None
    remaining: int | None = None
    seconds: float | None = None


def stats_frame(spark: SparkSession, rows: list[RunStats]) -> DataFrame:
    kinds = {"operator": "string", "seconds": "double"}
    schema = ", ".join(f"{f.name} {kinds.get(f.name, 'long')}" for f in fields(RunStats))
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rows], schema)
