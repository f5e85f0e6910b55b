"""What follows from component labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_members(components: DataFrame) -> DataFrame:
    """(component, members), the members sorted."""
    return components.groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("members"))


def component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, src, dst) for each edge."""
    return edges.join(components.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")


def component_count(components: DataFrame) -> DataFrame:
    return components.agg(F.countDistinct("component").alias("components"))
