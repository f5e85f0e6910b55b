"""Graphs derived from the tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GRAPHS = {
    "sparse": "SELECT CAST(round(min(l_extendedprice) * 100) AS bigint) AS weight, 2 * l_partkey + 1 AS src, 2 * l_suppkey + 2 AS dst FROM {lineitem} WHERE l_quantity >= 49 AND l_linenumber = 1 GROUP BY l_partkey, l_suppkey",
    "full": "SELECT CAST(round(min(l_extendedprice) * 100) AS bigint) AS weight, 2 * l_partkey + 1 AS src, 2 * l_suppkey + 2 AS dst FROM {lineitem} GROUP BY l_partkey, l_suppkey",
    "orders": "SELECT CAST(round(min(l_extendedprice) * 100) AS bigint) AS weight, 2 * l_orderkey + 1 AS src, 2 * l_partkey + 2 AS dst FROM {lineitem} WHERE l_quantity >= 50 GROUP BY l_orderkey, l_partkey",
    "directed": "SELECT DISTINCT u + 1 AS src, nx + 1 AS dst FROM (SELECT user_id AS u, lead(user_id) OVER (PARTITION BY CAST(ts AS date) ORDER BY ts, event_id) AS nx FROM {events} WHERE event_type = 'error') t WHERE nx IS NOT NULL AND u < nx AND nx - u <= 10",
    # Users that follow each other within a day; odd cycles are common.
    "users": "SELECT min(w) AS weight, u + 1 AS src, nx + 1 AS dst FROM (SELECT event_id AS w, user_id AS u, lead(user_id) OVER (PARTITION BY CAST(ts AS date), event_type ORDER BY ts, event_id) AS nx FROM {events}) t WHERE nx IS NOT NULL AND u <> nx GROUP BY u, nx",
    # All rows of both tables; arcs lead from customers over orders and parts to suppliers.
    "rows": "SELECT CAST(round(min(o_totalprice) * 100) AS bigint) AS weight, 4 * o_custkey AS src, 4 * o_orderkey + 1 AS dst FROM {orders} GROUP BY o_custkey, o_orderkey"
    " UNION ALL SELECT CAST(round(min(l_extendedprice) * 100) AS bigint), 4 * l_orderkey + 1, 4 * l_partkey + 2 FROM {lineitem} GROUP BY l_orderkey, l_partkey"
    " UNION ALL SELECT CAST(round(min(l_extendedprice) * 100) AS bigint), 4 * l_partkey + 2, 4 * l_suppkey + 3 FROM {lineitem} GROUP BY l_partkey, l_suppkey",
}


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(GRAPHS[name].format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`", events=f"parquet.`{sf_dir}/events.parquet`", orders=f"parquet.`{sf_dir}/orders.parquet`"))


def graph_sql(name: str) -> str:
    return GRAPHS[name].format(lineitem="lineitem", events="events", orders="orders")
