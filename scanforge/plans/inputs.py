"""Scan-like inputs as deterministic projections of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp column, as double."""
    return F.col(column).cast("timestamp").cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coloured, time-stamped point for each row of lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("x"),
        F.col("l_quantity").alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (F.col("l_linenumber") * 30 % 256).cast("int").alias("r"),
        F.floor(F.col("l_quantity") * 5 % 256).cast("int").alias("g"),
        (F.col("l_partkey") % 256).cast("int").alias("b"),
        F.col("l_linenumber").cast("int").alias("index"),
        seconds("l_shipdate").alias("timestamp"),
        F.lit(True).alias("valid"),
        F.col("l_orderkey").alias("frame"),
        F.col("l_partkey").alias("part"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose for each distinct order date: position, and yaw in degrees."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(seconds("o_orderdate").alias("ts"))
        .agg((F.min("o_totalprice") / 1000).alias("px"), F.count("*").cast("double").alias("py"), (F.min("o_custkey") / 100).alias("pz"), (F.min("o_orderkey") % 360).cast("double").alias("yaw"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-user time series."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"), "event_type", "value")


#: The same inputs for DuckDB.
CTES = {
    "points": "points AS (SELECT l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z, CAST(l_linenumber * 30 % 256 AS INT) AS r, CAST(floor(l_quantity * 5 % 256) AS INT) AS g, CAST(l_partkey % 256 AS INT) AS b, CAST(l_linenumber AS INT) AS index, epoch(l_shipdate) AS timestamp, true AS valid, l_orderkey AS frame, l_partkey AS part FROM lineitem)",
    "poses": "poses AS (SELECT epoch(o_orderdate) AS ts, min(o_totalprice) / 1000 AS px, CAST(count(*) AS DOUBLE) AS py, min(o_custkey) / 100 AS pz, CAST(min(o_orderkey) % 360 AS DOUBLE) AS yaw FROM orders GROUP BY 1)",
    "samples": "samples AS (SELECT event_id, user_id, epoch(ts) AS t, event_type, value FROM events)",
}


def sql(body: str, *names: str) -> str:
    """A query body after the named inputs; further ones may come first in the body, after a comma."""
    return f"WITH {', '.join(CTES[n] for n in names)} {body}"
