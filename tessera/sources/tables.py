"""Readers for the driver's parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Files of up to this many bytes may be dealt out by ``spread``; larger ones keep their splits.
SPREAD_BYTES = 64 << 20


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files of a scan, as Catalyst estimates them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """Deal the rows of a small file that is one row group (so one split) over the
    session's cores. The bound is in bytes of input: what is moved is never more than
    ``most``, on any cluster; a larger table is left to its splits."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if scan_bytes(df) <= most and df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
