"""Keyed record store and index tables (SRC-3/4/5/6/8, AGG-11, PIP-5 sinks).

Layout of a version (any Hadoop file system path)::

    records/bucket=<b>/part-*.parquet     key, value (JSON), ord
    embeddings/part-*.parquet             key, embedding array<float>
    minhash/part-*.parquet                key, sig array<bigint>
    ivf/{model,lists,vectors}/            IVF-PQ tables (see operators.ivfpq)

A store root holds versions and manifests::

    versions/<name>/...                   the tables above, never changed after publishing
    manifests/<number>                    {"version": <name>, "tables": [...]}, each written once

``new_version`` names a folder, the builder writes its tables there, and ``publish`` adds the
manifest last, by a rename. Readers open the manifest of the highest number, so
that a build that fails half-way, or runs while others read, changes nothing for them. A
root without manifests is a single version itself, told by its folders.

The bucket of a key is ``first 32 bits of md5(key) mod n`` — a stable hash any
engine can recompute; buckets are a partition column, so a lookup of known keys
prunes to their buckets.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.corpus import RECORD_FIELDS, drop_blank_keys, record_key, to_json_record, with_ordinal


def key_bucket(key: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substr(F.md5(key), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(n))


def keyed_records(corpus: DataFrame, num_buckets: int = 16) -> DataFrame:
    """SRC-3: key every record (PRJ-2), drop blank keys (FLT-5), value = the whole
    record as JSON (JSN-1), one row per key (a later record replaces an earlier
    one, by ``ord``)."""
    keyed = drop_blank_keys(corpus.withColumn("key", record_key()))
    keyed = keyed.withColumn("value", to_json_record())
    return last_by_key(keyed.select("key", "value", "ord"), "key", "ord").select(
        "key", "value", "ord", key_bucket(F.col("key"), num_buckets).cast("int").alias("bucket"))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest ``order``: the winning order is found on two
    narrow columns (a hash aggregate that collapses a hot key map-side), then joined back."""
    last = df.groupBy(key).agg(F.max(order).alias(order))
    return df.join(last, [key, order], "left_semi")


def keyed_records_kv(df: DataFrame, key_field: str = "word", value_field: str = "definition",
                     num_buckets: int = 1000, ord_col: str = "ord") -> DataFrame:
    """SRC-4: user-chosen key/value fields; the value is stored as given. Of a repeated key
    the row with the largest ``ord_col`` stays (without that column: the last one read)."""
    if ord_col not in df.columns:
        df = with_ordinal(df, ord_col)
    kv = (df.select(F.col(key_field).cast("string").alias("key"), F.col(value_field).cast("string").alias("value"),
                    F.col(ord_col).alias("ord")).filter(F.col("key").isNotNull() & (F.col("key") != "")))
    return last_by_key(kv, "key", "ord").withColumn("bucket", key_bucket(F.col("key"), num_buckets).cast("int"))


def write_records(store: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Write the store partitioned by ``bucket``. The rebalance hint sizes the writer tasks
    by bytes (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): Spark splits a large
    bucket over many tasks and files and gathers small ones."""
    (store.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key")
     .write.mode(mode).partitionBy("bucket").parquet(os.path.join(root, "records")))


def read_records(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, "records"))


def lookup(store: DataFrame, keys: DataFrame, num_buckets: int, key: str = "key") -> DataFrame:
    """Fetch records of known keys, reading their buckets only: the buckets that the keys need (at
    most ``num_buckets`` numbers) become a partition filter of the scan."""
    k = keys.select(F.col(key).alias("key")).withColumn("bucket", key_bucket(F.col("key"), num_buckets).cast("int"))
    wanted = sorted(r["bucket"] for r in k.where("bucket IS NOT NULL").select("bucket").distinct().collect())
    return store.where(F.col("bucket").isin(wanted)).join(k, ["bucket", "key"], "inner")


def write_bucketed(df: DataFrame, root: str, name: str, buckets: int, key: str = "key") -> DataFrame:
    """Store ``df`` as the table ``name``, bucketed and sorted by ``key``, under ``root``, and return it.
    Two tables of one number of buckets join on their keys without a shuffle. The layout is
    written beside the files, so that ``open_bucketed`` finds it in another session."""
    spark, path = df.sparkSession, os.path.join(root, name)
    (df.repartition(buckets, F.col(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(name))
    fs, at = _fs(spark, path.rstrip("/") + ".layout")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"key": key, "buckets": buckets, "schema": spark.table(name).schema.toDDL()}).encode()))
    out.close()
    return spark.table(name)


def open_bucketed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table that ``write_bucketed`` stored, registered in this session if it is not."""
    path = os.path.join(root, name)
    if not spark.catalog.tableExists(name):
        layout = json.loads("".join(r["value"] for r in spark.read.text(path.rstrip("/") + ".layout").collect()))
        spark.sql(f"CREATE TABLE `{name}` ({layout['schema']}) USING parquet CLUSTERED BY (`{layout['key']}`) "
                  f"SORTED BY (`{layout['key']}`) INTO {int(layout['buckets'])} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def store_stats(store: DataFrame) -> DataFrame:
    """SRC-6 / AGG-11: records and value bytes per bucket, plus a total row
    (``bucket`` null) from ``rollup``."""
    return (store.rollup("bucket")
            .agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("value")).alias("value_bytes"))
            .select("bucket", "n_records", "value_bytes"))


def write_embeddings(vectors: DataFrame, root: str, mode: str = "overwrite") -> None:
    """SRC-5 sink: ``(key, embedding)`` and ``ord``, where there is one, as Parquet."""
    cols = [c for c in ("ord", "key", "embedding") if c in vectors.columns]
    vectors.select(*cols).write.mode(mode).parquet(os.path.join(root, "embeddings"))


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(os.path.join(root, name))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _fs(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_version(root: str) -> str:
    """The folder of a version that is not published yet."""
    return os.path.join(root, "versions", uuid.uuid4().hex)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, os.path.join(root, "manifests"))
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def publish(spark: SparkSession, root: str, version: str) -> int:
    """Make the folder ``version`` of ``root`` the one that readers open; its manifest's number. Of
    two builders that publish at once each gets a number of its own; the higher one holds."""
    fs, at = _fs(spark, version)
    if not fs.exists(at):
        raise FileNotFoundError(f"no version at {version}")
    tables = sorted(f.getPath().getName() for f in fs.listStatus(at))
    if "ivf" in tables and not fs.exists(_fs(spark, os.path.join(version, "ivf", "lists"))[1]):
        tables.remove("ivf")
    text = json.dumps({"version": os.path.basename(version.rstrip("/")), "tables": tables})
    _, draft = _fs(spark, os.path.join(root, "manifests", f"draft-{uuid.uuid4().hex}"))
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    number = max(_numbers(spark, root), default=0) + 1
    while not fs.rename(draft, _fs(spark, os.path.join(root, "manifests", str(number)))[1]):
        number += 1
        if number > max(_numbers(spark, root), default=0) + 1:
            raise OSError(f"the manifest could not be renamed in {root}")
    return number


def published(spark: SparkSession, root: str, number: int | None = None) -> tuple[str, list[str]] | None:
    """(folder, tables) of the version of the highest manifest, or of manifest ``number``; None without any."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    if number is not None and number not in numbers:
        raise FileNotFoundError(f"no manifest {number} in {root}")
    path = os.path.join(root, "manifests", str(numbers[-1] if number is None else number))
    found = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
    return os.path.join(root, "versions", found["version"]), found["tables"]


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete the versions before the last ``keep`` published ones, manifest first; their numbers.
    Folders that were never published are left alone: a builder may be writing them."""
    if keep < 1:
        raise ValueError("the last version stays")
    old = _numbers(spark, root)[:-keep]
    still = {published(spark, root, n)[0] for n in _numbers(spark, root)[-keep:]}
    for n in old:
        folder, _ = published(spark, root, n)
        fs, manifest = _fs(spark, os.path.join(root, "manifests", str(n)))
        fs.delete(manifest, False)
        if folder not in still:
            fs.delete(_fs(spark, folder)[1], True)
    return old


@dataclass(frozen=True)
class StoreCatalog:
    """SRC-8 ``index_scan``: which tables a store has, and the search tier they
    allow (IVF-PQ, then embeddings, then MinHash, else exact key only). ``root`` is the
    folder of the opened version: what was opened stays readable while others build."""

    root: str
    has_ivf: bool
    has_embeddings: bool
    has_minhash: bool
    has_idf: bool = False

    @classmethod
    def open(cls, spark: SparkSession, root: str, number: int | None = None) -> "StoreCatalog":
        """The last published version of ``root``, or that of manifest ``number``; without manifests the root itself."""
        found = published(spark, root, number)
        if found is None:
            return cls(root, *(_exists(spark, os.path.join(root, t)) for t in (os.path.join("ivf", "lists"), "embeddings", "minhash", "idf")))
        folder, tables = found
        return cls(folder, *(t in tables for t in ("ivf", "embeddings", "minhash", "idf")))

    def index(self, spark: SparkSession):
        """The stored IVF-PQ index."""
        from tessera.operators.ivfpq import read_index
        return read_index(spark, self.root)

    @property
    def tier(self) -> str:
        if self.has_ivf:
            return "ivf"
        if self.has_embeddings:
            return "cosine"
        if self.has_minhash:
            return "minhash"
        return "exact"


__all__ = ["RECORD_FIELDS", "StoreCatalog", "drop_versions", "keyed_records", "keyed_records_kv", "key_bucket", "lookup",
           "new_version", "open_bucketed", "publish", "published", "read_records", "store_stats", "write_bucketed", "write_embeddings", "write_records", "write_table"]
