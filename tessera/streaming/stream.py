"""Structured Streaming re-aims (STM-1, STM-2).

The reference has no stream engine; requests arrive one by one. Here a stream
of query files is answered micro-batch by micro-batch against a static corpus
(stateless: no watermark is needed, a late row is an ordinary row), new
records are appended to the corpus with an idempotent per-batch folder and folded
by a compaction job, and turns of conversations keep their last messages in keyed state.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.config import RetrievalConfig
from tessera.operators.encode import encode
from tessera.operators.minhash import with_signatures
from tessera.plans.answer import answer, retrieve_text
from tessera.session import ensure_checkpoint_dir
from tessera.sources.store import _fs, publish, published

QUERY_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query", T.StringType())])


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def stream_answer(spark: SparkSession, source_dir: str, records: DataFrame, sink_dir: str, *,
                  cfg: RetrievalConfig = RetrievalConfig(), fmt: str = "parquet",
                  checkpoint: str | None = None, name: str = "answers",
                  max_files_per_trigger: int | None = None, vectors: DataFrame | None = None,
                  encoder: Callable[[DataFrame, str, str], DataFrame] = encode) -> StreamingQuery:
    """STM-1: ``readStream`` over files of ``(query_id, query)`` -> PIP-1 + PIP-2 on
    each micro-batch -> Parquet under ``sink_dir/batch_id=<id>``. A replayed batch
    overwrites its own folder, so the sink is exactly-once with the checkpoint. With the
    stored ``vectors(ord, embedding)`` of the records a batch encodes its queries only."""
    reader = spark.readStream.schema(QUERY_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        frags = retrieve_text(batch, records, cfg, vectors=vectors, encoder=encoder)
        ans = answer(batch, frags, cfg)
        ans.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint or _ckpt(spark, name))
            .start())


def stream_corpus_upsert(spark: SparkSession, source_dir: str, store_dir: str, schema: T.StructType, *,
                         key: str = "key", text: str = "text", fmt: str = "parquet", checkpoint: str | None = None,
                         name: str = "upserts", encoder: Callable[[DataFrame, str, str], DataFrame] = encode) -> StreamingQuery:
    """STM-2: append new records to ``store_dir/records/batch_id=<id>``, their vectors to
    ``embeddings`` and their MinHash signatures to ``minhash`` beside it, each batch in its own
    folder (idempotent on replay). Records without ``ord`` are numbered as they come. ``latest_records``
    reads any of the three, ``compact_store`` folds the batches."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if "ord" not in batch.columns:                     # the order of arrival
            batch = batch.withColumn("ord", F.monotonically_increasing_id())
        batch = batch.persist()
        parts = {"records": batch,
                 "embeddings": encoder(batch.select(key, "ord", text), text, "embedding").select(key, "ord", "embedding"),
                 "minhash": with_signatures(batch.select(key, "ord", text), text).select(key, "ord", "sig")}
        for part, rows in parts.items():
            rows.write.mode("overwrite").parquet(os.path.join(store_dir, part, f"batch_id={batch_id}"))
        batch.unpersist()

    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint or _ckpt(spark, name))
            .start())


TURN_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_LAST = "conv_id long, user_text string, system_text string"
_LAST_STATE = "user_turn long, user_text string, system_turn long, system_text string"


def _keep_last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One conversation's last user and system message by turn, over what earlier batches left in ``state``."""
    now = list(state.get) if state.exists else [None] * 4
    for b in batches:
        for turn, role, text in zip(b["turn"], b["role"], b["text"]):
            said = text.strip() if isinstance(text, str) else ""
            at = {"user": 0, "system": 2}.get(role)
            if at is not None and said and not pd.isna(turn) and (now[at] is None or turn >= now[at]):
                now[at:at + 2] = [int(turn), said]
    state.update(tuple(now))
    yield pd.DataFrame({"conv_id": [key[0]], "user_text": [now[1]], "system_text": [now[3]]}).astype(
        {"conv_id": "Int64", "user_text": object, "system_text": object})


def last_message_stream(turns: DataFrame) -> DataFrame:
    """AGG-4 on a stream of turns (TURN_SCHEMA): per conversation with new turns a row (conv_id, user_text,
    system_text) with its last non-blank user and system messages so far, as ``last_messages`` gives them
    of all turns at once. The state of a conversation is four values; turns may come late or out of order."""
    return turns.groupBy("conv_id").applyInPandasWithState(_keep_last, _LAST, _LAST_STATE, "update", GroupStateTimeout.NoTimeout)


def stream_last_messages(spark: SparkSession, source_dir: str, sink_dir: str, *, fmt: str = "parquet", checkpoint: str | None = None,
                         name: str = "last-messages", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """``last_message_stream`` over files of turns -> Parquet under ``sink_dir/batch_id=<id>``: the changed
    conversations of each batch. ``current_messages`` reads the last state of all."""
    reader = spark.readStream.schema(TURN_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))
    return (last_message_stream(reader.load(source_dir)).writeStream.outputMode("update").foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint or _ckpt(spark, name)).start())


def current_messages(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(conv_id, user_text, system_text): the latest row of each conversation of ``stream_last_messages``."""
    rows = spark.read.parquet(sink_dir)
    last = rows.groupBy("conv_id").agg(F.max("batch_id").alias("at"))
    mine = rows.join(last, rows["conv_id"].eqNullSafe(last["conv_id"]) & (rows["batch_id"] == last["at"]), "left_semi")
    return mine.select("conv_id", "user_text", "system_text")


def _batches(spark: SparkSession, folder: str, after: int) -> list[str]:
    """The folders of the batches after number ``after``."""
    fs, at = _fs(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    ids = sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))
    return [os.path.join(folder, f"batch_id={i}") for i in ids if i > after]


def _generation(spark: SparkSession, root: str) -> tuple[str | None, int]:
    """(folder, last batch folded) of the store's published generation; (None, -1) without one."""
    found = published(spark, root)
    return (None, -1) if found is None else (found[0], int(os.path.basename(found[0]).split("-")[0]))


def _last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by (batch_id, ``order``): the winners are found on narrow columns, then
    joined back. Of rows that are equal in these one stays."""
    place = F.struct(F.col("batch_id"), F.col(order) if order in df.columns else F.lit(0))
    named = df.withColumn("__at", place)
    last = named.groupBy(key).agg(F.max("__at").alias("__at"))
    return named.join(last, [key, "__at"], "left_semi").drop("__at").dropDuplicates([key])


def latest_records(spark: SparkSession, store_dir: str, key: str = "key", order: str = "ord") -> DataFrame:
    """Read one table of the upserted store (``<store>/records``, ``embeddings`` or ``minhash``): the latest row per key
    (highest batch, then ``order``, where there is one). After ``compact_store`` the folded batches are read
    as one generation of one row per key, and only batches after it beside it."""
    root, part = os.path.split(store_dir.rstrip("/"))
    folder, through = _generation(spark, root)
    newer = _batches(spark, store_dir, through)
    parts = [spark.read.option("basePath", store_dir).parquet(*newer)] if newer else []
    if folder is not None:
        old = spark.read.parquet(os.path.join(folder, part))
        if not parts:
            return old
        parts.append(old)
    if not parts:
        raise FileNotFoundError(f"no batches in {store_dir}")
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return _last_rows(whole, key, order)


def compact_store(spark: SparkSession, root: str, key: str = "key", order: str = "ord") -> int:
    """STM-2 merge: fold the generation of the upserted store ``root`` and all batches after it into a new
    generation with one row per key for each table, and publish it; the last batch it holds (-1: nothing
    to fold). Readers of the generation before go on; a replayed batch that is folded already is not
    read again; a job that fails half-way leaves the generation before in place."""
    _, through = _generation(spark, root)
    newest = [int(b.rsplit("=", 1)[1]) for b in _batches(spark, os.path.join(root, "records"), through)]
    if not newest:
        return through
    to = os.path.join(root, "versions", f"{max(newest)}-{uuid.uuid4().hex}")
    for part in ("records", "embeddings", "minhash"):
        if _batches(spark, os.path.join(root, part), -1):
            latest_records(spark, os.path.join(root, part), key, order).where(F.col("batch_id") <= max(newest)).write.parquet(os.path.join(to, part))
    publish(spark, root, to)
    return max(newest)
