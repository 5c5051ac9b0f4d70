"""Corpus scans and record projections (SRC-1/2/7, PRJ-1..7, JSN-1/2, FLT-5)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import RetrievalConfig
from tessera.sources.arrays import array_records

RECORD_FIELDS = ("id", "lemma", "term", "title", "name", "content", "text", "definition")

RECORD_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in RECORD_FIELDS])
#: What a parsed record holds: the known fields, and every other field as JSON text.
PARSED_FIELDS = (*RECORD_FIELDS, "extra")
EXTRA_TYPE = "map<string,string>"


def json_corpus_scan(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: read a JSON array of records: the known fields as strings, all others in
    ``extra`` (name -> the value as JSON text; a null value is left out).

    Missing path -> ``FileNotFoundError``; a top level that is not an array, or an array that
    does not end -> ``ValueError``. One file is read by as many tasks as it has byte ranges
    (``arrays``). ``ord`` is the array position."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"no corpus at {path}")
    rows = array_records(spark, path).select("ord", parse_record_or_wrap("raw").alias("r"))
    return rows.select("ord", *[F.col(f"r.{f}").alias(f) for f in PARSED_FIELDS])


def columnar_corpus_scan(spark: SparkSession, path: str, fmt: str = "parquet",
                         fields: tuple[str, ...] = ("lemma", "definition")) -> DataFrame:
    """SRC-2: read records with ``lemma``/``definition`` from a columnar file."""
    return with_ordinal(spark.read.format(fmt).load(path).select(*fields))


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """SRC-7: dense 0-based ordinal in read order, JVM-side and without a
    single-partition window: row position inside its partition plus the row
    count of all earlier partitions (a table with one row per partition, joined
    back by broadcast). ``df`` must be deterministic (a scan), as it is read twice."""
    tagged = (df.withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    per_part = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return (tagged.join(F.broadcast(offsets.select("__pid", "__off", "__m0")), "__pid")
            .withColumn(name, (F.col("__mid") - F.col("__m0") + F.col("__off")).cast("bigint"))
            .drop("__pid", "__mid", "__off", "__m0"))


def as_corpus(df: DataFrame, mapping: Mapping[str, str], ord_col: str) -> DataFrame:
    """Map a table's columns onto the record fields; absent fields are null.
    E.g. ``part``: ``{"id": "p_partkey", "lemma": "p_name", "definition": "p_type"}``."""
    cols = [F.col(ord_col).cast("bigint").alias("ord")]
    for f in RECORD_FIELDS:
        src = mapping.get(f)
        cols.append((F.col(src).cast("string") if src else F.lit(None).cast("string")).alias(f))
    return df.select(*cols, F.create_map().cast(EXTRA_TYPE).alias("extra"))


def _truthy(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def record_to_text(cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    """PRJ-1: join the non-empty recognised fields in fixed order with ``": "``;
    with none, the record as JSON (the reference prints a Python dict instead)."""
    parts = [_truthy(F.col(f)) for f in cfg.text_fields]
    joined = F.concat_ws(": ", *parts)
    return F.when(joined != "", joined).otherwise(to_json_record())


def record_key(fill_missing: bool = False, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    """PRJ-2: ``lemma`` or ``id`` or ``term``. Blank gives null (FLT-5 drops it) or,
    with ``fill_missing``, ``rec_{ord}`` as the embedding cache does."""
    key = F.coalesce(*[_truthy(F.col(f)) for f in cfg.key_fields])
    if fill_missing:
        key = F.coalesce(key, F.concat(F.lit("rec_"), F.col("ord").cast("string")))
    return key


def drop_blank_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """FLT-5."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def cache_embedding_text() -> Column:
    """PRJ-3: ``"{lemma}. {definition or text}"`` (absent -> empty)."""
    return F.concat(F.coalesce(F.col("lemma"), F.lit("")), F.lit(". "),
                    F.coalesce(F.col("definition"), F.col("text"), F.lit("")))


def minhash_text() -> Column:
    """PRJ-4: ``lemma + " " + definition + " " + text``, absent -> empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in ("lemma", "definition", "text")])


def source_id() -> Column:
    """PRJ-6: ``str(id)``, or the row position when there is no id."""
    return F.coalesce(F.col("id"), F.col("ord").cast("string"))


def fragment_preview(text: str = "text", score: str = "score", width: int = 60) -> Column:
    """PRJ-7: score to 3 decimals and the first ``width`` characters."""
    return F.format_string("Fragment(score=%.3f, text=%s)", F.col(score), F.substring(F.col(text), 1, width))


def to_json_record() -> Column:
    """JSN-1: the record's non-null known fields and its ``extra`` fields as one JSON object
    (non-ASCII kept, values of extra fields with their JSON types)."""
    known = F.to_json(F.struct(*[F.col(f) for f in RECORD_FIELDS]))
    named = F.transform(F.map_entries("extra"), lambda e: F.concat(
        F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    more = F.array_join(named, ",")
    comma = F.when(known != "{}", F.lit(",")).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size("extra") > 0, F.lit(False)),
                  F.concat(F.substring(known, 1, F.length(known) - 1), comma, more, F.lit("}"))).otherwise(known)


def parse_record_or_wrap(raw: str = "value") -> Column:
    """PRJ-5 / JSN-2: parse a stored JSON record into PARSED_FIELDS; anything that is not a
    JSON object becomes ``{"text": raw}``."""
    known = ", ".join(f"'{f}'" for f in RECORD_FIELDS)
    parsed = F.from_json(F.col(raw), RECORD_SCHEMA)
    extra = F.expr(f"""transform_values(map_filter(try_variant_get(try_parse_json(`{raw}`), '$', 'map<string,variant>'),
        (k, v) -> k NOT IN ({known}) AND NOT is_variant_null(v)), (k, v) -> to_json(v))""")
    whole = F.struct(*[parsed[f].alias(f) for f in RECORD_FIELDS], extra.cast(EXTRA_TYPE).alias("extra"))
    is_obj = F.try_parse_json(F.col(raw)).isNotNull() & F.trim(F.col(raw)).startswith("{")
    wrapped = F.struct(*[(F.col(raw) if f == "text" else F.lit(None).cast("string")).alias(f) for f in RECORD_FIELDS],
                       F.create_map().cast(EXTRA_TYPE).alias("extra"))
    return F.when(is_obj, whole).otherwise(wrapped)
