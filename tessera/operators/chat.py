"""Conversation operators: AGG-4 last message by role, FLT-6 role filter,
AGG-5 token usage, PIP-4 response chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import py_strip, whitespace_token_count


def last_messages(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """AGG-4 + FLT-6: per conversation, the last non-blank ``user`` message and
    the last non-blank ``system`` message (stripped), in one aggregation."""
    t = py_strip(F.col(text))
    c = conversations.select(conv, turn, role, t.alias("__t"))
    return c.groupBy(conv).agg(
        F.max_by(F.when((F.col(role) == "user") & (F.col("__t") != ""), F.struct(F.col(turn), F.col("__t"))),
                 F.when((F.col(role) == "user") & (F.col("__t") != ""), F.col(turn))).alias("__u"),
        F.max_by(F.when((F.col(role) == "system") & (F.col("__t") != ""), F.struct(F.col(turn), F.col("__t"))),
                 F.when((F.col(role) == "system") & (F.col("__t") != ""), F.col(turn))).alias("__s"),
    ).select(conv, F.col("__u.__t").alias("user_text"), F.col("__s.__t").alias("system_text"))


def token_usage(df: DataFrame, *, prompt: str = "query", completion: str = "response") -> DataFrame:
    """AGG-5: whitespace token counts (``len(s.split())``) and their sum."""
    p = whitespace_token_count(F.col(prompt))
    c = whitespace_token_count(F.col(completion))
    return (df.withColumn("prompt_tokens", p).withColumn("completion_tokens", c)
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))


def chunk_response(df: DataFrame, *, key: str = "query_id", response: str = "response") -> DataFrame:
    """PIP-4: a response cut on single spaces into ordered chunks (a trailing
    space on all but the last), followed by one ``stop`` row per response.
    One pass: the stop row is an extra null element of the exploded array."""
    # split and size sit below the explode: once per response, not once per word
    cut = df.select(key, F.split(F.col(response), " ").alias("__w")).select(key, "__w", F.size("__w").alias("__n"))
    listed = cut.select(key, "__n", F.posexplode(F.concat("__w", F.array(F.lit(None).cast("string")))).alias("seq", "__c"))
    stop = F.col("seq") == F.col("__n")
    return listed.select(key, "seq", F.when(F.col("seq") < F.col("__n") - 1, F.concat("__c", F.lit(" "))).otherwise(F.col("__c")).alias("content"),
                         F.when(stop, F.lit("stop")).otherwise(F.lit(None).cast("string")).alias("finish_reason"))
