"""All queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parleylake.plans import chat, decoded, decoding, functions, shaping

QUERIES = {**chat.QUERIES, **decoding.QUERIES, **decoded.QUERIES, **functions.QUERIES, **shaping.QUERIES}
SQL = {**chat.SQL, **decoding.SQL, **decoded.SQL, **functions.SQL, **shaping.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The list of all conversations with labels and last times."""
    return chat.conversation_list(spark, d)
