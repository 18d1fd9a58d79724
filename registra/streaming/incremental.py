"""Incremental encoding: each run encodes only records that have no vector yet.

The registry is loaded in bounded batches, so this is a batch job that can be run again at any
time. A run that stops half way leaves nothing behind: its files are committed at the end, and the
next run finds the same records pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.operators.changes import pending
from registra.operators.retrieval import Encoder, embed_texts, source_texts
from registra.session import exists
from registra.sources.tables import KEY, empty_vector_table, vector_schema


def embed_incremental(
    projects: DataFrame, store_path: str, make_encoder: Callable[[], Encoder]
) -> DataFrame:
    """Append vectors of pending records to the store and return counts before and after.

    The first run creates the store.
    Only records without a vector are encoded, and each key once, so appending is an upsert. With
    nothing pending no encoder is made.
    """
    spark = projects.sparkSession
    if not exists(spark, store_path):
        empty_vector_table(spark).write.parquet(store_path)
    store = spark.read.schema(vector_schema()).parquet(store_path)
    before = store.count()
    todo = (
        pending(source_texts(projects), store)
        .groupBy(KEY)
        .agg(F.max("source_text").alias("source_text"))
    )
    vectors = embed_texts(todo, make_encoder).select(KEY, "embedding", "source_text")
    vectors.write.mode("append").parquet(store_path)
    after = spark.read.schema(vector_schema()).parquet(store_path)
    return after.agg(
        F.lit(before).cast("bigint").alias("before"), F.count(F.lit(1)).alias("after")
    )
