"""A training corpus from the documents table: reject, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and its result is
written as Parquet in the shared folder and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.llm import bitsets, decontam, mixing, simhash, substrings, toxicity
from registra.llm.queries import remainder, table
from registra.sources.tables import written

#: What the last stage adds.
MIXED = ("size", "source_size", "target", "taken")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay."""
    rows = toxicity.scored(docs, table(spark, sf_dir, "labels"), remainder("__id") != 2)
    return rows.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document only; no document goes."""
    rows = substrings.remove_repeats(docs)
    lost = F.col("__cut.n_removed") > 0
    text = F.when(lost, F.col("__cut.kept")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("__cut.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    found = decontam.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    rows = written(found.select(F.col("doc_id").alias("id"), "tk").distinct(), "leaks")
    return bitsets.without(docs, rows, "doc_id", "text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with how many of its words the mix takes, repeats counted.

    ``size``, ``source_size``, ``target`` and ``taken`` are added; they replace columns of that name. A
    document is named by the hash of its whole row, so null and repeated ids keep their texts; of equal
    rows one text is shuffled.
    """
    hashed = [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]  # maps have no hash
    named = docs.select(
        F.xxhash64(*hashed).alias("id"), mixing.word_count("text").alias("size"), "source", F.struct(*docs.columns).alias("row")
    )
    mixed = mixing.mix(named.select("id", "size", "source"))
    texts = named.groupBy("id", "size").agg(F.first("row").alias("row"))
    kept = [F.col(f"row.{c}").alias(c) for c in docs.columns if c not in MIXED]
    return mixed.join(texts, ["id", "size"]).select(*kept, *MIXED)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]

#: Scores, fingerprints and dependent rounding have no counterpart in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
