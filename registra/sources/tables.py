"""Clean records and the vector table as Parquet files or catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.session import remove, shared_dir

KEY = "registration_number"


def write_clean(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write Parquet. Partitioned by year, a year filter reads the files of that year only."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from files in the shared folder.

    For a frame that a plan uses many times: it is worked out once, its size is known to the
    planner, and a lost executor costs no recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``written`` returned, once nothing reads them any more."""
    for df in frames:
        remove(df.sparkSession, df.work_path)


def load_table(df: DataFrame, name: str, path: str | None = None, buckets: int = 0) -> int:
    """Replace table ``name`` with ``df`` and return its row count.

    ``path`` makes the table external. Tables with the same number of ``buckets`` join on the key
    without a shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    if buckets:
        writer = writer.bucketBy(buckets, KEY).sortBy(KEY)
    writer.saveAsTable(name)
    return df.sparkSession.table(name).count()


def table_ready(spark: SparkSession, name: str) -> bool:
    """True when the table exists and holds at least one row."""
    return spark.catalog.tableExists(name) and not spark.table(name).isEmpty()


def vector_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField(KEY, T.StringType(), False),
            T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
            T.StructField("source_text", T.StringType(), True),
        ]
    )


def empty_vector_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], vector_schema())


def check_vector_table(store: DataFrame, dim: int) -> DataFrame:
    """One row of counts: rows, null keys, keys that occur again, vectors of another length."""
    per_key = store.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("bad"),
    )
    zero = F.lit(0).cast("bigint")
    return per_key.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col(KEY).isNull(), F.col("n"))), zero).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col(KEY).isNotNull(), F.col("n") - 1)), zero).alias("duplicates"),
        F.coalesce(F.sum("bad"), zero).alias("wrong_length"),
    )
