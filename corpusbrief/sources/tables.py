"""Table forms of the corpus and of the job history."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = (
    "id long, user_id string, repository_url string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, lang string, size string, technicality string, status string, "
    "summary string, error string"
)


def files_from_table(df: DataFrame, repo: str, path: str, content: str, size: str | None = None) -> DataFrame:
    """Any table with one row per file as ``files(repo_id, path, size, content)``.

    Without a size column the size is the byte length of the content.
    """
    bytes_ = F.col(size) if size else F.octet_length(F.col(content))
    return df.select(
        F.col(repo).alias("repo_id"), F.col(path).alias("path"), bytes_.cast("long").alias("size"),
        F.col(content).alias("content"),
    )


FILE_BUCKETS = 256
BUCKET = "repo_bucket"


def repo_bucket(repo: Column, buckets: int = FILE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(buckets)).cast("int")


def store_files(files: DataFrame, path: str, buckets: int = FILE_BUCKETS) -> None:
    """Write a files table partitioned by a hash of its repository, sorted by repository within.

    A reader that knows its repositories opens only their buckets. Spark sizes the tasks: it merges small buckets
    and splits large ones, so no task gets a big one whole.
    """
    bucketed = files.withColumn(BUCKET, repo_bucket(F.col("repo_id"), buckets))
    dealt = bucketed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "repo_id")
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def files_of(files: DataFrame, repos: DataFrame, buckets: int = FILE_BUCKETS) -> DataFrame:
    """The files of ``repos(repo_id)``; a table of :func:`store_files` is read only in their buckets.

    The buckets come from the wanted repositories while the query runs: as part of the join key they give Spark a
    dynamic partition filter, whose values are those of the join's other side. Spark plans one where that side holds
    a selective predicate, so the buckets' range is spelled out, and is small enough to be broadcast.
    """
    if BUCKET not in files.columns:
        return files.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    wanted = repos.select("repo_id", repo_bucket(F.col("repo_id"), buckets).alias(BUCKET)).distinct()
    wanted = wanted.where(F.col(BUCKET).between(0, buckets - 1))
    return files.join(wanted, [BUCKET, "repo_id"], "left_semi").drop(BUCKET)


def readable(files: DataFrame) -> DataFrame:
    """Files that could be read; the others are reported, not fatal."""
    if "read_error" not in files.columns:
        return files
    return files.where(F.col("read_error").isNull()).drop("read_error")


def read_errors(files: DataFrame) -> DataFrame:
    return files.where(F.col("read_error").isNotNull()).select("repo_id", "path", "read_error")


def append_jobs(jobs: DataFrame, path: str | None = None, fmt: str = "parquet", **options: str) -> None:
    """Append to the history table, in its column order; sorted so that reads by user skip row groups.

    A database table is the same call with ``fmt="jdbc"`` and its options instead of a path.
    """
    columns = [part.split()[0] for part in HISTORY_SCHEMA.split(", ")]
    ordered = jobs.select(*columns).sortWithinPartitions("user_id", "id")
    ordered.write.mode("append").format(fmt).options(**options).save(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def store_bucketed(df: DataFrame, path: str, key: str = "id", buckets: int = 64) -> DataFrame:
    """Write a table bucketed and sorted by ``key`` and read it back as such, a file for each bucket.

    Joins of two such tables on the key need no exchange, and an equality on the key opens one bucket. Take
    ``buckets`` by size, so that a bucket is a task's share. Only a catalog tells Spark of buckets, so the table has a
    name there for as long as it takes to look it up; its files stay at ``path``.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    try:
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
