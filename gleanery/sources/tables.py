"""Table sources and sinks: explicit schemas, sharded index tables, n-gram text files, record decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "url string, binomial_name string, hierarchy array<struct<label: string, value: string>>, article_words array<string>"
RECORD = "url string, binomial_name string, hierarchy array<struct<label: string, value: string>>, word_counts map<string, bigint>"
LOCAL_INDEX = "term string, url string, freq bigint"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than cores (a small file of one row group) out to all of them.

    Scans with enough splits, so all large ones, stay as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def decode_articles(raw: DataFrame, column: str = "raw", schema: str = ARTICLE) -> DataFrame:
    """Articles from JSON, or from JSON wrapped once more as ``{"type": "string", "value": "..."}``; others are left out."""
    plain, wrapped = F.from_json(column, schema), F.from_json(F.get_json_object(column, "$.value"), schema)
    article = F.when(plain["url"].isNotNull(), plain).when((F.get_json_object(column, "$.type") == "string") & wrapped["url"].isNotNull(), wrapped)
    return raw.select(article.alias("a")).where("a is not null").select("a.*")


def publish(index: DataFrame, path: str, shard: str = "shard") -> None:
    """Write an index table partitioned by shard, so that a look-up reads one folder.

    Rows of a shard meet (``REBALANCE`` splits large shards), so few files are written.
    """
    index.hint("rebalance", shard).write.mode("overwrite").partitionBy(shard).parquet(path)


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add one batch's result; writing the same batch again replaces it."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def append_snapshot(rows: DataFrame, path: str, at: str) -> None:
    """Add a snapshot of metrics or metadata, taken ``at`` a time, as JSON lines; taking it again replaces it."""
    rows.withColumn("at", F.lit(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("at").json(path)


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All snapshots under ``path``, with the time of each as ``at``."""
    return spark.read.schema(f"{schema}, at string").json(path)


def commit_batches(spark: SparkSession, path: str, batch_ids: list[int]) -> None:
    """Name batches as complete in the manifest beside ``path``; naming one again changes nothing."""
    new = sorted(set(batch_ids) - set(committed(spark, path) or []))
    if new:
        spark.range(1).select(F.explode(F.array(*(F.lit(b).cast("bigint") for b in new))).alias("batch_id")).coalesce(1).write.mode("append").json(f"{path}-manifest")


def committed(spark: SparkSession, path: str) -> list[int] | None:
    """Batches that the manifest names; None where there is no manifest."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-manifest")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return sorted(r["batch_id"] for r in spark.read.schema("batch_id bigint").json(f"{path}-manifest").distinct().collect())


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches that the manifest names, or all there are where it names none: other folders are not opened."""
    rows, named = spark.read.parquet(path), committed(spark, path)
    return rows.where(F.col("batch_id").isin(named)) if named else rows


def run_batches(spark: SparkSession, batches: dict[int, DataFrame], process: Callable[[DataFrame], DataFrame], path: str, most: int | None = None) -> list[int]:
    """Process, write and commit each batch that is not committed yet, at most ``most`` of them: a loop that stops and resumes."""
    done = set(committed(spark, path) or [])
    todo = [b for b in sorted(batches) if b not in done][:most]
    for batch_id in todo:
        append_batch(process(batches[batch_id]), path, batch_id)
        commit_batches(spark, path, [batch_id])
    return todo


def redistribute(source: DataFrame, key: str, parts: int) -> DataFrame:
    """Deal entries out anew by key: write the result (``publish``, ``append_batch``) to keep the new places."""
    return source.repartition(parts, key)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text line a row, in term order."""
    lines.orderBy("line").write.mode("overwrite").text(path)
