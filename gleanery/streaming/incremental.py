"""Incremental index maintenance with Structured Streaming: micro-batches upsert into an index table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.text import terms
from gleanery.operators.kvstore import upsert_postings
from gleanery.operators.rowwise import by_repetition, count_arrays, explode_computed

POSTING = "term string, url string, tf double, ts timestamp"


def batch_documents(docs: DataFrame) -> DataFrame:
    """``url`` and ``postings`` (``term``, ``ts``, ``tf``) of a batch of ``url``, ``text``, ``ts`` (the latest text of a url counts)."""
    single, several = by_repetition(docs.select("url", "text", "ts").where("url is not null and ts is not null"), "url")
    newest = single.unionByName(several.groupBy("url").agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts")))
    words = newest.select("url", "ts", terms(F.col("text")).alias("terms"))
    counts = count_arrays(words.select("url", "ts", F.size("terms").alias("total"), "terms"), "terms", "term", "count")
    item = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), F.col("ts").alias("ts"), (t["count"] / F.col("total")).alias("tf")))
    return counts.select("url", item.alias("postings"))


def batch_postings(docs: DataFrame) -> DataFrame:
    """``batch_documents`` as a row for each posting."""
    return explode_computed(batch_documents(docs), "postings").select("_p.term", "url", "_p.tf", "_p.ts")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the index under ``path``."""
    versions = sorted(_versions(spark, path))
    if not versions:
        return spark.createDataFrame([], POSTING)
    return spark.read.schema(POSTING).parquet(f"{path}/version={versions[-1]}")


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm  # the Hadoop file system reads whatever store the path names
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop, jvm


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, hadoop, jvm = _folder(spark, path)
    if not fs.exists(hadoop):
        return []
    names = [s.getPath() for s in fs.listStatus(hadoop)]
    return [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def merge_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write version ``batch_id`` from the version before it; a repeated batch gives the same version.

    The version before stays for readers and for a repeated batch; older ones go.
    """
    spark = batch.sparkSession
    before = [v for v in _versions(spark, path) if v < batch_id]
    index = spark.read.schema(POSTING).parquet(f"{path}/version={max(before)}") if before else spark.createDataFrame([], POSTING)
    new = batch_postings(batch)
    kept = index.join(new.select("url").distinct(), "url", "left_anti").unionByName(index.join(new.groupBy("url").agg(F.max("ts").alias("newest")), "url").where("ts > newest").drop("newest"))
    upsert_postings(kept, new).drop("df").write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    fs, _, jvm = _folder(spark, path)
    for old in sorted(before)[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)


def document_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of ``url``, ``text``, ``ts`` from the JSON files that arrive under ``path``; at most ``files_per_batch`` of them a batch, so a backlog is worked off in portions."""
    reader = spark.readStream.schema("url string, text string, ts timestamp")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def index_stream(docs: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Start a query over a stream of ``url``, ``text``, ``ts``; it resumes from its checkpoint.

    It takes all there is and stops; with an ``interval`` (such as ``"2 seconds"``) it goes on with a batch each.
    """
    writer = docs.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, n, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def event_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts of events by type and time window, with a watermark for late rows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
