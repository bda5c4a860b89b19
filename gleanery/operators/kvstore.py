"""Keyed store semantics on tables of (gid, key, value): later entries win by sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.hashing import content_id


def default_key(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Entries without a key get the content hash of their value."""
    return df.withColumn(key, F.coalesce(F.col(key), content_id(F.col(value))))


def latest(log: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last row of each key of a log: puts over puts, and deletes, which stay as rows."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def state(log: DataFrame) -> DataFrame:
    """Entries after replaying ``put`` and ``del`` operations (``seq``, ``op``, ``gid``, ``key``, ``value``)."""
    writes = log.where(F.col("op").isin("put", "del"))
    return latest(writes, "gid", "key").where("op = 'put'").select("gid", "key", "value")


def get(entries: DataFrame, gid: str, key: str) -> DataFrame:
    return entries.where((F.col("gid") == gid) & (F.col("key") == key))


def list_keys(entries: DataFrame, gid: str) -> DataFrame:
    """Distinct keys of a group, without system files."""
    return entries.where((F.col("gid") == gid) & ~F.contains("key", F.lit(".DS_Store"))).select("key").distinct()


def delete(entries: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed) of deleting the (gid, key) pairs of ``victims``."""
    pairs = victims.select("gid", "key").distinct()
    return entries.join(pairs, ["gid", "key"], "left_anti"), entries.join(pairs, ["gid", "key"], "left_semi")


def append(log: DataFrame) -> DataFrame:
    """Values appended to each field of each entry, in order of ``seq``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    return log.where("op = 'append'").groupBy("gid", "key", "field").agg(ordered.alias("values"))


def upsert_postings(index: DataFrame, batch: DataFrame, order: str = "ts") -> DataFrame:
    """Merge postings (``term``, ``url``, ..., ``ts``): the newest of a (term, url) wins, ``df`` is counted anew.

    Idempotent: merging the same batch again changes nothing.
    """
    columns = [c for c in index.columns if c != "df"]
    merged = latest(index.select(*columns).unionByName(batch.select(*columns)), "term", "url", order=order)
    return merged.join(merged.groupBy("term").agg(F.count("*").alias("df")), "term")  # counts combine before they are shuffled


def upsert_documents(index: DataFrame, batch: DataFrame) -> DataFrame:
    """``upsert_postings`` of an index that lies by document: ``url`` and ``postings``, an array of (``term``, ``ts``, ...).

    Postings meet those of their own url only, so a document's are shuffled as one row and merged inside it.
    """
    both = index.unionByName(batch).repartition("url").groupBy("url").agg(F.collect_list("postings").alias("_v"))
    held = both.select("url", F.when(F.size("_v") > 1, F.sort_array(F.flatten("_v"), asc=False)).otherwise(F.get("_v", F.lit(0))).alias("_p"))
    new = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: (i == 0) | ~F.get("_p", i)["term"].eqNullSafe(F.get("_p", i - 1)["term"]))
    newest = held.select("url", "_p", F.when(F.size("_p") > 0, new).alias("_at"))
    return newest.select("url", F.when(F.size("_at") < F.size("_p"), F.transform("_at", lambda i: F.get("_p", i))).otherwise(F.col("_p")).alias("postings"))


def moved_keys(placed_before: DataFrame, placed_after: DataFrame) -> DataFrame:
    """Keys that change their node with the membership: ``key``, ``before``, ``after``."""
    both = placed_before.select("key", F.col("node").alias("before")).join(placed_after.select("key", F.col("node").alias("after")), "key")
    return both.where("before <> after")


def members(log: DataFrame) -> DataFrame:
    """Nodes (``gid``, ``ip``, ``port``) of each group after ``put``, ``add``, ``rem`` and ``del`` (of a whole group) operations in order."""
    ended = log.where("op = 'del'").groupBy("gid").agg(F.max("seq").alias("_end"))
    since = log.where("op <> 'del'").join(ended, "gid", "left").where("_end is null or seq > _end").drop("_end")
    return latest(since, "gid", "ip", "port").where("op <> 'rem'").select("gid", "ip", "port")


def group(log: DataFrame, gid: str) -> DataFrame:
    """The nodes of one group; none for a group that is not there."""
    return members(log.where(F.col("gid") == gid)).select("ip", "port")
