"""Content hashes and the placement of keys on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """SHA-256 (hex) of a string as JSON: quoted, with its special characters escaped."""
    return F.sha2(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), '^\\{"v":(.*)\\}$', 1), 256)


def node_id(ip: Column, port: Column) -> Column:
    return F.sha2(F.to_json(F.struct(ip.alias("ip"), port.alias("port"))), 256)


def short_id(nid: Column) -> Column:
    return F.substring(nid, 1, 5)


def message_id(date: Column, message: Column) -> Column:
    """Id of a message at a given time."""
    return F.sha2(F.to_json(F.struct(date.alias("date"), message.alias("mss"))), 256)


def hex_mod(digest: Column, n: Column | int) -> Column:
    """A 256-bit hex number modulo ``n``, in four 64-bit portions (decimal, so nothing overflows)."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("decimal(20,0)")
    rest = F.lit(0).cast("decimal(20,0)")
    base = (F.lit("18446744073709551616").cast("decimal(20,0)")) % n
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") % n
        rest = ((rest.cast("decimal(18,0)") * base.cast("decimal(18,0)") + part.cast("decimal(18,0)")) % n).cast("decimal(20,0)")
    return rest.cast("bigint")


def prefix_mod(digest: Column, n: int) -> Column:
    """The first 32 bits modulo ``n``: the placement of discovered links."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n


def placements(keys: DataFrame, nodes: DataFrame, key_col: str = "key") -> DataFrame:
    """``key``, ``kid`` and the node id that each of the three schemes picks.

    Nodes (``ip``, ``port``) are a cluster's membership: they become one small sorted array on every row.
    """
    ring = nodes.agg(F.array_sort(F.collect_list(node_id(F.col("ip"), F.col("port")))).alias("nids"))
    placed = keys.select(F.col(key_col).alias("key"), content_id(F.col(key_col)).alias("kid")).crossJoin(F.broadcast(ring))
    best = F.array_max(F.transform("nids", lambda nid: F.struct(F.sha2(F.concat(F.lit('"'), F.col("kid"), nid, F.lit('"')), 256).alias("h"), nid.alias("nid"))))
    following = F.filter("nids", lambda nid: nid >= F.col("kid"))
    return placed.select(
        "key",
        "kid",
        F.get("nids", hex_mod(F.col("kid"), F.size("nids")).cast("int")).alias("naive"),
        F.coalesce(F.get(following, F.lit(0)), F.get("nids", F.lit(0))).alias("consistent"),
        best["nid"].alias("rendezvous"),
    )
