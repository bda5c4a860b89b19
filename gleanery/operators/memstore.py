"""A keyed store of tables in executor memory: put, get, delete, list and clear, by group."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class MemStore:
    """Tables by (group, key), cached where they are used and recomputed from their plans where an executor is lost.

    What does not fit into memory is kept on the executors' disks.
    """

    def __init__(self):
        self._tables: dict[tuple[str, str], DataFrame] = {}

    def put(self, table: DataFrame, key: str | None = None, gid: str = "local") -> str:
        """Keep ``table`` under ``key``, in place of what was there; without a key, under a hash of its plan. Returns the key."""
        key = key or f"{table.semanticHash() & 0xFFFFFFFF:08x}"
        if (gid, key) in self._tables:
            self.delete(key, gid)
        self._tables[gid, key] = table.persist(StorageLevel.MEMORY_AND_DISK)
        return key

    def get(self, key: str, gid: str = "local") -> DataFrame:
        """The table under ``key``; a ``KeyError`` where there is none."""
        return self._tables[gid, key]

    def keys(self, gid: str = "local") -> list[str]:
        return sorted(k for g, k in self._tables if g == gid)

    def delete(self, key: str, gid: str = "local") -> DataFrame:
        """Forget a key and free its memory; returns the table, which can still be computed."""
        return self._tables.pop((gid, key)).unpersist()

    def clear(self) -> None:
        """Forget all keys of all groups."""
        for gid, key in list(self._tables):
            self.delete(key, gid)
