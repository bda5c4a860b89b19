"""Named Python functions by group, for map-reduce jobs that name what they run."""

from __future__ import annotations

from collections.abc import Callable


class Functions:
    """Functions under (group, name). Spark ships the function itself to its workers, so a name resolves on the driver."""

    def __init__(self):
        self._found: dict[tuple[str, str], Callable] = {}

    def put(self, function: Callable, name: str, gid: str = "local") -> None:
        if not callable(function) or not name:
            raise ValueError("a callable and a name are needed")
        self._found[gid, name] = function

    def get(self, name: str, gid: str = "local") -> Callable:
        """The function; a ``KeyError`` where there is none."""
        return self._found[gid, name]

    def delete(self, name: str, gid: str = "local") -> Callable:
        return self._found.pop((gid, name))

    def names(self, gid: str = "local") -> list[str]:
        return sorted(n for g, n in self._found if g == gid)
