"""A small cache of results, for questions that are asked again within seconds."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from time import monotonic
from typing import Any

TTL, ENTRIES, ROWS = 30.0, 200, 50_000


class ResultCache:
    """Results by (project, kind, cursor, hash of the question).

    Clearing a project also keeps out results that were begun before: a result
    is stored only under the generation its computation started in.
    """

    def __init__(self, ttl: float = TTL, entries: int = ENTRIES, rows: int = ROWS, clock: Callable[[], float] = monotonic):
        self.ttl, self.entries, self.rows, self.clock = ttl, entries, rows, clock
        self._kept: OrderedDict[Hashable, tuple[float, list[Any]]] = OrderedDict()
        self._generation: dict[int, int] = {}

    def get(self, project: int, key: Hashable, compute: Callable[[], list[Any]]) -> list[Any]:
        full = (project, key)
        if full in self._kept:
            at, value = self._kept[full]
            if self.clock() - at < self.ttl:
                self._kept.move_to_end(full)
                return value
            del self._kept[full]
        generation = self._generation.get(project, 0)
        value = compute()
        if generation == self._generation.get(project, 0) and len(value) <= self.rows:
            self._kept[full] = (self.clock(), value)
            while len(self._kept) > self.entries or sum(len(v) for _, v in self._kept.values()) > self.rows:
                self._kept.popitem(last=False)
        return value

    def clear(self, project: int) -> None:
        self._generation[project] = self._generation.get(project, 0) + 1
        for k in [k for k in self._kept if k[0] == project]:
            del self._kept[k]
