"""Small driver-side containers: a frequency set with least-recent eviction, and a key-value cache that spills to disk.

Tables are cached by Spark (persist); these serve point look-ups of a running service.
"""

from __future__ import annotations

import os
import sqlite3
from collections import OrderedDict
from collections.abc import Hashable, Iterator
import json


class FrequencySet:
    """Counts keys; beyond its capacity the least recently counted key goes, and its count with it."""

    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self._counts = capacity, OrderedDict()

    def add(self, key: Hashable) -> None:
        self._counts[key] = self._counts.pop(key, 0) + 1
        if len(self._counts) > self.capacity:
            self._counts.popitem(last=False)

    def discard(self, key: Hashable) -> None:
        self._counts.pop(key, None)

    def top(self, n: int | None = None, exclude: tuple = ()) -> list:
        """The most frequent keys, of equals the least recently counted first."""
        ranked = [k for k in sorted(self._counts, key=lambda k: -self._counts[k]) if k not in set(exclude)]
        return ranked[:n]

    def __contains__(self, key: Hashable) -> bool:
        return key in self._counts

    def __iter__(self) -> Iterator:
        return iter(self._counts)

    def __len__(self) -> int:
        return len(self._counts)


class SpillCache:
    """Text keys to JSON values: the latest `size` in memory, older ones in a file that begins empty."""

    def __init__(self, path: str, size: int = 10_000):
        if os.path.exists(path):
            os.remove(path)
        self.size, self._held = size, OrderedDict()
        self._db = sqlite3.connect(path)
        self._db.execute("create table kv (k text primary key, v text)")

    def __setitem__(self, key: str, value) -> None:
        self._held[key] = value
        self._held.move_to_end(key)
        while len(self._held) > self.size:
            self._write(*self._held.popitem(last=False))

    def _write(self, key: str, value) -> None:
        self._db.execute("insert or replace into kv values (?, ?)", (key, json.dumps(value)))

    def get(self, key: str, default=None):
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        row = self._db.execute("select v from kv where k = ?", (key,)).fetchone()
        if row is None:
            return default
        self[key] = json.loads(row[0])
        return self._held.get(key, json.loads(row[0]))

    def __getitem__(self, key: str):
        missing = object()
        out = self.get(key, missing)
        if out is missing:
            raise KeyError(key)
        return out

    def __delitem__(self, key: str) -> None:
        if key not in self:
            raise KeyError(key)
        self._held.pop(key, None)
        self._db.execute("delete from kv where k = ?", (key,))

    def __contains__(self, key: str) -> bool:
        return key in self._held or self._db.execute("select 1 from kv where k = ?", (key,)).fetchone() is not None

    def __len__(self) -> int:
        stored = {r[0] for r in self._db.execute("select k from kv")}
        return len(stored | set(self._held))

    def flush(self, forget: bool = False) -> None:
        for k, v in self._held.items():
            self._write(k, v)
        self._db.commit()
        if forget:
            self._held.clear()

    def clear(self, memory_only: bool = True) -> None:
        self._held.clear()
        if not memory_only:
            self._db.execute("delete from kv")

    def close(self) -> None:
        self.flush()
        self._db.close()
