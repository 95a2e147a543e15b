"""Keyed state handles over StatefulProcessor: value, list, map, reducing and aggregating state.

For use in transformWithStateInPandas processors, which need the RocksDB state
store (see plain_session in quernstone.sources.session).
"""

from __future__ import annotations

from collections.abc import Callable


class Value:
    def __init__(self, handle, name: str, schema: str, ttl: int | None = None):
        self.state = handle.getValueState(name, schema, ttl)

    def get(self, default=None):
        return self.state.get()[0] if self.state.exists() else default

    def set(self, value) -> None:
        self.state.update((value,))

    def clear(self) -> None:
        self.state.clear()


class Reducing(Value):
    """Keeps reduce(old, new)."""

    def __init__(self, handle, name: str, schema: str, reduce: Callable, ttl: int | None = None):
        super().__init__(handle, name, schema, ttl)
        self.reduce = reduce

    def add(self, value) -> None:
        self.set(self.reduce(self.get(), value) if self.state.exists() else value)


class Aggregating(Value):
    """Keeps an accumulator; read(acc) is its result."""

    def __init__(self, handle, name: str, schema: str, start, add: Callable, read: Callable, ttl: int | None = None):
        super().__init__(handle, name, schema, ttl)
        self.start, self.fold, self.result = start, add, read

    def add(self, value) -> None:
        self.set(self.fold(self.get(self.start), value))

    def read(self):
        return self.result(self.get(self.start))


class List:
    """Rows in the order in which they came."""

    def __init__(self, handle, name: str, schema: str, ttl: int | None = None):
        self.state = handle.getListState(name, schema, ttl)

    def get(self) -> list:
        return [row[0] for row in self.state.get()] if self.state.exists() else []

    def add(self, value) -> None:
        self.state.appendValue((value,))

    def update(self, values: list) -> None:
        self.state.put([(v,) for v in values])

    def clear(self) -> None:
        self.state.clear()


class Map:
    """Values by key; refresh: reading an entry writes it again, so that its time to live starts anew."""

    def __init__(self, handle, name: str, key_schema: str, schema: str, ttl: int | None = None, refresh: bool = False):
        self.state = handle.getMapState(name, key_schema, schema, ttl)
        self.refresh = refresh

    def get(self, key, default=None):
        if not self.state.containsKey((key,)):
            return default
        value = self.state.getValue((key,))[0]
        if self.refresh:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.state.updateValue((key,), (value,))

    def remove(self, key) -> None:
        self.state.removeKey((key,))

    def items(self) -> list[tuple]:
        return [(k[0], v[0]) for k, v in self.state.iterator()]

    def clear(self) -> None:
        self.state.clear()
