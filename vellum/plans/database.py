"""The database value: attributes and named tables, immutable until committed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..errors import BadTarget, IllegalArgument, InvalidNode, NoTable, TableConflict
from .table import Table

_INFO = ("type", "tables", "name", "version", "committed_at", "node_id", "size")


def named(name: str, pattern) -> bool:
    """A string is a prefix, a compiled pattern matches anywhere."""
    return pattern is None or (bool(pattern.search(name)) if isinstance(pattern, re.Pattern) else name.startswith(pattern))


def paged(items: list, offset: int = 0, limit: int | None = None) -> list:
    return items[offset : None if limit is None else offset + limit]


@dataclass(frozen=True)
class Database:
    """Equal if attributes and tables are equal."""

    store: object = field(compare=False)
    attrs: dict
    tables: dict[str, str | Table]
    name: str | None = field(default=None, compare=False)
    version: int | None = field(default=None, compare=False)
    committed_at: str | None = field(default=None, compare=False)
    node_id: str | None = field(default=None, compare=False)

    @classmethod
    def load(cls, store, node_id: str, **info) -> Database:
        """Opens by root id; no version is needed."""
        root = store.get(node_id)
        if root.get("type") != "database":
            raise BadTarget(f"{node_id} is a {root.get('type')!r}")
        return cls(store, dict(root["attrs"]), dict(root["tables"]), node_id=node_id, **info)

    # attributes

    def __getitem__(self, key: str):
        return self.attrs[key]

    def get(self, key: str, default=None):
        return self.attrs.get(key, default)

    def assoc(self, **attrs) -> Database:
        self._check(attrs)
        return replace(self, attrs=self.attrs | attrs)

    def dissoc(self, *names: str) -> Database:
        self._check(names)
        return replace(self, attrs={k: v for k, v in self.attrs.items() if k not in names})

    @staticmethod
    def _check(names) -> None:
        bad = [n for n in names if n in _INFO]
        if bad:
            raise IllegalArgument(f"protected attributes {bad}")

    # tables

    def list_tables(self, name=None, offset: int = 0, limit: int | None = None) -> list[dict]:
        found = [t.info if isinstance(t, Table) else Table.load(self.store, n, t).info for n, t in sorted(self.tables.items()) if named(n, name)]
        return paged(found, offset, limit)

    def get_table(self, name: str) -> Table | None:
        found = self.tables.get(name)
        return Table.load(self.store, name, found) if isinstance(found, str) else found

    def set_table(self, name: str, table: Table) -> Database:
        table = table.set_backing(self.store, name)
        return replace(self, tables=self.tables | {name: table if table.dirty else table.node_id})

    def drop_table(self, name: str) -> Database:
        return replace(self, tables={n: t for n, t in self.tables.items() if n != name})

    def create_table(self, name: str, **options) -> Database:
        if name in self.tables:
            raise TableConflict(f"table {name!r} exists")
        return self.set_table(name, Table.new(self.store, name, **options))

    def update_table(self, name: str, f: Callable[..., Table], *args, **more) -> Database:
        table = self.get_table(name)
        if table is None:
            raise NoTable(f"no table {name!r}")
        return self.set_table(name, f(table, *args, **more))

    def rename_table(self, old: str, new: str) -> Database:
        table = self.get_table(old)
        if table is None:
            raise NoTable(f"no table {old!r}")
        if new in self.tables:
            raise TableConflict(f"table {new!r} exists")
        return self.drop_table(old).set_table(new, table)

    def flush(self) -> Database:
        """Flushes dirty tables and stores the root."""
        bad = [n for n in self.tables if not isinstance(n, str) or not 1 <= len(n) <= 127 or "/" in n]
        if bad:
            raise InvalidNode(f"bad table names {bad}")
        tables = {n: t.flush().node_id if isinstance(t, Table) else t for n, t in self.tables.items()}
        node_id = self.store.put({"type": "database", "attrs": self.attrs, "tables": tables})
        return replace(self, tables=tables, node_id=node_id)
