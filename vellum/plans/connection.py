"""The connection: named databases and their numbered versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..errors import CommitConflict, DatabaseConflict, IllegalArgument, NoDatabaseVersion
from ..sources.store import Store
from .database import Database, named, paged


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="microseconds")


def _instant(at: dt.datetime | str) -> dt.datetime:
    """An ISO text of any offset, or a datetime; without an offset it is UTC."""
    at = dt.datetime.fromisoformat(at) if isinstance(at, str) else at
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


class Connection:
    """Session and root folder; holds no state of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def list_dbs(self, name=None, offset: int = 0, limit: int | None = None) -> list[dict]:
        """The current version of each live database. ``name``: prefix or pattern."""
        last = [self.store.refs(n)[-1] for n in self.store.names() if named(n, name)]
        return paged([r for r in last if r["node_id"]], offset, limit)

    def history(self, name: str, offset: int = 0, limit: int | None = None) -> list[dict]:
        """Versions, newest first; a drop is a version without root."""
        return paged(self.store.refs(name)[::-1], offset, limit)

    def versions(self) -> DataFrame:
        """The whole version log as a DataFrame."""
        rows = [(r["name"], r["version"], r["committed_at"], r["node_id"]) for n in self.store.names() for r in self.store.refs(n)]
        return self.store.spark.createDataFrame(rows, "name string, version long, committed_at string, node_id string")

    def _commit(self, name: str, node_id: str | None) -> dict:
        refs = self.store.refs(name)
        ref = {"name": name, "version": refs[-1]["version"] + 1 if refs else 1, "committed_at": _now(), "node_id": node_id}
        self.store.add_ref(ref)
        return ref

    def create_db(self, name: str, **attrs) -> Database:
        if not isinstance(name, str) or not 1 <= len(name) <= 255:
            raise IllegalArgument("a database name has 1 to 255 characters")
        refs = self.store.refs(name)
        if refs and refs[-1]["node_id"]:
            raise DatabaseConflict(f"database {name!r} exists")
        Database._check(attrs)
        db = Database(self.store, attrs, {}, name).flush()
        return self._versioned(db, self._commit(name, db.node_id))

    def drop_db(self, name: str) -> dict:
        """Ends the database with a version without root; data stay for older versions."""
        return self._commit(name, None)

    def open_db(self, name: str, version: int | None = None, at: dt.datetime | str | None = None) -> Database:
        """The latest version, the given one, or the newest committed at or before ``at``."""
        refs = self.store.refs(name)
        if version is not None:
            refs = [r for r in refs if r["version"] == version]
        if at is not None:
            at = _instant(at)
            refs = [r for r in refs if _instant(r["committed_at"]) <= at]
        if not refs or not refs[-1]["node_id"]:
            raise NoDatabaseVersion(f"no such version of {name!r}")
        return Database.load(self.store, refs[-1]["node_id"], name=name, version=refs[-1]["version"], committed_at=refs[-1]["committed_at"])

    def load_database(self, node_id: str) -> Database:
        return Database.load(self.store, node_id)

    def commit(self, *args, expect: int | None = None) -> Database:
        """``commit(db)`` or ``commit(name, db)``: flushes and publishes a version; another
        name forks. Nothing new is no new version. ``expect``: the version that must still
        be the latest, else a conflict."""
        name, db = args if len(args) == 2 else (getattr(args[0], "name", None), args[0]) if args else (None, None)
        if not isinstance(name, str) or not name or db is None:
            raise IllegalArgument("a commit needs a name and a database")
        db = db.flush()
        refs = self.store.refs(name)
        if expect is not None and (refs[-1]["version"] if refs else None) != expect:
            raise CommitConflict(f"version {expect} of {name!r} is not the latest")
        if refs and refs[-1]["node_id"] == db.node_id:
            return self._versioned(db, refs[-1])
        return self._versioned(db, self._commit(name, db.node_id))

    def _versioned(self, db: Database, ref: dict) -> Database:
        return Database.load(self.store, db.node_id, name=ref["name"], version=ref["version"], committed_at=ref["committed_at"])


def connect(spark: SparkSession, root: str) -> Connection:
    return Connection(spark, root)
