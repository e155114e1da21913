import re
import time

import pytest

from vellum.errors import BadTarget, CommitConflict, DatabaseConflict, IllegalArgument, InvalidNode, NoDatabaseVersion, NoTable, TableConflict
from vellum.operators.stats import find_nodes, view_database
from vellum.plans.connection import connect
from vellum.plans.database import Database
from vellum.sources.store import Store


@pytest.fixture
def connection(spark, tmp_path):
    return connect(spark, f"file://{tmp_path}/db root")


def test_tutorial(connection):
    """Create, extend, fork, drop; tables with records; old versions stay as they were."""
    db = connection.create_db("iris", title="Iris")
    assert (db.version, db["title"], db.get("description")) == (1, "Iris", None)
    more = db.assoc(description="flowers")
    assert more.node_id == db.node_id and more != db and db.get("description") is None
    db2 = connection.commit(more)
    assert db2.version == 2 and db2.node_id != db.node_id and connection.commit(db2).version == 2
    assert [(v["version"], v["node_id"]) for v in connection.history("iris")] == [(2, db2.node_id), (1, db.node_id)]
    fork = connection.commit("iris2", db)
    assert (fork.name, fork.version, fork.node_id) == ("iris2", 1, db.node_id)
    assert [d["name"] for d in connection.list_dbs()] == ["iris", "iris2"]
    assert connection.drop_db("iris2")["node_id"] is None
    assert [d["name"] for d in connection.list_dbs()] == ["iris"] and len(connection.history("iris2")) == 2
    with pytest.raises(NoDatabaseVersion):
        connection.open_db("iris2")
    assert connection.create_db("iris2").version == 3

    db3 = connection.commit(db2.create_table("test", title="T", primary_key="id"))
    table = db3.get_table("test")
    assert table.count == 0 and not table.dirty and table["title"] == "T"
    table = table.insert([{"id": 1, "foo": 123, "bar": "baz"}])
    assert table.dirty and table.count == 1 and db3.get_table("test").count == 0
    flushed = table.flush()
    assert flushed.node_id and db3.get_table("test").count == 0
    db4 = connection.commit(db3.set_table("test", flushed))
    table = db4.get_table("test").insert([{"id": 1, "foo": 456, "qux": True}, {"id": 2, "abc": "xyz"}])
    assert table.count == 2
    assert table.records(table.read([1, 2])) == [{"id": 1, "bar": "baz", "foo": 456, "qux": True}, {"id": 2, "abc": "xyz"}]
    db5 = connection.commit(db4.set_table("test", table))
    assert db5.get_table("test").count == 2 and connection.open_db("iris", version=4).get_table("test").count == 1
    assert connection.load_database(db4.node_id) == db4
    assert view_database(db5).startswith("digraph") and db5.node_id in find_nodes(connection.store, [db5.node_id])


def test_as_of(connection):
    db = connection.create_db("a")
    time.sleep(0.01)
    db = connection.commit(db.assoc(x=1))
    first, second = connection.history("a")[::-1]
    assert connection.open_db("a", at=first["committed_at"]).version == 1
    assert connection.open_db("a", at=second["committed_at"]).version == 2
    for bad in ({"at": "1999-01-01T00:00:00"}, {"version": 7}):
        with pytest.raises(NoDatabaseVersion):
            connection.open_db("a", **bad)
    with pytest.raises(NoDatabaseVersion):
        connection.open_db("none")


def test_conflicts(connection):
    db = connection.create_db("a")
    with pytest.raises(DatabaseConflict):
        connection.create_db("a")
    connection.commit(db.assoc(x=1))
    with pytest.raises(CommitConflict):
        connection.commit("a", db.assoc(x=2), expect=1)
    with pytest.raises(CommitConflict):
        connection.store.add_ref({"name": "a", "version": 2, "committed_at": "", "node_id": None})
    for bad in ((None, db), ("a", None), (5, db), ()):
        with pytest.raises(IllegalArgument):
            connection.commit(*bad)
    for bad in ("", "x" * 256, 5):
        with pytest.raises(IllegalArgument):
            connection.create_db(bad)


def test_tables_of_a_database(connection):
    db = connection.create_db("a").create_table("one").create_table("two")
    with pytest.raises(TableConflict):
        db.create_table("one")
    with pytest.raises(NoTable):
        db.update_table("none", lambda t: t)
    with pytest.raises(NoTable):
        db.rename_table("none", "x")
    with pytest.raises(TableConflict):
        db.rename_table("one", "two")
    db = connection.commit(db.rename_table("one", "first").update_table("two", lambda t, v: t.assoc(v=v), 5))
    assert [t["name"] for t in db.list_tables()] == ["first", "two"] and db.get_table("two")["v"] == 5
    assert [t["name"] for t in db.list_tables(name="fi")] == ["first"]
    assert [t["name"] for t in db.list_tables(name=re.compile("w"))] == ["two"]
    assert [t["name"] for t in db.list_tables(offset=1, limit=1)] == ["two"]
    assert db.drop_table("none") == db and db.drop_table("two").get_table("two") is None
    with pytest.raises(InvalidNode):
        db.create_table("a/b").flush()
    for bad in ("tables", "name", "version"):
        with pytest.raises(IllegalArgument):
            db.assoc(**{bad: 1})
        with pytest.raises(IllegalArgument):
            db.dissoc(bad)
    with pytest.raises(BadTarget):
        Database.load(connection.store, connection.store.put({"type": "table"}))


def test_listing(connection):
    for name in ("alpha", "beta/x", "alp ü"):
        connection.create_db(name)
    assert [d["name"] for d in connection.list_dbs("alp")] == ["alp ü", "alpha"]
    assert [d["name"] for d in connection.list_dbs(re.compile("a/"))] == ["beta/x"]
    assert [d["name"] for d in connection.list_dbs(offset=1, limit=1)] == ["alpha"]
    assert connection.versions().count() == 3


def test_equal_content_has_equal_ids(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/{x}") for x in "ab")
    assert a.put({"type": "x", "v": [1, "ü"]}) == b.put({"v": [1, "ü"], "type": "x"})
