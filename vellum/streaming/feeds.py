"""Streams into and out of versioned tables.

The store itself is batch; these use ``foreachBatch`` so that each micro-batch is one
commit, and the version log so that readers take what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.connection import Connection
from ..plans.table import changes_between


def upsert_stream(stream: DataFrame, connection: Connection, db: str, table: str, checkpoint: str, trigger: dict | None = None, **update) -> StreamingQuery:
    """Inserts each micro-batch and commits. The batch number is kept in the table, so a
    batch that is delivered again is not applied again."""

    def write(batch: DataFrame, number: int) -> None:
        current = connection.open_db(db)
        target = current.get_table(table)
        mark = f"stream:{checkpoint}"
        if (target.get(mark) if target.get(mark) is not None else -1) >= number:
            return
        changed = target.insert(batch, **update).assoc(**{mark: number})
        connection.commit(db, current.set_table(table, changed), expect=current.version)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def changes_since(connection: Connection, db: str, table: str, version: int) -> tuple[DataFrame, int]:
    """Changed rows since a version (0: all rows, as added), and the version reached. Only
    partitions that the versions do not share are read."""
    now = connection.open_db(db)
    new = now.get_table(table)
    old = connection.open_db(db, version=version).get_table(table) if version else None
    if old is None:
        return new.scan(ordered=False).withColumn("change", F.lit("added")), now.version
    return changes_between(old, new), now.version
