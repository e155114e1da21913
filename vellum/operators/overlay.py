"""Merge-on-read: changes (upserts and tombstones) over stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import DEAD

#: Changes up to which their keys are broadcast (their number is known before).
BROADCAST_CHANGES = 100_000


def overlay(base: DataFrame | None, changes: DataFrame | None, n_changes: int, primary_key: list[str]) -> DataFrame:
    """``base`` without the changed keys, and the changes that are not tombstones. A change
    replaces its record as a whole. Both have the same columns but DEAD."""
    if changes is None:
        return base
    alive = remove_tombstones(changes)
    if base is None:
        return alive
    keys = changes.select(*primary_key)
    keys = F.broadcast(keys) if n_changes <= BROADCAST_CHANGES else keys
    return base.join(keys, primary_key, "left_anti").select(*alive.columns).unionByName(alive)


def remove_tombstones(changes: DataFrame) -> DataFrame:
    return changes.filter(~F.col(DEAD)).drop(DEAD)


def later_wins(stored: DataFrame | None, pending: DataFrame | None, n_pending: int, primary_key: list[str]) -> DataFrame | None:
    """Stored changes overridden by pending ones, tombstones included."""
    if stored is None or pending is None:
        return pending if stored is None else stored
    keys = pending.select(*primary_key)
    keys = F.broadcast(keys) if n_pending <= BROADCAST_CHANGES else keys
    return stored.join(keys, primary_key, "left_anti").select(*pending.columns).unionByName(pending)
