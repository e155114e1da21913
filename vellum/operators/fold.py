"""Folding a batch of records, in order, over the records of the same keys."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IllegalArgument
from ..functions.records import NATIVE_MERGES, NIL, SEQ, present


def fold_default(rows: DataFrame, primary_key: list[str], fields: list[str]) -> DataFrame:
    """The last record that has a field gives its value; aggregates, so that a key with
    many records is combined before the shuffle."""
    lasts = [F.max_by(F.when(present(f), F.struct(F.col(f"`{f}`").alias("v"))), F.when(present(f), F.col(SEQ))).alias(f) for f in fields]
    found = rows.groupBy(*primary_key).agg(*(lasts or [F.count("*").alias("__v_n")]))
    nil = F.array_compact(F.array(*(F.when(F.col(f"`{f}`").isNotNull() & F.col(f"`{f}`")["v"].isNull(), F.lit(f)) for f in fields))) if fields else F.array().cast("array<string>")
    return found.select(*primary_key, *(F.col(f"`{f}`")["v"].alias(f) for f in fields), F.when(F.size(nil) > 0, nil).alias(NIL))


def fold_native(rows: DataFrame, primary_key: list[str], fields: list[str], spec: dict[str, str]) -> DataFrame:
    """A map of named merges: these aggregate all values; every other field takes that of
    the key's last record, null if it lacks it (as the map form does)."""
    lasts = F.max_by(F.struct(*(F.col(f"`{f}`") for f in fields)), SEQ).alias("__v_last")
    merged = [NATIVE_MERGES[how][1](F.col(f"`{f}`")).alias(f"__v_m_{f}") for f, how in spec.items() if f in fields]
    any_has = [F.bool_or(present(f)).alias(f"__v_has_{f}") for f in fields]
    found = rows.groupBy(*primary_key).agg(lasts, *merged, *any_has)
    values: dict[str, Column] = {f: F.col(f"`__v_m_{f}`").cast(rows.schema[f].dataType) if f in spec else F.col("__v_last")[f] for f in fields}
    nil = F.array_compact(F.array(*(F.when(F.col(f"`__v_has_{f}`") & values[f].isNull(), F.lit(f)) for f in fields)))
    return found.select(*primary_key, *(v.alias(f) for f, v in values.items()), F.when(F.size(nil) > 0, nil).alias(NIL))


def fold_python(rows: DataFrame, primary_key: list[str], fields: list[str], schema: T.StructType, update: Callable, encode: Callable) -> DataFrame:
    """Any function ``f(key, old, new)``: the records of a key are folded in one group.
    That is inherent in an arbitrary fold; a key's batch must fit a worker."""
    out = T.StructType([*(schema[k] for k in primary_key), *(schema[f] for f in fields), T.StructField(NIL, T.ArrayType(T.StringType()))])

    def run(table):
        held = sorted(table.to_pylist(), key=lambda r: r[SEQ])
        key, old = held[0], None
        encoded = encode({k: key[k] for k in primary_key})
        for r in held:
            nil = set(r[NIL] or ())
            new = {f: r[f] for f in fields if r[f] is not None or f in nil}
            old = new if r[SEQ] < 0 else update(encoded, old, new)
        old = old or {}
        unknown = set(old) - set(fields)
        if unknown:
            raise IllegalArgument(f"update function made unknown fields {sorted(unknown)}")
        row = {k: key[k] for k in primary_key} | {f: old.get(f) for f in fields} | {NIL: [f for f in old if old[f] is None] or None}
        return pa.Table.from_pylist([row], schema=pa.schema([table.schema.field(n) for n in row]))

    return rows.groupBy(*primary_key).applyInArrow(run, out)
