"""Records: key projection, field families, merge functions, schemas of plain dicts."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IllegalArgument

#: Internal columns: fields that are present with a null value, deletion mark, order.
NIL, DEAD, SEQ = "__v_nil", "__v_dead", "__v_seq"
RESERVED = "__v_"
#: Key field of tables that name none.
DEFAULT_ID = "id"


def project_id(primary_key: list[str], record: Mapping):
    """The id of a record: one value, or a tuple in the order of the key fields."""
    missing = [k for k in primary_key if record.get(k) is None]
    if missing:
        raise IllegalArgument(f"record without key fields {missing}")
    return record[primary_key[0]] if len(primary_key) == 1 else tuple(record[k] for k in primary_key)


def check_families(families: Mapping[str, Iterable[str]]) -> dict[str, list[str]]:
    """Disjoint named sets of fields; ``base`` is what is in none."""
    seen: set[str] = set()
    for name, fields in families.items():
        if name == "base":
            raise IllegalArgument("the base family is implied")
        twice = seen & set(fields)
        if twice:
            raise IllegalArgument(f"families share fields {sorted(twice)}")
        seen |= set(fields)
    return {name: sorted(fields) for name, fields in families.items()}


def family_lookup(families: Mapping[str, Iterable[str]]) -> Callable[[str], str]:
    of = {f: name for name, fields in families.items() for f in fields}
    return lambda field: of.get(field, "base")


def split_data(families: Mapping[str, Iterable[str]], data: Mapping) -> dict[str, dict | None]:
    """A record by family: the base always a map, another family None without fields."""
    find, out = family_lookup(families), {"base": {}, **dict.fromkeys(families)}
    for field, value in data.items():
        name = find(field)
        out[name] = (out[name] or {}) | {field: value}
    return out


def field_merger(spec) -> Callable:
    """``f(id, old, new)`` from a map of per-field functions or one function of a field.

    Map: a field without function takes its new value, null if the new record lacks it.
    Function: ``f(field, old, new)`` for each field of either record."""
    if isinstance(spec, Mapping):
        known = {k: NATIVE_MERGES[v][0] if isinstance(v, str) and v in NATIVE_MERGES else v for k, v in spec.items()}
        if not all(map(callable, known.values())):
            raise IllegalArgument("update functions must be callable")
        merge = lambda field, old, new: known[field](old, new) if field in known else new
    elif callable(spec):
        merge = spec
    else:
        raise IllegalArgument("update_field must be a map of functions or a function")
    return lambda _, old, new: {f: merge(f, (old or {}).get(f), (new or {}).get(f)) for f in sorted({*(old or {}), *(new or {})})}


def _with_null(f):
    return lambda a, b: b if a is None else a if b is None else f(a, b)


#: Merges that need no Python on the executors: name -> (function of two values, aggregate).
NATIVE_MERGES: dict[str, tuple[Callable, Callable[[Column], Column]]] = {
    "sum": (_with_null(lambda a, b: a + b), F.sum),
    "min": (_with_null(min), F.min),
    "max": (_with_null(max), F.max),
}


def record_updater(update_field=None, update_record=None) -> Callable | None:
    """The update function of an insert; None for the default merge."""
    if update_field is not None and update_record is not None:
        raise IllegalArgument("update_field and update_record exclude each other")
    if update_record is not None:
        if not callable(update_record):
            raise IllegalArgument("update_record must be callable")
        return update_record
    return field_merger(update_field) if update_field is not None else None


def default_merge(_, old: Mapping | None, new: Mapping | None) -> dict:
    """New over old, field by field; a null is a value."""
    return {**(old or {}), **(new or {})}


# -- schemas ----------------------------------------------------------------------------


def type_of(value) -> T.DataType | None:
    """Spark's type of a plain value; None for null. Mixed collections are VARIANT."""
    match value:
        case None:
            return None
        case bool():
            return T.BooleanType()
        case int():
            return T.LongType()
        case float():
            return T.DoubleType()
        case str():
            return T.StringType()
        case bytes() | bytearray():
            return T.BinaryType()
        case Decimal():
            return T.DecimalType(38, 18)
        case dt.datetime():
            return T.TimestampType()
        case dt.date():
            return T.DateType()
        case list() | tuple() | set() | frozenset():
            return T.ArrayType(_common(map(type_of, value)) or T.StringType())
        case dict():
            return T.MapType(T.StringType(), _common(map(type_of, value.values())) or T.StringType())
    raise IllegalArgument(f"no column type for {type(value).__name__}")


def widened(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """The type that holds both; VARIANT if nothing narrower does."""
    if a is None or b is None or a == b:
        return a or b
    ranks = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    kinds = [type(a), type(b)]
    if all(k in ranks for k in kinds):
        return a if ranks.index(kinds[0]) >= ranks.index(kinds[1]) else b
    if set(kinds) == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if all(isinstance(x, T.StringType) for x in (a, b)):
        return T.StringType()
    if all(isinstance(x, T.ArrayType) for x in (a, b)):
        return T.ArrayType(widened(a.elementType, b.elementType))
    if all(isinstance(x, T.MapType) for x in (a, b)) and a.keyType == b.keyType:
        return T.MapType(a.keyType, widened(a.valueType, b.valueType))
    return T.VariantType()


def _common(types: Iterable[T.DataType | None]) -> T.DataType | None:
    out = None
    for t in types:
        out = widened(out, t)
    return out


#: Mark of a field that has only had nulls: a string for now, it takes the first real type.
VOID = "vellum.void"


def is_void(f: T.StructField) -> bool:
    return bool((f.metadata or {}).get(VOID))


def merge_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both, those of ``a`` first; a clash of types widens."""
    of_b = {f.name: f for f in b}
    fields = []
    for f in a:
        other = of_b.get(f.name)
        if other is None or is_void(other):
            fields.append(f)
        elif is_void(f):
            fields.append(other)
        else:
            fields.append(T.StructField(f.name, widened(f.dataType, other.dataType)))
    return T.StructType(fields + [f for f in b if f.name not in a.names])


def _conformed(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(want, T.VariantType):
        return F.to_variant_object(value) if isinstance(have, (T.ArrayType, T.MapType, T.StructType)) else value.cast("variant")
    return value.cast(want)


def conform(df: DataFrame, schema: T.StructType, extra: Iterable[str] = ()) -> DataFrame:
    """``df`` with exactly the fields of ``schema`` (null where it lacks one) and the
    columns ``extra``."""
    have = {f.name: f.dataType for f in df.schema}
    columns = [(_conformed(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return df.select(*columns, *extra)


def _fits(value, kind: T.DataType) -> bool:
    """Whether a plain value can go into a column of a narrower type as it is."""
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind))
    if value is None:
        return True
    if bits:
        return isinstance(value, int) and not isinstance(value, bool) and -(1 << bits) <= value < 1 << bits
    return isinstance(kind, T.TimestampNTZType) and isinstance(value, dt.datetime) and value.tzinfo is None


def records_frame(spark: SparkSession, records: Iterable[Mapping], key_types: Mapping[str, T.DataType] | None = None, like: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """A DataFrame of dicts: the union of their fields, NIL with the fields that are
    present and null, SEQ with the order. Sets become sorted arrays. ``like``: types that a
    column takes if all its values fit."""
    records = [dict(r) for r in records]
    names = list(dict.fromkeys(f for r in records for f in r))
    bad = [n for n in names if not isinstance(n, str) or n.startswith(RESERVED)]
    if bad:
        raise IllegalArgument(f"bad field names {bad}")
    near = {n: t for n, t in (like or {}).items() if n in names and all(_fits(r.get(n), t) for r in records) and any(r.get(n) is not None for r in records)}
    found = {n: (key_types or {}).get(n) or near.get(n) or _common(type_of(r.get(n)) for r in records) for n in names}
    types = {n: t or T.StringType() for n, t in found.items()}

    def plain(value, kind: T.DataType):
        if value is None:
            return None
        if isinstance(value, (set, frozenset)):
            value = sorted(value, key=repr)
        if _has_variant(kind):
            return json.dumps(value, default=str)
        return value

    raw = T.StructType([T.StructField(n, T.StringType() if _has_variant(t) else t) for n, t in types.items()] + [T.StructField(NIL, T.ArrayType(T.StringType())), T.StructField(SEQ, T.LongType())])
    rows = [(*(plain(r.get(n), types[n]) for n in names), [n for n in r if r[n] is None] or None, i) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, raw)
    mark = lambda n: {} if found[n] else {"metadata": {VOID: True}}
    return df.select(*((F.parse_json(F.col(f"`{n}`")) if _has_variant(t) else F.col(f"`{n}`")).alias(n, **mark(n)) for n, t in types.items()), NIL, SEQ)


def _has_variant(kind: T.DataType) -> bool:
    return "variant" in kind.simpleString()


def present(field: str) -> Column:
    """Whether a record has the field: a value, or a null that was written."""
    return F.col(f"`{field}`").isNotNull() | F.coalesce(F.array_contains(F.col(NIL), field), F.lit(False))
