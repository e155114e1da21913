"""The table value: an immutable snapshot, local changes over it, and the plans to read it."""

from __future__ import annotations

import base64
import bisect
import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

from ..errors import BadTarget, BrokenLink, DuplicateKeys, IllegalArgument, RangeOverlap
from ..functions import keys as K
from ..functions.records import DEAD, DEFAULT_ID, NATIVE_MERGES, NIL, RESERVED, SEQ, VOID, check_families, conform, default_merge, is_void, merge_schemas, present, record_updater, records_frame
from ..operators import fold, index, partitions
from ..operators.overlay import BROADCAST_CHANGES, later_wins, overlay, remove_tombstones

PATCH_LIMIT = 100_000
#: Keys that are looked up one by one on the driver to choose files; more go by their range.
LOOKUP_KEYS = 10_000
#: Partitions that an ordered scan reads one by one, in key order; more are sorted by a
#: range shuffle, for a plan with a branch for each would burden the driver.
ORDERED_PARTS = 256
PLACE = "__v_place"
_KNOBS = ("primary_key", "lexicoder", "families", "fan_out", "partition_limit", "patch_limit", "bloom")
_INNER = ("type", "count", "schemas", "data", "patch")
_BY_TYPE = {T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.StringType: "string", T.BinaryType: "bytes", T.DoubleType: "float", T.FloatType: "float", T.TimestampType: "instant", T.TimestampNTZType: "instant"}


def _listed(config):
    return [_listed(x) for x in config] if isinstance(config, (list, tuple)) else config


@dataclass(frozen=True, eq=False)
class Table:
    store: object
    name: str
    root: dict
    node_id: str | None = None
    pending: DataFrame | None = None
    n_pending: int = 0
    dirty: bool = False

    # -- making -------------------------------------------------------------------------

    @classmethod
    def new(cls, store, name: str, *, primary_key: str | Iterable[str] = DEFAULT_ID, lexicoder=None, families: Mapping | None = None, fan_out: int = index.FAN_OUT, partition_limit: int = partitions.LIMIT, patch_limit: int = PATCH_LIMIT, bloom: bool = False, **attrs) -> Table:
        """An empty table. Without a lexicoder the key's columns choose theirs at the first
        write. Further keywords are attributes."""
        pk = [primary_key] if isinstance(primary_key, str) else list(primary_key)
        if not pk or len(set(pk)) < len(pk):
            raise IllegalArgument("a primary key is one field, or distinct fields")
        if fan_out < index.LEAST_FAN_OUT or partition_limit < 1 or patch_limit < 0:
            raise IllegalArgument("limits out of range")
        if lexicoder is not None and len(K.parts_of(K.codec(lexicoder))) != len(pk):
            raise IllegalArgument("the lexicoder and the key differ in fields")
        attrs = {k: v for k, v in attrs.items() if k not in ("data", "patch")}
        cls._check_attrs(attrs)
        root = {"type": "table", "primary_key": pk, "lexicoder": _listed(K.codec(lexicoder).config) if lexicoder is not None else None, "families": check_families(families or {}), "fan_out": fan_out, "partition_limit": partition_limit, "patch_limit": patch_limit, "bloom": bloom, "count": 0, "schemas": [], "data": None, "patch": None, "attrs": attrs}
        return cls(store, name, root, dirty=True)

    @classmethod
    def load(cls, store, name: str, node_id: str) -> Table:
        root = store.get(node_id)
        if root.get("type") != "table":
            raise BadTarget(f"{node_id} is a {root.get('type')!r}")
        return cls(store, name, root, node_id)

    def set_backing(self, store, name: str) -> Table:
        return replace(self, store=store, name=name)

    @staticmethod
    def _check_attrs(attrs: Iterable[str]) -> None:
        bad = [k for k in attrs if k in _KNOBS or k in _INNER or k == "name"]
        if bad:
            raise IllegalArgument(f"protected attributes {bad}")

    # -- attributes ---------------------------------------------------------------------

    def __getitem__(self, key: str):
        return self.root["attrs"][key]

    def get(self, key: str, default=None):
        return self.root["attrs"].get(key, default)

    def assoc(self, **attrs) -> Table:
        self._check_attrs(attrs)
        new = self.root["attrs"] | attrs
        return self if new == self.root["attrs"] else self._changed(attrs=new)

    def dissoc(self, *names: str) -> Table:
        self._check_attrs(names)
        new = {k: v for k, v in self.root["attrs"].items() if k not in names}
        return self if new == self.root["attrs"] else self._changed(attrs=new)

    def _changed(self, **root) -> Table:
        return replace(self, root=self.root | root, node_id=None, dirty=True)

    def __eq__(self, other) -> bool:
        return isinstance(other, Table) and self.root == other.root and self.pending is other.pending

    def __hash__(self) -> int:
        return hash(json.dumps(self.root, sort_keys=True, default=str))

    @property
    def count(self) -> int:
        return self.root["count"]

    @property
    def primary_key(self) -> list[str]:
        return self.root["primary_key"]

    @property
    def schema(self) -> T.StructType:
        """Key and all fields ever seen."""
        return T.StructType.fromJson(self.root["schemas"][-1]) if self.root["schemas"] else T.StructType()

    @property
    def codec(self) -> K.Codec:
        config = self.root["lexicoder"]
        if config is None:
            raise IllegalArgument("the table has no lexicoder before its first write")
        return K.codec(config)

    @property
    def info(self) -> dict:
        return {"name": self.name, "node_id": self.node_id, "count": self.count, "dirty": self.dirty}

    @property
    def fields(self) -> list[str]:
        return [f for f in self.schema.names if f not in self.primary_key]

    def _order(self, reverse: bool = False) -> list[Column]:
        down = [c.descending for c in K.parts_of(self.codec)]
        return [F.col(f"`{k}`").desc() if d != reverse else F.col(f"`{k}`").asc() for k, d in zip(self.primary_key, down)]

    def _token(self, value) -> tuple:
        self.codec.encode(value)  # says what is wrong with it
        return K.sort_token(self.codec, value)

    def _place(self, parts: list[dict]) -> Column:
        """The number of the partition into whose stretch of keys a row's key falls; what
        lies before the first belongs to it. Two levels of some sqrt(n) first keys each, as
        one literal, are compared with the key columns."""
        if len(parts) < 2:
            return F.lit(0)
        codecs, kinds = K.parts_of(self.codec), [self.schema[k].dataType for k in self.primary_key]
        firsts = []
        for p in parts:
            value = self.codec.decode(bytes.fromhex(p["first"]))
            values = value if isinstance(self.codec, K.TupleCodec) else (value,)
            firsts.append({f"k{i}": _json_value(v, t) for i, (v, t) in enumerate(zip(values, kinds))})
        width = math.isqrt(len(firsts) - 1) + 1
        groups = [firsts[i : i + width] for i in range(0, len(firsts), width)]
        kind = T.ArrayType(T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(kinds)]))

        def reached(edge: Column) -> Column:
            out: Column = F.lit(True)
            for i, (name, c) in reversed(list(enumerate(zip(self.primary_key, codecs)))):
                key, at = F.col(f"`{name}`"), edge[f"k{i}"]
                out = ((key < at) if c.descending else (key > at)) | ((key == at) & out)
            return out

        def passed(edges: Column) -> Column:
            return F.size(F.filter(edges, reached))

        heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), kind)
        tails = F.from_json(F.lit(json.dumps(groups)), T.ArrayType(kind))
        group = F.greatest(passed(heads), F.lit(1))
        return F.greatest((group - 1) * width + passed(F.element_at(tails, group)) - 1, F.lit(0))

    def _edges(self, node: dict) -> tuple[tuple, tuple]:
        return tuple(K.sort_token(self.codec, self.codec.decode(bytes.fromhex(node[e]))) for e in ("first", "last"))

    # -- reading ------------------------------------------------------------------------

    def _stored(self, parts: list[dict], columns: list[str] | None = None) -> DataFrame | None:
        """Rows of partitions in today's schema, and NIL."""
        if not parts:
            return None
        want = self.schema if columns is None else T.StructType([f for f in self.schema if f.name in columns])
        by_schema: dict[int, list[dict]] = {}
        for p in parts:
            by_schema.setdefault(p["schema"], []).append(p)
        frames = []
        for number, some in by_schema.items():
            had = T.StructType.fromJson(self.root["schemas"][number])
            read = T.StructType([*(f for f in had if f.name in want.names), T.StructField(NIL, T.ArrayType(T.StringType()))])
            try:
                frames += [conform(self.store.spark.read.schema(read).parquet(*paths), want, [NIL]) for paths in partitions.folders(some)]
            except Exception as e:  # noqa: BLE001  py4j wraps the Java error
                raise (BrokenLink(f"data of {self.name!r} is missing") if "PATH_NOT_FOUND" in str(e) else e) from e
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _patch(self) -> DataFrame | None:
        patch = self.root["patch"]
        if patch is None:
            return None
        had = T.StructType.fromJson(self.root["schemas"][patch["schema"]])
        read = T.StructType([*had, T.StructField(NIL, T.ArrayType(T.StringType())), T.StructField(DEAD, T.BooleanType())])
        return conform(self.store.spark.read.schema(read).parquet(patch["path"]), self.schema, [NIL, DEAD])

    def _changes(self) -> tuple[DataFrame | None, int]:
        pending = None if self.pending is None else conform(self.pending, self.schema, [NIL, DEAD])
        n_patch = self.root["patch"]["count"] if self.root["patch"] else 0
        return later_wins(self._patch(), pending, self.n_pending, self.primary_key), n_patch + self.n_pending

    def _bounds(self, lo, hi) -> Column | None:
        """lo <= key <= hi, column by column; the first column's own bound is pushed down."""
        out = None
        parts = list(zip(self.primary_key, K.parts_of(self.codec)))
        for bound, sign in ((lo, 1), (hi, -1)):
            if bound is None:
                continue
            values = bound if isinstance(self.codec, K.TupleCodec) else (bound,)
            cond: Column = F.lit(True)
            for (name, c), value in reversed(list(zip(parts, values))):
                col = F.col(f"`{name}`")
                edge = F.lit(value).cast(self.schema[name].dataType)
                if isinstance(c, K.InstantCodec):
                    edge = F.date_trunc("millisecond", edge).cast(self.schema[name].dataType)
                up = (sign > 0) != c.descending
                cond = (col >= edge if up else col <= edge) & ((col > edge if up else col < edge) | cond)
            out = cond if out is None else out & cond
        return out

    def _parts(self, lo=None, hi=None) -> list[dict]:
        a, b = (None if v is None else self._token(v) for v in (lo, hi))

        def touches(node):
            first, last = self._edges(node)
            return (a is None or last >= a) and (b is None or first <= b)

        return list(index.entries(self.store, self.root["data"], touches if a or b else lambda _: True))

    def _chosen(self, fields: Iterable[str] | None) -> list[str] | None:
        fields = list(dict.fromkeys(fields or []))
        return [f for f in fields if f in self.fields] if fields else None

    def _empty(self, fields: list[str] | None) -> DataFrame:
        keep = [*self.primary_key, *(self.fields if fields is None else fields)]
        schema = T.StructType([f for f in self.schema if f.name in keep] or [T.StructField(k, T.StringType()) for k in self.primary_key])
        return self.store.spark.createDataFrame([], T.StructType([*schema, T.StructField(NIL, T.ArrayType(T.StringType()))]))

    def _projected(self, df: DataFrame, fields: list[str] | None) -> DataFrame:
        if fields is None:
            return df
        if not fields:
            return df.select(*(f"`{k}`" for k in self.primary_key), NIL).filter(F.lit(False))
        some = present(fields[0])
        for f in fields[1:]:
            some = some | present(f)
        return df.filter(some).select(*(f"`{k}`" for k in self.primary_key), *(f"`{f}`" for f in fields), NIL)

    def scan(self, fields: Iterable[str] | None = None, min_key=None, max_key=None, offset: int = 0, limit: int | None = None, reverse: bool = False, ordered: bool = True, with_nil: bool = False) -> DataFrame:
        """Records with min_key <= key <= max_key, in key order.

        Only partitions that the range touches are read; where no change lies over them,
        offset and limit leave out whole partitions by their counts. With ``fields`` the
        key and these fields are returned, of records that have at least one of them.
        ``ordered=False`` spares the sort where the order is of no use. Without changes,
        offset and limit nothing is shuffled: each partition is a task, in key order."""
        chosen = self._chosen(fields)
        if not self.root["schemas"]:
            return self._shown(self._empty(chosen), with_nil)
        parts = self._parts(min_key, max_key)
        changes, n = self._changes()
        if changes is None and chosen is None and (offset or limit is not None):
            parts, offset = self._counted(parts, min_key, max_key, offset, limit, reverse)
        needed = None if chosen is None else [*self.primary_key, *chosen]
        bound = self._bounds(min_key, max_key)
        base = self._stored(parts, needed)
        if bound is not None:
            base = None if base is None else base.filter(bound)
            changes = None if changes is None else changes.filter(bound)
        if changes is not None and needed is not None:
            changes = changes.select(*(f"`{c}`" for c in self.schema.names if c in needed), NIL, DEAD)
        if ordered and changes is None and base is not None and not offset and limit is None and len(parts) <= ORDERED_PARTS:
            return self._shown(self._projected(self._in_order(parts, needed, bound, reverse), chosen), with_nil)
        df = self._empty(chosen) if base is None and changes is None else overlay(base, changes, n, self.primary_key)
        df = self._projected(df, chosen)
        if ordered or offset or limit is not None:
            df = df.orderBy(*self._order(reverse))
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return self._shown(df, with_nil)

    def _in_order(self, parts: list[dict], columns: list[str] | None, bound: Column | None, reverse: bool) -> DataFrame:
        """Stored rows in key order without a shuffle: a union keeps the order of its
        branches, each of which is one partition, sorted within its task."""
        branches = []
        for p in reversed(parts) if reverse else parts:
            df = self._stored([p], columns)
            df = df if bound is None else df.filter(bound)
            branches.append(df.coalesce(1).sortWithinPartitions(*self._order(reverse)))
        # branches of one task each would be put into a single task; an empty one prevents it
        none = self.store.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in branches[0].schema))
        out = none
        for df in branches:
            out = out.union(df)
        return out

    @staticmethod
    def _shown(df: DataFrame, with_nil: bool) -> DataFrame:
        return df if with_nil else df.drop(NIL)

    def _counted(self, parts: list[dict], lo, hi, offset: int, limit: int | None, reverse: bool) -> tuple[list[dict], int]:
        """Partitions that offset and limit leave, and the offset inside these."""
        a, b = (None if v is None else self._token(v) for v in (lo, hi))
        kept, want = [], None
        for p in reversed(parts) if reverse else parts:
            first, last = self._edges(p)
            whole = (a is None or first >= a) and (b is None or last <= b)
            if not kept and whole and offset >= p["count"]:
                offset -= p["count"]
                continue
            if limit is not None:
                want = offset + limit if want is None else want
                if want <= 0:
                    break
                want -= p["count"] if whole else 0
            kept.append(p)
        return kept, offset

    def keys(self, **options) -> DataFrame:
        """Ids of ``scan``, in key order."""
        return self.scan(**options).select(*(f"`{k}`" for k in self.primary_key))

    def _ids(self, ids) -> tuple[DataFrame, list | None]:
        """Distinct ids as key columns; also as a list if they came as one."""
        types = {k: self.schema[k].dataType for k in self.primary_key}
        if isinstance(ids, DataFrame):
            return ids.select(*(F.col(f"`{k}`").cast(t).alias(k) for k, t in types.items())).distinct(), None
        values = [tuple(i[k] for k in self.primary_key) if isinstance(i, Mapping) else tuple(i) if isinstance(self.codec, K.TupleCodec) else (i,) for i in ids]
        values = list(dict.fromkeys(values))
        for v in values:
            self.codec.encode(v if isinstance(self.codec, K.TupleCodec) else v[0])
        frame = self.store.spark.createDataFrame(values, T.StructType([T.StructField(k, t) for k, t in types.items()]))
        return frame, [v if isinstance(self.codec, K.TupleCodec) else v[0] for v in values]

    def _parts_of_keys(self, values: list) -> list[dict]:
        tokens = sorted(map(self._token, values))

        def touches(node):
            first, last = self._edges(node)
            at = bisect.bisect_left(tokens, first)
            return at < len(tokens) and tokens[at] <= last

        return list(index.entries(self.store, self.root["data"], touches))

    def _visible_of(self, ids: DataFrame, n_ids: int | None, values: list | None) -> DataFrame | None:
        """Visible rows (with NIL) of the given keys."""
        parts = self._parts_of_keys(values) if values is not None else list(index.entries(self.store, self.root["data"]))
        changes, n = self._changes()
        keys = F.broadcast(ids) if n_ids is not None and n_ids <= BROADCAST_CHANGES else ids
        base = self._stored(parts)
        base = None if base is None else base.join(keys, self.primary_key, "left_semi").select(*(f"`{c}`" for c in self.schema.names), NIL)
        changes = None if changes is None else changes.join(keys, self.primary_key, "left_semi").select(*(f"`{c}`" for c in self.schema.names), NIL, DEAD)
        return None if base is None and changes is None else overlay(base, changes, n, self.primary_key)

    def read(self, ids, fields: Iterable[str] | None = None, with_nil: bool = False) -> DataFrame:
        """Records of the ids (a list, or a DataFrame of key columns), in key order; ids
        that are missing are left out. Lists choose the partitions that can hold them."""
        chosen = self._chosen(fields)
        if not self.root["schemas"]:
            return self._shown(self._empty(chosen), with_nil)
        frame, values = self._ids(ids)
        few = values if values is not None and len(values) <= LOOKUP_KEYS else None
        df = self._visible_of(frame, None if values is None else len(values), few)
        df = self._empty(chosen) if df is None else df
        return self._shown(self._projected(df, chosen).orderBy(*self._order()), with_nil)

    def records(self, df: DataFrame | None = None) -> list[dict]:
        """Rows as dicts: a field that a record lacks is absent, a written null is there.
        For results of a size for the driver."""
        df = self.scan(with_nil=True) if df is None else df
        out = []
        for row in df.collect():
            row = row.asDict()
            nil = set(row.pop(NIL, None) or ())
            out.append({k: _plain(v) for k, v in row.items() if v is not None or k in nil})
        return out

    # -- writing ------------------------------------------------------------------------

    def _incoming(self, records) -> DataFrame:
        """A batch with NIL and SEQ, key columns checked against the codec."""
        if not isinstance(records, DataFrame):
            records = list(records)
            have = {f.name: f.dataType for f in self.schema if f.name in self.primary_key}
            return records_frame(self.store.spark, records, have, {f.name: f.dataType for f in self.schema})
        clash = [c for c in records.columns if c.startswith(RESERVED) and c not in (NIL, SEQ)]
        if clash:
            raise IllegalArgument(f"reserved column names {clash}")
        if SEQ not in records.columns:
            records = records.withColumn(SEQ, F.monotonically_increasing_id())
        return records if NIL in records.columns else records.withColumn(NIL, F.lit(None).cast("array<string>"))

    def _with_schema(self, batch: DataFrame) -> Table:
        """The table with the batch's fields in its schema, and a lexicoder."""
        new = T.StructType([f for f in batch.schema if f.name not in (NIL, SEQ, DEAD)])
        missing = [k for k in self.primary_key if k not in new.names]
        if missing:
            raise IllegalArgument(f"records without key fields {missing}")
        merged = merge_schemas(self.schema, new) if self.root["schemas"] else T.StructType([*(new[k] for k in self.primary_key), *(f for f in new if f.name not in self.primary_key)])
        merged = T.StructType([T.StructField(f.name, f.dataType, metadata={VOID: True} if is_void(f) else None) for f in merged])
        root = dict(self.root)
        if root["lexicoder"] is None:
            names = [_BY_TYPE.get(type(merged[k].dataType)) for k in self.primary_key]
            if None in names:
                raise IllegalArgument(f"no key codec for {[merged[k].dataType.simpleString() for k in self.primary_key]}")
            root["lexicoder"] = names[0] if len(names) == 1 else ["tuple", *names]
        for c, k in zip(K.parts_of(K.codec(root["lexicoder"])), self.primary_key):
            if not c.accepts(merged[k].dataType):
                raise IllegalArgument(f"{c.config!r} cannot encode {k}: {merged[k].dataType.simpleString()}")
        found = merged.jsonValue()
        if not root["schemas"] or root["schemas"][-1] != found:
            root["schemas"] = [*root["schemas"], found]
        return replace(self, root=root)

    def _checked(self, batch: DataFrame, what: list[Column]) -> tuple[DataFrame, object]:
        """The batch in the schema, once written to scratch, and aggregates over it."""
        keys = zip(K.parts_of(self.codec), self.primary_key)
        bad = F.lit(False)
        batch = conform(batch, self.schema, [NIL, SEQ])
        for c, k in keys:
            if isinstance(c, K.InstantCodec):
                batch = batch.withColumn(k, F.date_trunc("millisecond", F.col(f"`{k}`")).cast(self.schema[k].dataType))
            bad = bad | c.rejects(F.col(f"`{k}`"))
        batch = self.store.scratch(batch, "batch")
        found = batch.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"), *what).first()
        if found.bad:
            raise IllegalArgument(f"records with invalid keys for {self.codec.config!r}")
        return batch, found

    def _keys_list(self, frame: DataFrame, n: int) -> list | None:
        if n > LOOKUP_KEYS:
            return None
        return [partitions.key_values(self.codec, r, self.primary_key) for r in frame.select(*(f"`{k}`" for k in self.primary_key)).distinct().collect()]

    def insert(self, records, update_field=None, update_record=None) -> Table:
        """Upserts: each record, in order, is folded onto what its key holds by then.

        records: dicts, or a DataFrame (its order is that of SEQ, if it has it; null means
        absent unless NIL lists the field). By default new values win field by field.
        ``update_field``: a map of functions or of names in NATIVE_MERGES, or ``f(field,
        old, new)``; ``update_record``: ``f(key, old, new)``, of the encoded key and records
        without key fields, old None if there is none."""
        update = record_updater(update_field, update_record)
        batch = self._incoming(records)
        if not isinstance(records, DataFrame) and not batch.columns[:-2]:
            return self
        table = self._with_schema(batch)
        batch, found = table._checked(batch, [])
        if not found.n:
            return self
        ids = batch.select(*(f"`{k}`" for k in self.primary_key)).distinct()
        current = table._visible_of(ids, found.n, table._keys_list(batch, found.n)) if self.root["schemas"] else None
        rows, n_old = batch, 0
        if current is not None:
            current = self.store.scratch(current.withColumn(SEQ, F.lit(-1).cast("long")), "current")
            n_old = current.count()
            rows = batch.unionByName(current)
        pk, fields = self.primary_key, table.fields
        if update is None or update is default_merge:
            folded = fold.fold_default(rows, pk, fields)
        elif isinstance(update_field, Mapping) and all(isinstance(v, str) and v in NATIVE_MERGES for v in update_field.values()):
            folded = fold.fold_native(rows, pk, fields, dict(update_field))
        else:
            codec = table.codec
            encode = lambda key: partitions.encode_key(codec, key, pk)
            folded = fold.fold_python(rows, pk, fields, table.schema, update, encode)
        folded = self.store.scratch(conform(folded, table.schema, [NIL]).withColumn(DEAD, F.lit(False)), "folded")
        return table._pend(folded, folded.count(), lambda n: self.count + n - n_old)

    def _pend(self, changes: DataFrame, n: int, count) -> Table:
        pending = None if self.pending is None else conform(self.pending, self.schema, [NIL, DEAD])
        merged = later_wins(pending, changes, n, self.primary_key)
        if pending is not None:
            merged = self.store.scratch(merged, "pending")
            n_all = merged.count()
        else:
            n_all = n
        return replace(self, root=self.root | {"count": count(n)}, node_id=None, pending=merged, n_pending=n_all, dirty=True)

    def delete(self, ids) -> Table:
        """Tombstones for those ids that exist."""
        if not self.root["schemas"]:
            return self
        frame, values = self._ids(ids)
        if values == []:
            return self
        found = self._visible_of(frame, None if values is None else len(values), values if values is not None and len(values) <= LOOKUP_KEYS else None)
        if found is None:
            return self
        dead = conform(found.select(*(f"`{k}`" for k in self.primary_key)), self.schema).withColumn(NIL, F.lit(None).cast("array<string>")).withColumn(DEAD, F.lit(True))
        dead = self.store.scratch(dead, "dead")
        n = dead.count()
        return self._pend(dead, n, lambda n: self.count - n) if n else self

    def flush(self, apply_patch: bool = False) -> Table:
        """Persists local changes: as a patch over the partitions while patch and changes
        are at most ``patch_limit`` rows, else merged into the partitions."""
        return self if not self.dirty else self._flushed(apply_patch)

    def compact(self) -> Table:
        """Merges patch and changes into the partitions, also of a clean table."""
        return self._flushed(True) if self.dirty or self.root["patch"] else self

    def _flushed(self, apply_patch: bool) -> Table:
        changes, n = self._changes()
        root = dict(self.root)
        if changes is not None and (self.pending is not None or apply_patch):
            changes = self.store.scratch(changes, "changes")
            n = changes.count()
            if apply_patch or n > self.root["patch_limit"]:
                root |= {"data": self._merged(changes, n), "patch": None}
            else:
                path = self.store.new_data("patch")
                digest = changes.select(*partitions.row_digest([*sorted(self.schema.names), DEAD], {f.name: f.dataType for f in changes.schema})).first()
                changes.coalesce(max(1, n // 100_000)).write.parquet(path)
                root["patch"] = {"path": path, "count": n, "schema": len(self.root["schemas"]) - 1, "id": f"{digest.h1}:{digest.h2}"}
                if self.root["patch"] and self.root["patch"]["id"] == root["patch"]["id"]:
                    root["patch"] = self.root["patch"]
        return Table(self.store, self.name, root, self.store.put(root))

    def _merged(self, changes: DataFrame, n: int) -> str | None:
        """Root of the tree with the changes in it; untouched partitions stay as they are."""
        parts = list(index.entries(self.store, self.root["data"]))
        codec, pk, limit = self.codec, self.primary_key, self.root["partition_limit"]
        schema_id = len(self.root["schemas"]) - 1
        if not parts:
            alive = remove_tombstones(changes)
            return index.build_tree(self.store, self.root["fan_out"], [e for _, e in partitions.write_partitions(self.store, alive, codec, pk, limit, schema_id, self.root["bloom"])])
        touched = self._touched(changes, n, parts)
        spans = _spans(touched)
        rows, totals = self._span_rows(parts, spans, changes, n)
        # a span that would be too small for a partition takes in a neighbour
        while len(parts) > 1 and any(0 < totals[i] < partitions.min_limit(limit) and not (a == 0 and b == len(parts) - 1) for i, (a, b) in enumerate(spans)):
            grown = []
            for i, (a, b) in enumerate(spans):
                small = 0 < totals[i] < partitions.min_limit(limit)
                grown += range(a - 1 if small and a else a, b + 2 if small and not a and b + 1 < len(parts) else b + 1)
            spans = _spans(sorted(set(grown)))
            rows, totals = self._span_rows(parts, spans, changes, n)
        known = {p["id"]: p for p in parts}
        replaced: dict[str, list[dict]] = {}
        for a, b in spans:
            replaced |= {p["id"]: [] for p in parts[a : b + 1]}
        for run, entry in partitions.write_partitions(self.store, rows, codec, pk, limit, schema_id, self.root["bloom"]):
            replaced[parts[spans[run][0]]["id"]] = [*replaced[parts[spans[run][0]]["id"]], known.get(entry["id"], entry)]
        return index.update_tree(self.store, self.root["fan_out"], self.root["data"], replaced)

    def _span_rows(self, parts, spans, changes, n) -> tuple[DataFrame, list[int]]:
        """Visible rows of the spans with their number as RUN, and the rows of each."""
        base = self._stored([p for a, b in spans for p in parts[a : b + 1]])
        rows = overlay(base, changes, n, self.primary_key)
        runs = [0] * len(parts)
        for i, (a, b) in enumerate(spans):
            runs[a : b + 1] = [i] * (b + 1 - a)
        numbers = F.from_json(F.lit(json.dumps(runs)), T.ArrayType(T.IntegerType()))
        rows = rows.withColumn(partitions.RUN, F.get(numbers, self._place(parts)) if len(spans) > 1 else F.lit(0))
        # written once: they are counted, then sampled and read by the range shuffle
        rows = self.store.scratch(rows, "spans")
        counts = {r[0]: r[1] for r in rows.groupBy(partitions.RUN).agg(F.count("*")).collect()}
        return rows, [counts.get(i, 0) for i in range(len(spans))]

    def _touched(self, changes: DataFrame, n: int, parts: list[dict]) -> list[int]:
        """Numbers of the partitions into whose range changes fall."""
        values = self._keys_list(changes, n)
        if values is not None:
            firsts = [self._edges(p)[0] for p in parts]
            return sorted({max(0, bisect.bisect_right(firsts, self._token(v)) - 1) for v in values})
        return sorted(r[0] for r in changes.select(self._place(parts).alias(PLACE)).distinct().collect())

    # -- bulk and partitions --------------------------------------------------------------

    def load_records(self, df: DataFrame) -> Table:
        """Bulk load into an empty table: one range shuffle, no merge. Repeated keys are an
        error, wherever they fall."""
        if self.count or self.root["data"] or self.pending is not None:
            raise IllegalArgument("bulk load needs an empty table")
        return self._appended(df)

    def append(self, df: DataFrame) -> Table:
        """Adds records of keys above all others (time series): new partitions, no join."""
        return self._appended(df)

    add_partition = append

    def _appended(self, df: DataFrame) -> Table:
        if self.dirty and self.pending is not None or self.root["patch"]:
            return self.compact()._appended(df)
        batch = self._incoming(df)
        table = self._with_schema(batch)
        table_rows = conform(batch, table.schema, [NIL])
        bad = F.lit(False)
        for c, k in zip(K.parts_of(table.codec), self.primary_key):
            if isinstance(c, K.InstantCodec):
                table_rows = table_rows.withColumn(k, F.date_trunc("millisecond", F.col(f"`{k}`")).cast(table.schema[k].dataType))
            bad = bad | c.rejects(F.col(f"`{k}`"))
        table_rows = table_rows.withColumn("__v_ok", F.when(bad, F.raise_error(F.lit("ILLEGAL_KEY"))).otherwise(F.lit(True))).filter("__v_ok").drop("__v_ok")
        try:
            written = [e for _, e in partitions.write_partitions(self.store, table_rows, table.codec, self.primary_key, self.root["partition_limit"], len(table.root["schemas"]) - 1, self.root["bloom"])]
        except Exception as e:  # noqa: BLE001  py4j wraps the Java error
            raise (IllegalArgument(f"records with invalid keys for {table.codec.config!r}") if "ILLEGAL_KEY" in str(e) else e) from e
        if not written:
            return self
        edges = [table._edges(p) for p in written]
        if any(b[0] <= a[1] for a, b in zip(edges, edges[1:])) or table._repeats(written):
            raise DuplicateKeys("keys occur more than once")
        if table.root["data"] is not None:
            if edges[0][0] <= table._edges(self.store.get(table.root["data"]))[1]:
                raise RangeOverlap("partitions overlap those of the table")
            data = index.update_tree(self.store, self.root["fan_out"], table.root["data"], {}, written)
        else:
            data = index.build_tree(self.store, self.root["fan_out"], written)
        root = table.root | {"data": data, "count": self.count + sum(p["count"] for p in written)}
        return Table(self.store, self.name, root, self.store.put(root))

    def _repeats(self, written: list[dict]) -> bool:
        """Whether a key stands twice in the partitions; equal keys are neighbours of one
        partition, so each is looked at by itself."""
        rows = self._stored(written, self.primary_key)
        return not rows.groupBy(*(f"`{k}`" for k in self.primary_key)).count().filter("count > 1").isEmpty()

    def partition_like(self, df: DataFrame) -> DataFrame:
        """``df`` in as many partitions as the table has, cut at the table's own first keys
        and sorted by the key: rows of the n-th fall into the range of the table's n-th."""
        parts = list(index.entries(self.store, self.root["data"]))
        keys = {k: F.col(f"`{k}`").cast(self.schema[k].dataType) for k in self.primary_key}
        placed = df.withColumns(keys).withColumn(PLACE, self._place(parts))
        return placed.repartitionById(max(1, len(parts)), PLACE).sortWithinPartitions(*self._order()).drop(PLACE)

    def list_partitions(self) -> list[dict]:
        return [{k: p[k] for k in ("id", "count", "size", "first", "last")} for p in index.entries(self.store, self.root["data"])]

    def read_partition(self, part_id: str, fields: Iterable[str] | None = None) -> DataFrame:
        found = [p for p in index.entries(self.store, self.root["data"]) if p["id"] == part_id]
        if not found:
            raise BrokenLink(f"no partition {part_id}")
        chosen = self._chosen(fields)
        df = self._stored(found, None if chosen is None else [*self.primary_key, *chosen])
        return self._projected(df, chosen).orderBy(*self._order()).drop(NIL)

    def rebuild(self, part_ids: Iterable[str]) -> Table:
        """The table over some of its partitions; settings stay, changes go."""
        wanted = set(part_ids)
        kept = [p for p in index.entries(self.store, self.root["data"]) if p["id"] in wanted]
        if len(kept) < len(wanted):
            raise BrokenLink("unknown partitions")
        root = self.root | {"data": index.build_tree(self.store, self.root["fan_out"], kept), "patch": None, "count": sum(p["count"] for p in kept)}
        return Table(self.store, self.name, root, self.store.put(root))


def _plain(value):
    """Bytes for bytearrays, Python values for variants."""
    if isinstance(value, VariantVal):
        return value.toPython()
    return bytes(value) if isinstance(value, bytearray) else value


def _json_value(value, kind: T.DataType):
    """A key's value as Spark's JSON reader takes it for this type."""
    if isinstance(kind, T.BinaryType):
        return base64.b64encode(value).decode()
    if isinstance(kind, T.ArrayType):
        return [_json_value(v, kind.elementType) for v in value]
    if isinstance(kind, T.TimestampNTZType):
        return value.replace(tzinfo=None).isoformat(timespec="milliseconds")
    return value.isoformat(timespec="milliseconds") if isinstance(kind, T.TimestampType) else value


def _spans(numbers: list[int]) -> list[tuple[int, int]]:
    """Stretches of neighbours."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def changed_partitions(old: Table, new: Table) -> tuple[list[dict], list[dict]]:
    """Partitions that only the old, and only the new version has."""
    return index.shared_ids(new.store, old.root["data"], new.root["data"])


def changes_between(old: Table, new: Table) -> DataFrame:
    """Rows of the new version that the old has not, or not like that: only partitions
    that are not shared, and patches, are read. Column ``change``: added or updated; a row
    that is gone is ``deleted`` with its last values."""
    gone, fresh = changed_partitions(old, new)
    pk, schema = new.primary_key, new.schema

    def side(table: Table, parts: list[dict]) -> DataFrame:
        view = replace(table, root=table.root | {"schemas": [*table.root["schemas"], schema.jsonValue()]})
        changes, n = view._changes()
        base = view._stored(parts)
        df = view._empty(None) if base is None and changes is None else overlay(base, changes, n, pk)
        return df.select(*(f"`{c}`" for c in schema.names))

    # patches reach into shared partitions: their keys are looked up there as well
    keys = None
    for t in (old, new):
        changes, _ = t._changes()
        if changes is not None:
            some = changes.select(*(f"`{k}`" for k in pk))
            keys = some if keys is None else keys.unionByName(some)
    if keys is not None:
        keys = keys.distinct()
        frames = []
        for t, parts in ((old, gone), (new, fresh)):
            ids = {p["id"] for p in parts}
            rest = [p for p in index.entries(t.store, t.root["data"]) if p["id"] not in ids]
            view = replace(t, root=t.root | {"schemas": [*t.root["schemas"], schema.jsonValue()]})
            base, more = view._stored(parts), view._stored(rest)
            if more is not None:
                more = more.join(keys, pk, "left_semi").select(*(f"`{c}`" for c in schema.names), NIL)
                base = more if base is None else base.unionByName(more)
            changes, n = view._changes()
            df = view._empty(None) if base is None and changes is None else overlay(base, changes, n, pk)
            frames.append(df.select(*(f"`{c}`" for c in schema.names)))
        before, after = frames
    else:
        before, after = side(old, gone), side(new, fresh)
    # rows are compared as texts, which are made after the join and not shuffled
    a, b = (side.select(*pk, F.struct(*(f"`{c}`" for c in schema.names)).alias(name)) for side, name in ((before, "b"), (after, "a")))
    both = a.join(b, pk, "full_outer").filter("b is null or a is null or to_json(b) <> to_json(a)")
    row = F.coalesce("a", "b")
    return both.select(*(row[c].alias(c) for c in schema.names), F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise("updated").alias("change"))
