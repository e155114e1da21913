"""Writing sorted partitions of exact sizes, without a single-task window.

Rows are range-shuffled and sorted once and written to scratch with their place in the
task's output. Row counts of the tasks (all that comes to the driver) turn places into row
numbers, and these into partitions; the second write only copies. Row digests add up to a
partition's content id, so that equal content is recognised whatever file holds it.
"""

from __future__ import annotations

import bisect
import hashlib
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions.records import DEAD, NIL, SEQ

#: Rows of a partition. Tables of tests and small tables set less.
LIMIT = 1_000_000
AT, PART, RUN = "__v_at", "__v_part", "__v_run"
#: Bytes of input files for each task of the sort, at most.
TASK_BYTES = 256 << 20


def max_limit(limit: int) -> int:
    return limit


def min_limit(limit: int) -> int:
    return ceil(limit / 2)


def chunk_plan(total: int, limit: int) -> tuple[int, int, int]:
    """(full partitions, rows of the next, rows of the last): full ones while one and a
    half are left, then what is left in one, or in halves."""
    full = 0 if total < limit + min_limit(limit) else (total - limit - min_limit(limit)) // limit + 1
    rest = total - full * limit
    return (full, ceil(rest / 2), rest // 2) if rest > limit else (full, rest, 0)


def source_bytes(df: DataFrame) -> int:
    """Size of the files and relations that a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(b for b in known if b < 1 << 60)  # an unknown size reads as the largest


def key_order(codec: K.Codec, primary_key: list[str]) -> list[Column]:
    return [F.col(f"`{k}`").desc() if c.descending else F.col(f"`{k}`").asc() for c, k in zip(K.parts_of(codec), primary_key)]


def row_digest(columns: list[str], types: dict[str, T.DataType]) -> list[Column]:
    """Two 64-bit numbers from a record's canonical text, as aggregates over a group."""
    shown = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if not isinstance(types[c], T.BinaryType) else F.hex(f"`{c}`") for c in columns]
    text = F.concat_ws("\x1f", *(F.coalesce(s, F.lit("\x00")) for s in shown), F.array_join(F.sort_array(F.coalesce(F.col(NIL), F.array().cast("array<string>"))), ","))
    digest = F.sha2(text, 256)
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")

    def total(value: Column) -> Column:  # 60 bits as two sums of longs, which no number of rows here overflows
        high, low = (F.sum(v).cast("decimal(38,0)") for v in (F.shiftright(value, 30), value.bitwiseAND(F.lit((1 << 30) - 1))))
        return (high * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("decimal(38,0)").cast("string")

    return [total(half(1)).alias("h1"), total(half(16)).alias("h2")]


def write_partitions(store, df: DataFrame, codec: K.Codec, primary_key: list[str], limit: int, schema_id: int, bloom: bool = False) -> list[tuple[int, dict]]:
    """(run, entry) of each written partition, in key order. ``df`` has the key fields, any
    fields, NIL and, optionally, RUN: neighbours of different runs never share a
    partition, and each run is cut by itself. ``bloom``: files get Parquet Bloom filters of
    the key fields, which point reads then use."""
    spark, order = store.spark, key_order(codec, primary_key)
    df = df if RUN in df.columns else df.withColumn(RUN, F.lit(0))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(source_bytes(df) / TASK_BYTES))
    held = store.scratch(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id()), "sorted")
    task = F.shiftrightunsigned(AT, 33)
    counts = held.groupBy(task.alias("task"), RUN).agg(F.count("*").alias("n")).orderBy("task", RUN).collect()
    if not counts:
        return []
    totals: dict[int, int] = {}
    for r in counts:
        totals[r[RUN]] = totals.get(r[RUN], 0) + r.n
    plans = {run: chunk_plan(total, limit) for run, total in totals.items()}
    first, at = {}, 0
    for run in sorted(totals):
        first[run], at = at, at + plans[run][0] + (1 if plans[run][1] else 0) + (1 if plans[run][2] else 0)
    rows, seen, in_task = [], dict.fromkeys(totals, 0), {}
    begins: dict[int, list[tuple[int, int, int]]] = {run: [] for run in totals}  # number, task, shift
    for r in counts:
        full, second, _ = plans[r[RUN]]
        rows.append((r.task, r[RUN], seen[r[RUN]] - in_task.get(r.task, 0), full, full * limit + second, first[r[RUN]]))
        begins[r[RUN]].append((seen[r[RUN]], r.task, rows[-1][2]))
        seen[r[RUN]] += r.n
        in_task[r.task] = in_task.get(r.task, 0) + r.n
    # a row for each task and run, far below what a broadcast may hold
    where = spark.createDataFrame(rows, f"__v_task long, {RUN} int, __v_shift long, __v_full long, __v_edge long, __v_first long")
    number = F.col(AT).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__v_shift")
    part = F.col("__v_first") + F.when(number >= F.col("__v_edge"), F.col("__v_full") + 1).otherwise(F.least(F.floor(number / limit), F.col("__v_full")))
    kept = [c for c in held.columns if c not in (AT, RUN, DEAD, SEQ)]
    cut = held.withColumn("__v_task", task).join(F.broadcast(where), ["__v_task", RUN]).select(*(F.col(f"`{c}`") for c in kept), part.cast("long").alias(PART), RUN)
    path = store.new_data("parts")
    # the order that the writer needs, so that it does not sort once more
    writer = cut.sortWithinPartitions(PART, RUN, *order).write.partitionBy(PART, RUN)
    for k in primary_key if bloom else ():
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", str(limit))
    writer.parquet(path)
    # places of the first and the last row of each partition
    ends: list[tuple[int, int, bool]] = []
    for run, (full, second, last) in plans.items():
        at = 0
        for i, size in enumerate([limit] * full + [size for size in (second, last) if size]):
            for row, is_last in ((at, False), (at + size - 1, True)):
                _, at_task, shift = begins[run][bisect.bisect_right(begins[run], row, key=lambda b: b[0]) - 1]
                ends.append(((at_task << 33) + row - shift, first[run] + i, is_last))
            at += size
    return describe(store, path, df.select(*kept).schema, edge_keys(held, ends, primary_key), codec, primary_key, schema_id)


def edge_keys(held: DataFrame, ends: list[tuple[int, int, bool]], primary_key: list[str]) -> dict[int, list]:
    """First and last key of each partition, looked up by the places of these rows."""
    wanted = held.sparkSession.createDataFrame(ends, f"{AT} long, {PART} long, __v_last boolean")
    found = held.select(AT, F.struct(*(F.col(f"`{k}`") for k in primary_key)).alias("key")).join(F.broadcast(wanted), AT).select(PART, "__v_last", "key").collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(r[PART], [None, None])[r["__v_last"]] = r["key"]
    return out


def described(spark, path: str, schema: T.StructType) -> DataFrame:
    """Size, rows and digests of each partition below ``path``: all are numbers, so that
    Spark hashes the groups and does not sort a task's rows by them."""
    full = T.StructType([*schema.fields, T.StructField(PART, T.LongType()), T.StructField(RUN, T.IntegerType())])
    types = {f.name: f.dataType for f in schema}
    size = F.sum(F.when(F.col("_metadata.row_index") == 0, F.col("_metadata.file_size")))  # once for each file
    return spark.read.schema(full).parquet(path).groupBy(PART, RUN).agg(size.alias("size"), F.count("*").alias("n"), *row_digest(sorted(c for c in schema.names if c != NIL), types))


def describe(store, path: str, schema: T.StructType, edges: dict[int, list], codec: K.Codec, primary_key: list[str], schema_id: int) -> list[tuple[int, dict]]:
    """Entries of the partitions below ``path``, by one aggregate over it and the keys of
    their first and last rows."""
    columns = sorted(c for c in schema.names if c != NIL)
    out, found = [], described(store.spark, path, schema).orderBy(PART).collect()
    for r in found:
        out.setdefault(r[PART], [None, None])[r["__v_last"]] = r["key"]
    return out


def describe(store, path: str, schema: T.StructType, edges: dict[int, list], codec: K.Codec, primary_key: list[str], schema_id: int) -> list[tuple[int, dict]]:
    """Entries of the partitions below ``path``, by one aggregate over it and the keys of
    their first and last rows."""
    spark = store.spark
    full = T.StructType([*schema.fields, T.StructField(PART, T.LongType()), T.StructField(RUN, T.IntegerType())])
    data = spark.read.schema(full).parquet(path)
    types = {f.name: f.dataType for f in schema}
    columns = sorted(c for c in schema.names if c != NIL)
    # numbers alone, so that they are hashed, not sorted; each file has one first row
    size = F.sum(F.when(F.col("_metadata.row_index") == 0, F.col("_metadata.file_size")))
    parts = data.groupBy(PART, RUN).agg(size.alias("size"), F.count("*").alias("n"), *row_digest(columns, types))
    out, found = [], parts.orderBy(PART).collect()
    for r in found:
        lo, hi = (encode_key(codec, k, primary_key).hex() for k in edges[r[PART]])
        content = hashlib.sha256(f"{r.n}|{lo}|{hi}|{r.h1}|{r.h2}|{','.join(columns)}".encode()).hexdigest()
        out.append((r[RUN], {"type": "partition", "id": content, "count": r.n, "size": r["size"], "first": lo, "last": hi, "path": f"{path}/{PART}={r[PART]}/{RUN}={r[RUN]}", "of": len(found), "schema": schema_id}))
    return out


#: Partitions of one write from which their folder is read as a whole, if all are wanted.
WHOLE_FOLDER = 32


def folders(parts: list[dict]) -> list[list[str]]:
    """Paths to read the partitions by, a list for each read: a folder that is wanted whole
    is one path, so that the driver lists it once; others go path by path, together."""
    by_folder: dict[str, list[dict]] = {}
    for p in parts:
        by_folder.setdefault(p["path"].rsplit("/", 2)[0], []).append(p)
    whole = [f for f, some in by_folder.items() if len(some) == some[0]["of"] >= WHOLE_FOLDER]
    rest = [p["path"] for p in parts if p["path"].rsplit("/", 2)[0] not in whole]
    return [[f] for f in whole] + ([rest] if rest else [])


def rankable(value: Column, kind: T.DataType, codec: K.Codec) -> Column:
    """What min and max rank as the key's order does."""
    if not codec.descending:
        return value
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # flipped bytes and a high end mark, so that a prefix comes after what it begins
        return F.concat(F.translate(F.hex(value), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(value.cast("timestamp"))
    return -value


def key_values(codec: K.Codec, row, primary_key: list[str]):
    values = [row[k] for k in primary_key]
    values = [bytes(v) if isinstance(v, bytearray) else v for v in values]
    return values[0] if not isinstance(codec, K.TupleCodec) else tuple(values)


def encode_key(codec: K.Codec, row, primary_key: list[str]) -> bytes:
    return codec.encode(key_values(codec, row, primary_key))
