"""The reference operators as queries on the test tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.bloom import BloomFilter
from .functions.keys import IntegerCodec, codec
from .functions.records import SEQ
from .operators import index
from .operators.stats import collect_table_stats, field_stats, results_frame, validate
from .plans.connection import Connection, connect
from .plans.table import Table, changes_between
from .sources import movies
from .sources.store import Store, fresh_root
from .streaming.feeds import changes_since, upsert_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed ids of the point reads; some are missing, some repeat.
READ_IDS = [8, 1, 32, 122, 75]
ODD_IDS = [5, 5, 1, 99_999_999_999, -3, 7]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loaded(spark: SparkSession, sf_dir: str, name: str, key, where=None, **options) -> Table:
    """A bulk-loaded table of some sixteen partitions at any size."""
    df = rows_of(spark, sf_dir, name)
    df = df if where is None else df.filter(where)
    options.setdefault("partition_limit", max(1000, df.count() // 16))
    return Table.new(Store(spark, fresh_root(spark)), name, primary_key=key, **options).load_records(df)


def orders(spark, sf_dir, **options) -> Table:
    return loaded(spark, sf_dir, "orders", "o_orderkey", **options)


# -- scans and point reads --------------------------------------------------------------


@query("select * from orders")
def scan_all(spark, sf_dir):
    return orders(spark, sf_dir).scan()


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def scan_fields(spark, sf_dir):
    return orders(spark, sf_dir).scan(fields=["o_totalprice", "o_orderstatus"])


@query("select * from orders where o_orderkey between 1000 and 5000")
def scan_range(spark, sf_dir):
    return orders(spark, sf_dir).scan(min_key=1000, max_key=5000)


@query("select * from orders where o_orderkey <= 3000")
def scan_open_min(spark, sf_dir):
    return orders(spark, sf_dir).scan(max_key=3000)


@query("select * from orders where o_orderkey >= 3000")
def scan_open_max(spark, sf_dir):
    return orders(spark, sf_dir).scan(min_key=3000)


@query("select * from orders order by o_orderkey limit 100 offset 1000")
def scan_offset_limit(spark, sf_dir):
    return orders(spark, sf_dir).scan(offset=1000, limit=100)


@query("select * from orders where o_orderkey between 500 and 9000 order by o_orderkey limit 70 offset 300")
def scan_range_offset_limit(spark, sf_dir):
    return orders(spark, sf_dir).scan(min_key=500, max_key=9000, offset=300, limit=70)


@query("select * from orders order by o_orderkey desc limit 50")
def scan_reverse(spark, sf_dir):
    return orders(spark, sf_dir).scan(reverse=True, limit=50)


@query("select o_orderkey from orders where o_orderkey between 100 and 2000")
def keys_range(spark, sf_dir):
    return orders(spark, sf_dir).keys(min_key=100, max_key=2000)


@query(f"select * from orders where o_orderkey in ({', '.join(map(str, READ_IDS))})")
def read_batch(spark, sf_dir):
    return orders(spark, sf_dir).read(READ_IDS)


@query(f"select o_orderkey, o_totalprice from orders where o_orderkey in ({', '.join(map(str, ODD_IDS))})")
def read_missing_and_dup_ids(spark, sf_dir):
    return orders(spark, sf_dir).read(ODD_IDS, fields=["o_totalprice"])


@query("select * from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def read_ids_frame(spark, sf_dir):
    ids = rows_of(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, sf_dir).read(ids)


@query("select o_orderkey from orders where false")
def project_only_pk_is_empty(spark, sf_dir):
    return orders(spark, sf_dir).scan(fields=["o_orderkey"])


@query("select d.doc_id, l.quality, l.toxic from documents d join labels l using (doc_id) where quality is not null or toxic is not null")
def project_drops_records_without_fields(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "lang").join(rows_of(spark, sf_dir, "labels"), "doc_id", "left")
    table = Table.new(Store(spark, fresh_root(spark)), "docs", primary_key="doc_id").load_records(docs)
    return table.scan(fields=["quality", "toxic"])


@query("select c_custkey, c_name, c_acctbal from customer where c_name between 'Customer#000000100' and 'Customer#000000900'")
def string_key_range(spark, sf_dir):
    table = loaded(spark, sf_dir, "customer", "c_name")
    return table.scan(fields=["c_custkey", "c_acctbal"], min_key="Customer#000000100", max_key="Customer#000000900").select("c_custkey", "c_name", "c_acctbal")


@query("select conv_id, turn, role, text from conversations where (conv_id > 10 or (conv_id = 10 and turn >= 1)) and (conv_id < 20 or (conv_id = 20 and turn <= 2))")
def composite_key_range(spark, sf_dir):
    return loaded(spark, sf_dir, "conversations", ["conv_id", "turn"]).scan(min_key=(10, 1), max_key=(20, 2))


@query("select * from orders order by o_orderkey desc limit 20")
def reverse_key_top(spark, sf_dir):
    return orders(spark, sf_dir, lexicoder=("reverse", "integer")).scan(limit=20)


@query("select event_id, date_trunc('millisecond', ts) as ts, user_id, event_type from events order by ts, event_id limit 500 offset 2000")
def instant_key_order(spark, sf_dir):
    table = loaded(spark, sf_dir, "events", ["ts", "event_id"])
    return table.scan(fields=["user_id", "event_type"], offset=2000, limit=500).select("event_id", "ts", "user_id", "event_type")


@query("select o_orderkey, printf('%02X', 127 + n) || lpad(printf('%X', o_orderkey), (2 * n)::int, '0') as key_hex from (select o_orderkey, case when o_orderkey < 256 then 1 when o_orderkey < 65536 then 2 when o_orderkey < 16777216 then 3 else 4 end as n from orders)")
def key_encode_integer(spark, sf_dir):
    return rows_of(spark, sf_dir, "orders").select("o_orderkey", F.hex(IntegerCodec().column(F.col("o_orderkey"))).alias("key_hex"))


#: The integer key of o_custkey and the escape of bytes, as DuckDB expressions.
_CUST_HEX = "(case when o_custkey < 256 then '80' || lpad(printf('%X', o_custkey), 2, '0') when o_custkey < 65536 then '81' || lpad(printf('%X', o_custkey), 4, '0') else '82' || lpad(printf('%X', o_custkey), 6, '0') end)"
_ESCAPED = "replace(replace(replace(regexp_replace({}, '(..)', '\\1 ', 'g'), '01 ', '01 02 '), '00 ', '01 01 '), ' ', '')"


@query(f"select o_orderkey, hex(o_orderpriority) as text_hex, translate(hex(o_orderpriority), '0123456789ABCDEF', 'FEDCBA9876543210') as reverse_hex, hex(o_orderpriority) || '00' || {_ESCAPED.format(_CUST_HEX)} as tuple_hex, {_ESCAPED.format(_CUST_HEX)} || '00' || {_ESCAPED.format(_CUST_HEX)} as seq_hex from orders")
def key_encode_composed(spark, sf_dir):
    text, cust = F.col("o_orderpriority"), F.col("o_custkey")
    return rows_of(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.hex(codec("string").column(text)).alias("text_hex"),
        F.hex(codec(("reverse", "string")).column(text)).alias("reverse_hex"),
        F.hex(codec(("tuple", "string", "integer")).columns([text, cust])).alias("tuple_hex"),
        F.hex(codec(("seq", "integer")).column(F.array(cust, cust))).alias("seq_hex"),
    )


@query("select event_id, row_number() over (order by value - 50, event_id) as place from events where value is not null qualify place <= 500")
def key_order_float(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "events").filter("value is not null").select("event_id", codec("float").column(F.col("value") - 50).alias("key"))
    top = rows.orderBy("key", "event_id").limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy("key", "event_id"))).select("event_id", "place")


@query("select n_nationkey, true as held from nation")
def bloom_union(spark, sf_dir):
    keys = {r.n_nationkey: codec("string").encode(r.n_name) for r in rows_of(spark, sf_dir, "nation").collect()}
    even, odd = (BloomFilter.create(50).into(v for k, v in keys.items() if k % 2 == rest) for rest in (0, 1))
    both = even.merge(odd)
    return spark.createDataFrame([(k, v in both) for k, v in keys.items()], "n_nationkey long, held boolean")


# -- writes, patches, merges ------------------------------------------------------------

_PATCHED = "select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 7 = 0 then 0.0 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 11 <> 0"


def _patched(spark, sf_dir, **options) -> Table:
    rows = rows_of(spark, sf_dir, "orders")
    zero = rows.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    return orders(spark, sf_dir, **options).insert(zero).delete(rows.filter("o_orderkey % 11 = 0").select("o_orderkey"))


@query(_PATCHED)
def pending_overlay(spark, sf_dir):
    return _patched(spark, sf_dir).scan()


@query(_PATCHED)
def patch_overlay(spark, sf_dir):
    return _patched(spark, sf_dir, patch_limit=10_000_000).flush().scan()


@query(_PATCHED)
def patch_compacted(spark, sf_dir):
    return _patched(spark, sf_dir, patch_limit=0).flush().scan()


@query("select o_orderkey, coalesce(u.p, o_orderpriority) as o_orderpriority from orders left join (select o_orderkey as k, 'URGENT' as p from orders where o_orderkey between 2000 and 2300) u on k = o_orderkey")
def update_few_partitions(spark, sf_dir):
    some = rows_of(spark, sf_dir, "orders").filter("o_orderkey between 2000 and 2300").select("o_orderkey", F.lit("URGENT").alias("o_orderpriority"))
    return orders(spark, sf_dir).insert(some).compact().scan(fields=["o_orderpriority"])


@query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, arg_max(event_id, event_id) as event_id from events group by user_id")
def insert_fold_last(spark, sf_dir):
    batch = rows_of(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", F.col("event_id").alias(SEQ))
    return Table.new(Store(spark, fresh_root(spark)), "users", primary_key="user_id").insert(batch).scan()


@query("select user_id, count(*) as n, max(value) as most, min(value) as least from events group by user_id")
def insert_fold_named(spark, sf_dir):
    batch = rows_of(spark, sf_dir, "events").select("user_id", F.lit(1).cast("long").alias("n"), F.col("value").alias("most"), F.col("value").alias("least"), F.col("event_id").alias(SEQ))
    half = batch.filter(F.col(SEQ) % 2 == 0), batch.filter(F.col(SEQ) % 2 == 1)
    named = {"n": "sum", "most": "max", "least": "min"}
    return Table.new(Store(spark, fresh_root(spark)), "users", primary_key="user_id").insert(half[0], update_field=named).insert(half[1], update_field=named).scan()


def _tally(key, old, new):
    return {"n": (old["n"] if old else 0) + 1, "best": max(old["best"], new["best"]) if old else new["best"]}


@query("select c_nationkey, count(*) as n, max(c_acctbal) as best from customer group by c_nationkey")
def insert_custom_record(spark, sf_dir):
    batch = rows_of(spark, sf_dir, "customer").select("c_nationkey", F.lit(1).cast("long").alias("n"), F.col("c_acctbal").alias("best"))
    return Table.new(Store(spark, fresh_root(spark)), "nations", primary_key="c_nationkey").insert(batch, update_record=_tally).scan()


@query("select count(*) as maintained, count(*) as visible from orders where o_orderkey % 3 <> 0")
def delete_then_count(spark, sf_dir):
    table = orders(spark, sf_dir).delete(rows_of(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey"))
    return table.scan(ordered=False).agg(F.lit(table.count).cast("long").alias("maintained"), F.count("*").alias("visible"))


@query("select * from orders")
def insert_into_between_partitions(spark, sf_dir):
    table = loaded(spark, sf_dir, "orders", "o_orderkey", where="o_orderkey % 2 = 0")
    return table.insert(rows_of(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1")).scan()


@query("select event_type, count(*) as n, max(event_id) as last from events group by event_type")
def append_time_series(spark, sf_dir):
    mid = rows_of(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0]
    table = loaded(spark, sf_dir, "events", "event_id", where=f"event_id <= {mid}")
    table = table.append(rows_of(spark, sf_dir, "events").filter(f"event_id > {mid}"))
    return table.scan(ordered=False).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("select doc_id, lang, source, quality, toxic from documents left join labels using (doc_id)")
def left_join_merge(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    merged = docs.join(rows_of(spark, sf_dir, "labels"), "doc_id", "left")
    return Table.new(Store(spark, fresh_root(spark)), "docs", primary_key="doc_id", families={"labels": ["quality", "toxic"]}).load_records(merged).scan()


# -- versions and catalog ---------------------------------------------------------------


def _versions(spark, sf_dir) -> Connection:
    """shop: version 1 empty, 2 all orders, 3 without every fifth, every tenth raised."""
    connection = connect(spark, fresh_root(spark))
    db = connection.create_db("shop", title="orders")
    rows = rows_of(spark, sf_dir, "orders")
    table = Table.new(connection.store, "orders", primary_key="o_orderkey", partition_limit=max(1000, rows.count() // 16)).load_records(rows)
    db = connection.commit(db.set_table("orders", table))
    change = rows.filter("o_orderkey % 10 = 1").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    table = table.insert(change).delete(rows.filter("o_orderkey % 5 = 0").select("o_orderkey"))
    connection.commit(db.set_table("orders", table))
    return connection


@query("select * from orders")
def as_of_version(spark, sf_dir):
    return _versions(spark, sf_dir).open_db("shop", version=2).get_table("orders").scan()


@query("select * from orders")
def as_of_instant(spark, sf_dir):
    connection = _versions(spark, sf_dir)
    at = connection.history("shop")[1]["committed_at"]
    return connection.open_db("shop", at=at).get_table("orders").scan()


@query("select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 10 = 1 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 5 <> 0")
def latest_version(spark, sf_dir):
    return _versions(spark, sf_dir).open_db("shop").get_table("orders").scan()


@query("select o_orderkey, case when o_orderkey % 10 = 1 then o_totalprice + 1 else o_totalprice end as o_totalprice, case when o_orderkey % 5 = 0 then 'deleted' else 'updated' end as change from orders where o_orderkey % 5 = 0 or o_orderkey % 10 = 1")
def diff_versions(spark, sf_dir):
    connection = _versions(spark, sf_dir)
    old, new = (connection.open_db("shop", version=v).get_table("orders") for v in (2, 3))
    return changes_between(old, new.compact()).select("o_orderkey", "o_totalprice", "change")


@query(ORACLES["diff_versions"])
def diff_patched_versions(spark, sf_dir):
    connection = _versions(spark, sf_dir)
    old, new = (connection.open_db("shop", version=v).get_table("orders") for v in (2, 3))
    return changes_between(old, new).select("o_orderkey", "o_totalprice", "change")


@query("select count(*) as n, 'added' as change from orders where o_orderkey % 5 <> 0")
def incremental_read(spark, sf_dir):
    connection = _versions(spark, sf_dir)
    changes, _ = changes_since(connection, "shop", "orders", 0)
    return changes.groupBy("change").agg(F.count("*").alias("n")).select("n", "change")


@query("select * from (values ('fork', 1, true), ('fork', 2, false), ('shop', 1, true), ('shop', 2, true), ('shop', 3, true)) t(name, version, alive)")
def fork_drop_history(spark, sf_dir):
    connection = _versions(spark, sf_dir)
    connection.commit("fork", connection.open_db("shop", version=2))
    connection.drop_db("fork")
    return connection.versions().select("name", F.col("version").cast("int").alias("version"), F.col("node_id").isNotNull().alias("alive"))


@query("select 'orders' as name, count(*) as records from orders where o_orderkey % 5 <> 0")
def list_tables(spark, sf_dir):
    found = _versions(spark, sf_dir).open_db("shop").list_tables()
    return spark.createDataFrame([(t["name"], t["count"]) for t in found], "name string, records long")


@query("select * from (values ('shop', 3), ('spare', 1)) t(name, version)")
def list_databases(spark, sf_dir):
    connection = _versions(spark, sf_dir)
    for name in ("other", "sold", "spare", "sum"):
        connection.create_db(name)
    connection.drop_db("sold")
    found = connection.list_dbs("s", limit=2)
    return spark.createDataFrame([(r["name"], r["version"]) for r in found], "name string, version int")


@query("select o_orderkey, 0.0 as o_totalprice from orders where o_orderkey % 2 = 1")
def rename_update_drop_table(spark, sf_dir):
    connection, rows = connect(spark, fresh_root(spark)), rows_of(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    db = connection.create_db("shop").set_table("first", Table.new(connection.store, "first", primary_key="o_orderkey").load_records(rows)).create_table("gone")
    db = db.rename_table("first", "orders").update_table("orders", Table.delete, rows.filter("o_orderkey % 2 = 0").select("o_orderkey")).drop_table("gone")
    db = connection.load_database(connection.commit(db).node_id)
    (only,) = db.list_tables()
    return db.get_table(only["name"]).scan()


# -- partitions, statistics, checks -----------------------------------------------------


@query("select sum(1)::bigint as partitions, sum(n)::bigint as records from (select unnest(case when c < l + h then case when c > l then [ceil(c / 2.0), floor(c / 2.0)] else [c] end else list_concat(list_transform(range(((c - l - h) // l + 1)::bigint), lambda i: l), case when r > l then [ceil(r / 2.0), floor(r / 2.0)] else [r] end) end) as n from (select c, l, h, c - ((c - l - h) // l + 1) * l as r from (select c, greatest(1000, c // 16) as l, ceil(greatest(1000, c // 16) / 2.0)::bigint as h from (select count(*) as c from orders))))")
def list_partitions(spark, sf_dir):
    found = orders(spark, sf_dir).list_partitions()
    return spark.createDataFrame([(len(found), sum(p["count"] for p in found))], "partitions long, records long")


@query("select * from orders")
def rebuild_partitions(spark, sf_dir):
    table = orders(spark, sf_dir)
    return table.rebuild([p["id"] for p in table.list_partitions()]).scan()


@query("select * from orders order by o_orderkey limit (select greatest(1000, count(*) // 16) from orders)")
def read_partition(spark, sf_dir):
    table = orders(spark, sf_dir)
    return table.read_partition(table.list_partitions()[0]["id"])


@query("select count(*) as records, count(*) as in_place from orders")
def partition_like(spark, sf_dir):
    table = orders(spark, sf_dir)
    edges = [(i, *(table.codec.decode(bytes.fromhex(p[e])) for e in ("first", "last"))) for i, p in enumerate(table.list_partitions())]
    edges = spark.createDataFrame(edges, "part int, lo long, hi long")
    placed = table.partition_like(rows_of(spark, sf_dir, "orders")).select(F.spark_partition_id().alias("part"), "o_orderkey")
    return placed.join(edges, "part").agg(F.count("*").alias("records"), F.count_if(F.col("o_orderkey").between(F.col("lo"), F.col("hi"))).alias("in_place"))


@query("select count(*) as records, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders")
def table_stats(spark, sf_dir):
    table = orders(spark, sf_dir)
    stats, parts = collect_table_stats(table), table.list_partitions()
    decode = lambda h: table.codec.decode(bytes.fromhex(h))
    return spark.createDataFrame([(stats["partition"]["records"]["sum"], decode(parts[0]["first"]), decode(parts[-1]["last"]))], "records long, first_key long, last_key long")


@query("select field, 'base' as family, n as records from (select count(o_custkey) as o_custkey, count(o_orderstatus) as o_orderstatus, count(o_totalprice) as o_totalprice, count(o_orderdate) as o_orderdate, count(o_orderpriority) as o_orderpriority from orders) unpivot (n for field in (o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))")
def stats_by_field(spark, sf_dir):
    return field_stats(orders(spark, sf_dir)).drop("share")


@query("select 0::bigint as failed")
def validate_table(spark, sf_dir):
    failed = [r for r in validate(_patched(spark, sf_dir, patch_limit=0).flush()) if r.state in ("fail", "error")]
    return spark.createDataFrame([(len(failed),)], "failed long")


@query("select * from (values ('count is the partitions'' sum', 1), ('first and last key are those of the rows', 1), ('rows are as many as counted', 1)) t(message, failed)")
def validate_broken_table(spark, sf_dir):
    table = orders(spark, sf_dir)
    parts = list(index.entries(table.store, table.root["data"]))
    parts[0] = parts[0] | {"count": parts[0]["count"] - 1}
    parts[1] = parts[1] | {"last": parts[1]["first"]}
    broken = Table(table.store, "orders", table.root | {"data": index.build_tree(table.store, table.root["fan_out"], parts)})
    return results_frame(spark, validate(broken)).filter("state = 'fail'").groupBy("message").agg(F.count("*").cast("int").alias("failed"))


# -- analytics on scans -----------------------------------------------------------------


@query("select c.c_custkey, c.c_name, n from (select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 10) t join customer c on c.c_custkey = t.o_custkey")
def most_tagged_like(spark, sf_dir):
    top = orders(spark, sf_dir).scan(fields=["o_custkey"], ordered=False).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_custkey").limit(10)
    customers = loaded(spark, sf_dir, "customer", "c_custkey")
    return F.broadcast(top).join(customers.scan(fields=["c_name"], ordered=False), "c_custkey").select("c_custkey", "c_name", "n")


@query("select user_id, round(sum(value) / count(value), 6) as rating from events group by user_id having count(value) >= 5 order by sum(value) / count(value) desc, user_id limit 10")
def best_rated_like(spark, sf_dir):
    scores = loaded(spark, sf_dir, "events", ["user_id", "event_id"]).scan(fields=["value"], ordered=False).groupBy("user_id").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    return scores.filter("n >= 5").select("user_id", (F.col("s") / F.col("n")).alias("r")).orderBy(F.desc("r"), "user_id").limit(10).select("user_id", F.round("r", 6).alias("rating"))


# -- the example data set, of CSV files made from the test tables --------------------------

_TITLES = "case when c_custkey % 3 = 0 then c_name else c_name || ' (' || (1950 + c_custkey % 70) || ')' end"


def _csv(spark, sf_dir) -> str:
    folder = fresh_root(spark, "csv")
    customer, rows, events = (rows_of(spark, sf_dir, n) for n in ("customer", "orders", "events"))
    files = {
        "movies": customer.selectExpr("c_custkey as movieId", f"{_TITLES} as title", "case when c_custkey % 2 = 0 then 'Sci-Fi|Drama, Old|Sci-Fi' else '' end as genres"),
        "links": customer.filter("c_custkey % 5 <> 0").selectExpr("c_custkey as movieId", "lpad(c_custkey, 7, '0') as imdbId", "case when c_custkey % 2 = 0 then c_custkey end as tmdbId"),
        "tags": rows.selectExpr("o_orderkey as userId", "o_custkey as movieId", "o_orderpriority as tag", "o_orderkey as timestamp"),
        "ratings": events.filter("value is not null").selectExpr("event_id as userId", "user_id as movieId", "value as rating", "event_id as timestamp"),
    }
    for name, df in files.items():
        df.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")
    return folder


@query("select c_custkey as id, c_name as title, case when c_custkey % 3 <> 0 then 1950 + c_custkey % 70 end as year, case when c_custkey % 2 = 0 then 'sci_fi,drama_old' end as genres, case when c_custkey % 5 <> 0 then c_custkey end as imdb_id, case when c_custkey % 5 <> 0 and c_custkey % 2 = 0 then c_custkey end as tmdb_id from customer")
def movie_records(spark, sf_dir):
    found = movies.movie_records(spark, _csv(spark, sf_dir))
    return found.withColumn("genres", F.nullif(F.array_join("genres", ","), F.lit("")))


@query("select id, c_name as title, n as tags from (select o_custkey as id, count(distinct o_orderkey) as n from orders group by o_custkey order by n desc, id limit 10) join customer on c_custkey = id")
def movies_most_tagged(spark, sf_dir):
    db = movies.load_dataset(connect(spark, fresh_root(spark)), _csv(spark, sf_dir), out=lambda line: None)
    return movies.most_tagged(db).select("id", "title", "tags")


@query("select user_id as id, round(sum(value) / count(value), 6) as rating, epoch_us(to_timestamp(min(event_id))) as first_us from events where value is not null group by user_id having count(value) >= 5")
def movies_rated(spark, sf_dir):
    store = Store(spark, fresh_root(spark))
    table = Table.new(store, "ratings", **movies.RATINGS).load_records(movies.rating_records(spark, _csv(spark, sf_dir)))
    found = table.scan(ordered=False).groupBy(F.col("movie").alias("id")).agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.unix_micros(F.min("time")).alias("first_us"))
    return found.filter("n >= 5").select("id", F.round(F.col("s") / F.col("n"), 6).alias("rating"), "first_us")


@query("select user_id, count(*) as n, max(value) as most from events group by user_id")
def stream_upsert(spark, sf_dir):
    connection = connect(spark, fresh_root(spark))
    connection.commit("live", connection.create_db("live").create_table("users", primary_key="user_id"))
    events = rows_of(spark, sf_dir, "events")
    inbox = fresh_root(spark, "inbox")  # a stream reads a folder; the table may be one file
    events.write.parquet(inbox)
    stream = spark.readStream.schema(events.schema).parquet(inbox)
    stream = stream.select("user_id", F.lit(1).cast("long").alias("n"), F.col("value").alias("most"))
    upsert_stream(stream, connection, "live", "users", fresh_root(spark, "stream"), update_field={"n": "sum", "most": "max"}).awaitTermination()
    return connection.open_db("live").get_table("users").scan()
