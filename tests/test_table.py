import random

import pytest
from pyspark.sql import functions as F

from vellum.errors import BadTarget, BrokenLink, DuplicateKeys, IllegalArgument, RangeOverlap
from vellum.operators import index
from vellum.plans import table as module
from vellum.operators.stats import _rows_of_folders, _stretches, collect_table_stats, field_stats, print_table_stats, stats_frame, validate, view_table
from vellum.plans.table import Table, _plain, changes_between
from vellum.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def made(store, **options):
    options = {"primary_key": "id", "fan_out": 5, "partition_limit": 5, "patch_limit": 10, "families": {"bc": ["b", "c"]}} | options
    return Table.new(store, "t", **options)


def test_records_and_nulls(store):
    t = made(store).insert([{"id": 1, "a": 1, "b": None}, {"id": 2}, {"id": 1, "c": "x"}])
    assert t.count == 2 and t.records() == [{"id": 1, "a": 1, "b": None, "c": "x"}, {"id": 2}]
    t = t.flush()
    assert t.records() == [{"id": 1, "a": 1, "b": None, "c": "x"}, {"id": 2}] and not t.dirty
    assert t.records(t.scan(fields=["b"], with_nil=True)) == [{"id": 1, "b": None}]
    assert t.scan(fields=["id"]).count() == 0 and t.scan(fields=["e"]).count() == 0 and t.scan(fields=[]).count() == 2
    assert t.scan(fields=["a", "e"]).columns == ["id", "a"]
    assert t.flush() is t and t.insert([]) is t and t.delete([99]) is t and t.delete([]) is t


def test_mixed_types(store):
    t = made(store).insert([{"id": 1, "a": 1}]).flush(apply_patch=True).insert([{"id": 2, "a": "two"}, {"id": 3, "a": [1, "x"]}, {"id": 4, "a": None}])
    want = [{"id": 1, "a": 1}, {"id": 2, "a": "two"}, {"id": 3, "a": [1, "x"]}, {"id": 4, "a": None}]
    assert t.records() == want and t.compact().records() == want


def test_a_null_column_takes_the_first_real_type(store):
    t = made(store).insert([{"id": 1, "a": None}]).flush(apply_patch=True).insert([{"id": 2, "a": 7}]).compact()
    assert t.records() == [{"id": 1, "a": None}, {"id": 2, "a": 7}] and t.schema["a"].dataType.simpleString() == "bigint"


def test_updates(store):
    t = made(store).insert([{"id": 1, "n": 1, "x": 5}])
    assert t.records(t.insert([{"id": 1, "n": 2}], update_field={"n": lambda a, b: a * 10 + b}).scan(with_nil=True)) == [{"id": 1, "n": 12, "x": None}]
    seen = t.insert([{"id": 1, "n": 2}, {"id": 2, "n": 3}], update_record=lambda k, old, new: {"n": len(k) + (old or {}).get("n", 0) + new["n"]})
    assert seen.records() == [{"id": 1, "n": 5}, {"id": 2, "n": 5}]
    assert t.insert([{"id": 3, "n": 1}], update_record=lambda k, old, new: {}).records()[-1] == {"id": 3}
    assert t.insert([{"id": 1, "n": 4}, {"id": 1, "n": 5}], update_field={"n": "max"}).records() == [{"id": 1, "n": 5, "x": None}]
    with pytest.raises(IllegalArgument):
        t.insert([{"id": 1}], update_field={}, update_record=max)


def test_bad_records(store):
    t = made(store, lexicoder="integer")
    for bad in ([{"a": 1}], [{"id": "x"}], [{"id": 1, "__v_x": 2}], [{"id": None, "a": 1}]):
        with pytest.raises(IllegalArgument):
            t.insert(bad)
    with pytest.raises(IllegalArgument):
        made(store, lexicoder="string").insert([{"id": ""}])
    for bad in ({"primary_key": []}, {"primary_key": ["a", "a"]}, {"fan_out": 3}, {"lexicoder": ("tuple", "integer", "integer")}, {"families": {"a": ["x"], "b": ["x"]}}, {"count": 5}):
        with pytest.raises(IllegalArgument):
            made(store, **bad)


def test_attributes(store):
    t = made(store, title="T").flush()
    assert t.assoc(title="T") is t and t["title"] == "T" and t.get("no") is None
    u = t.assoc(more=1)
    assert u.dirty and u.node_id is None and u != t and u.dissoc("more") == t and not t.dirty
    assert Table.load(store, "t", u.flush().node_id)["more"] == 1
    for bad in ({"count": 1}, {"data": 1}, {"name": "x"}):
        with pytest.raises(IllegalArgument):
            t.assoc(**bad)
    with pytest.raises(BadTarget):
        Table.load(store, "t", store.put({"type": "database"}))


def test_bulk_load_and_partitions(store, spark):
    df = spark.range(17).select((F.lit(16) - F.col("id")).alias("id"), (F.col("id") * 2).alias("a"))
    t = made(store).load_records(df)
    assert [p["count"] for p in t.list_partitions()] == [5, 5, 4, 3] and t.count == 17 and t.schema.names == ["id", "a"]
    assert [r.id for r in t.read_partition(t.list_partitions()[1]["id"]).collect()] == [5, 6, 7, 8, 9]
    again = made(store).load_records(df.repartition(3))
    assert [p["id"] for p in again.list_partitions()] == [p["id"] for p in t.list_partitions()]
    half = t.rebuild([p["id"] for p in t.list_partitions()[:2]])
    assert half.count == 10 and [r.id for r in half.keys().collect()] == list(range(10))
    more = t.append(spark.range(20, 29))
    assert more.count == 26 and [r.id for r in more.keys(min_key=15, max_key=22).collect()] == [15, 16, 20, 21, 22]
    with pytest.raises(RangeOverlap):
        t.append(spark.range(16, 18))
    with pytest.raises(DuplicateKeys):
        made(store).load_records(spark.range(9).union(spark.range(3)))
    with pytest.raises(IllegalArgument):
        made(store).load_records(spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).alias("id")))
    assert made(store).load_records(spark.range(0)).count == 0
    with pytest.raises(BrokenLink):
        t.rebuild(["no"])


def test_pruning_reads_few_files(store, spark):
    t = made(store, partition_limit=10).load_records(spark.range(1000).withColumn("a", F.lit(1)))
    files = lambda df: len(df.inputFiles())
    assert files(t.scan(ordered=False)) >= 100
    assert files(t.scan(min_key=105, max_key=114)) <= 4
    assert files(t.scan(offset=900, limit=5)) <= 2 and [r.id for r in t.scan(offset=900, limit=5).collect()] == [900, 901, 902, 903, 904]
    assert [r.id for r in t.scan(offset=7, limit=3, reverse=True).collect()] == [992, 991, 990]
    assert [r.id for r in t.scan(min_key=95, max_key=700, offset=20, limit=2).collect()] == [115, 116]
    assert files(t.read([3, 500])) <= 4
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,105)" in t.scan(min_key=105, max_key=114)._jdf.queryExecution().toString()


def test_ordered_scans_do_not_shuffle(store, spark, monkeypatch):
    import vellum.plans.table as module

    t = made(store, partition_limit=10).load_records(spark.range(195).select((F.col("id") * 7 % 195).alias("id"), F.lit(1).alias("a")))
    n = len(t.list_partitions())
    for options, want in (({}, range(195)), ({"reverse": True}, range(194, -1, -1)), ({"min_key": 33, "max_key": 150, "fields": ["a"]}, range(33, 151))):
        df = t.scan(**options)
        assert "Exchange" not in df._jdf.queryExecution().toString() and [r.id for r in df.collect()] == list(want)
    assert t.scan().select(F.spark_partition_id().alias("p")).distinct().count() == n
    monkeypatch.setattr(module, "ORDERED_PARTS", 3)
    assert [r.id for r in t.scan().collect()] == list(range(195))


def test_scattered_upserts_rewrite_what_they_touch(store, spark, monkeypatch):
    import vellum.plans.table as module

    monkeypatch.setattr(module, "LOOKUP_KEYS", 1)
    t = made(store, partition_limit=4, fan_out=16).load_records(spark.range(1600).withColumn("a", F.lit(1)))
    before = {p["id"] for p in t.list_partitions()}
    u = t.insert(spark.range(0, 1600, 6).withColumn("a", F.lit(2)).filter("id % 4 = 0")).compact()
    assert len(before) == 400 and len(before - {p["id"] for p in u.list_partitions()}) == 134
    assert u.scan(ordered=False).agg(F.sum("a"), F.count("*")).first()[:] == (1600 + 134, 1600)


def test_merge_touches_few_partitions(store, spark):
    t = made(store, partition_limit=10).load_records(spark.range(300).withColumn("a", F.lit(1)))
    before = {p["id"] for p in t.list_partitions()}
    u = t.insert([{"id": 55, "a": 2}, {"id": 250, "a": 2}]).flush(apply_patch=True)
    assert len(before - {p["id"] for p in u.list_partitions()}) == 2
    same = t.insert([{"id": 55, "a": 1}]).flush(apply_patch=True)
    assert same.node_id == t.node_id
    gone = t.delete(list(range(0, 300))).compact()
    assert gone.count == 0 and gone.list_partitions() == [] and gone.scan().count() == 0
    few = t.delete(list(range(3, 297))).compact()
    assert [r.id for r in few.scan().collect()] == [0, 1, 2, 297, 298, 299] and all(r.state in ("pass", "warn") for r in validate(few))


def test_large_merges_choose_partitions_by_key_order(store, spark, monkeypatch):
    import vellum.plans.table as module

    monkeypatch.setattr(module, "LOOKUP_KEYS", 1)
    t = made(store, partition_limit=10).load_records(spark.range(200).withColumn("a", F.lit(1)))
    u = t.insert([{"id": i, "a": 5} for i in (3, 50, 51, 120, 199, 500)]).delete([60, 61]).compact()
    assert {r.id for r in u.scan().filter("a = 5").collect()} == {3, 50, 51, 120, 199, 500} and u.count == 199 == u.scan().count()


@pytest.mark.parametrize(("config", "key"), [(("reverse", "string"), lambda i: "ab"[i % 2] * (1 + i // 2)), ("string", lambda i: f"é{i:03d}"), ("float", lambda i: (i - 10) / 7), ("bytes", lambda i: bytes([i, 0, 255 - i]))])
def test_key_types(store, spark, config, key):
    values = [key(i) for i in range(24)]
    t = made(store, lexicoder=config).insert([{"id": v, "a": i} for i, v in enumerate(values)]).flush(apply_patch=True)
    want = sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v, reverse=config[0] == "reverse")
    assert [r["id"] for r in t.records()] == want
    lo, hi = want[5], want[15]
    assert [r["id"] for r in t.records(t.scan(min_key=lo, max_key=hi))] == want[5:16]
    assert sorted(r["id"] for r in t.records(t.read([want[3], want[20]]))) == sorted([want[3], want[20]])
    parts = module_parts(t)
    placed = {p: {_plain(r["id"]) for r in t.scan(ordered=False).filter(t._place(parts) == p).collect()} for p in range(len(parts))}
    assert placed == {i: {_plain(r["id"]) for r in t.read_partition(p["id"]).collect()} for i, p in enumerate(parts)}
    assert all(r.state in ("pass", "warn") for r in validate(t))


def module_parts(t):
    return list(index.entries(t.store, t.root["data"]))


def unsorted(store, spark, part):
    path = store.new_data("parts") + "/" + "/".join(part["path"].split("/")[-2:])
    spark.read.parquet(part["path"]).coalesce(1).sortWithinPartitions(F.desc("id")).write.parquet(path)
    return path


def test_stats_checks_and_graph(store, spark):
    t = made(store).load_records(spark.range(60).withColumn("b", F.when(F.col("id") % 2 == 0, 1))).insert([{"id": 5, "b": 9}]).flush()
    stats, out = collect_table_stats(t), []
    print_table_stats(stats, out.append)
    assert stats["partition"]["records"]["sum"] == 60 and stats["patch"] == {"changes": 1} and "table.records = 60" in out and any(x.startswith("partition.records[max] = ") for x in out)
    frame = {(r.part, r.measure): r.value for r in stats_frame(spark, t).collect()}
    assert frame["partition", "records[sum]"] == 60 and frame["patch", "changes"] == 1
    assert all(r.state in ("pass", "warn") for r in validate(t))
    assert [tuple(r)[:3] for r in field_stats(t).collect()] == [("b", "bc", 31)]
    assert view_table(t).count("shape=box") == stats["partition"]["count"]
    # partitions written out of order, and with a wrong edge
    parts = [dict(p) for p in module_parts(t)]
    swapped = dict(parts[0], path=unsorted(store, spark, parts[0]))
    moved = dict(parts[1], last=parts[1]["first"])
    found = {r.message for r in validate(Table(store, "t", t.root | {"patch": None, "data": index.build_tree(store, 16, [swapped, moved])})) if r.state == "fail"}
    assert found >= {"rows of a file are in key order", "first and last key are those of the rows"}
    broken = Table(store, "t", t.root | {"count": 3, "partition_limit": 2})
    assert {r.state for r in validate(broken)} >= {"fail"}
    assert validate(Table(store, "t", t.root | {"data": "gone"}))[0].state == "error"


def test_changes_between_versions(store, spark):
    old = made(store, partition_limit=10).load_records(spark.range(100).withColumn("a", F.lit(1)))
    new = old.insert([{"id": 5, "a": 2}, {"id": 200, "a": 1}, {"id": 6, "a": 1}]).delete([77])
    for version in (new, new.flush(), new.compact()):
        assert sorted((r.id, r.change) for r in changes_between(old, version).collect()) == [(5, "updated"), (77, "deleted"), (200, "added")]
    assert changes_between(old, old).count() == 0


class Model:
    """What the table should hold: a dict by key."""

    def __init__(self):
        self.rows = {}

    def scan(self, fields=None, min_key=None, max_key=None, offset=0, limit=None):
        out = []
        for k in sorted(self.rows):
            if (min_key is None or k >= min_key) and (max_key is None or k <= max_key):
                row = self.rows[k]
                if fields:
                    row = {f: v for f, v in row.items() if f in fields}
                    if not row:
                        continue
                out.append({"id": k} | row)
        return out[offset : None if limit is None else offset + limit]


@pytest.mark.parametrize("seed", range(4))
def test_random_operations(store, seed):
    rnd, model, t, n = random.Random(seed), Model(), made(store), 60
    for _ in range(14):
        match rnd.choice(["insert", "insert", "delete", "flush", "scan", "scan", "read", "assoc"]):
            case "insert":
                batch = []
                for _ in range(rnd.randint(1, 12)):
                    row = {"a": rnd.randint(0, 9), "b": rnd.random() < 0.5, "c": rnd.choice("xyz"), "d": rnd.random()}
                    batch.append({"id": rnd.randint(1, n)} | {f: None if rnd.random() < 0.15 else v for f, v in row.items() if rnd.random() < 0.6})
                for r in batch:
                    k = r["id"]
                    model.rows[k] = model.rows.get(k, {}) | {f: v for f, v in r.items() if f != "id"}
                t = t.insert(batch)
            case "delete":
                ids = rnd.sample(range(1, n + 1), rnd.randint(1, 15))
                t = t.delete(ids)
                for k in ids:
                    model.rows.pop(k, None)
            case "flush":
                t = t.flush(apply_patch=rnd.random() < 0.5)
                if not t.root["schemas"]:
                    continue
                assert all(r.state in ("pass", "warn") for r in validate(t))
            case "assoc":
                t = t.assoc(x=rnd.random())
            case "read":
                ids = [rnd.randint(-3, n + 5) for _ in range(6)]
                if t.root["schemas"]:
                    assert t.records(t.read(ids, with_nil=True)) == [r for r in model.scan() if r["id"] in ids]
            case "scan":
                o = {"fields": rnd.choice([None, None, ["a"], ["b", "e"], ["c", "d"], ["e"]]), "min_key": rnd.choice([None, rnd.randint(-10, n)]), "max_key": rnd.choice([None, rnd.randint(0, n + 10)]), "offset": rnd.choice([0, rnd.randint(0, 20)]), "limit": rnd.choice([None, rnd.randint(1, 30)])}
                if t.root["schemas"]:
                    assert t.records(t.scan(**o, with_nil=True)) == model.scan(**o), o
        assert t.count == len(model.rows)
    if t.root["schemas"]:
        assert t.records() == model.scan() == t.compact().records()


def test_bloom_filters_of_keys(store, spark):
    import pyarrow.parquet as pq

    sizes = []
    for bloom in (False, True):
        t = made(store, partition_limit=1000, bloom=bloom).load_records(spark.range(900))
        files = [f.removeprefix("file://") for f in t.scan(ordered=False).inputFiles()]
        assert all(pq.read_metadata(f).num_rows for f in files)
        sizes.append(t.list_partitions()[0]["size"])
        assert [r.id for r in t.read([5, 2000]).collect()] == [5]
    assert sizes[1] > sizes[0]


def test_partition_like_and_job_groups(store, spark):
    from vellum.plans.jobs import job_group

    t = made(store, partition_limit=10).load_records(spark.range(100))
    with job_group(spark, "outer"):
        with job_group(spark, "inner", "text"):
            assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "inner"
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "outer"
        df = t.partition_like(spark.range(50, 150))
        placed = df.select(F.spark_partition_id().alias("p"), "id").collect()
        assert [(r.p, r.id) for r in placed] == [(min(r.id // 10, 9), r.id) for r in placed] and len(placed) == 100
        assert df.select(F.spark_partition_id().alias("p"), "id").groupBy("p").agg(F.max("id") - F.min("id")).count() == 5


def test_whole_folders_are_one_path(store, spark):
    from vellum.operators.partitions import folders

    t = made(store, partition_limit=10).load_records(spark.range(400).withColumn("a", F.lit(1)))
    parts = t._parts()
    assert len(parts) == 40 and len(folders(parts)[0]) == 1 and len(folders(parts[1:])[0]) == 39
    u = t.insert([{"id": 77, "a": 2}]).append(spark.range(1000, 1020).withColumn("a", F.lit(3)))
    assert u.scan().agg(F.count("*"), F.sum("a")).first()[:] == (420, 400 + 1 + 60) and u.scan().columns == ["id", "a"]
    assert t.scan(fields=["a"]).count() == 400 and [r.id for r in t.scan(offset=395).collect()] == list(range(395, 400))


def test_checks_of_rows_need_no_shuffle(store, spark):
    """Only stretches of files come back; broken folders are found as by brute force."""
    t = Table.new(store, "t", primary_key=["a", "b"], lexicoder=("tuple", "string", ("reverse", "integer")), partition_limit=40)
    t = t.load_records(spark.range(200).select((F.col("id") % 3).cast("string").alias("a"), F.col("id").alias("b")))
    parts = [dict(p) for p in module_parts(t)]
    plan = _stretches(t, parts, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "regexp" not in plan
    order = [F.asc("a"), F.desc("b")]
    for number, change in enumerate([lambda df: df.orderBy(F.desc("a"), "b"), lambda df: df.union(df.limit(5)).coalesce(1).sortWithinPartitions(*order), lambda df: df.union(df).repartition(3, "b").sortWithinPartitions(*order), lambda df: df.repartitionByRange(3, *order).sortWithinPartitions(*order)]):
        path = store.new_data("parts") + "/" + "/".join(parts[number]["path"].split("/")[-2:])
        change(spark.read.schema(t.schema).parquet(parts[number]["path"])).write.parquet(path)
        parts[number]["path"] = path
    want = {}
    for p in parts:
        rows = spark.read.parquet(p["path"]).select("a", "b", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).orderBy("file", "row").collect()
        rank = [(r.a, -r.b) for r in rows]
        down = sum(x.file == y.file and j < i for x, y, i, j in zip(rows, rows[1:], rank, rank[1:]))
        lo, hi = min(rank), max(rank)
        want["/".join(p["path"].split("/")[-3:])] = (len(rows), len(set(rank)), down, (lo[0], -lo[1]), (hi[0], -hi[1]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = _rows_of_folders(t, parts, 0)
            assert {k: (r["n"], r["d"], r["down"], *((r[e]["a"], r[e]["b"]) for e in ("lo", "hi"))) for k, r in found.items()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(n != d for n, d, *_ in want.values()) == 2 and sum(down > 0 for _, _, down, *_ in want.values()) == 1


def test_rows_of_a_merge_are_joined_once(store, spark, monkeypatch):
    """Counting, sampling and sorting read what was joined and written once."""
    t = made(store, partition_limit=20).load_records(spark.range(200).withColumn("a", F.lit(1))).insert(spark.range(0, 200, 3).withColumn("a", F.lit(2)))
    seen = []
    write = module.partitions.write_partitions

    def watched(store, df, *rest):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(store, df, *rest)

    monkeypatch.setattr(module.partitions, "write_partitions", watched)
    assert t.compact().scan().filter("a = 2").count() == 67
    assert len(seen) == 1 and "Join" not in seen[0]


def test_texts_of_compared_rows_are_not_shuffled(store, spark):
    old = made(store, partition_limit=10).load_records(spark.range(100).withColumn("a", F.lit(1)))
    found = changes_between(old, old.insert([{"id": 5, "a": 2}, {"id": 6, "a": 1}]).delete([7]).compact())
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Join FullOuter")
    assert "json" in above.lower(), above
    assert "json" not in below.lower(), below
    assert sorted((r.id, r.change) for r in found.collect()) == [(5, "updated"), (7, "deleted")]
