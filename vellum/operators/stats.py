"""Structure of a table: statistics, graph walk, DOT text and checks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions.records import family_lookup
from . import index, partitions


def walk(store, root: str | None, path: tuple = ()) -> Iterator[tuple[tuple, str, dict]]:
    """(path, id, node) of each index node and partition entry, breadth first."""
    queue = [(path, root, store.get(root))] if root else []
    while queue:
        path, node_id, node = queue.pop(0)
        yield path, node_id, node
        for i, child in enumerate(node.get("children", ())):
            queue.append(((*path, i), child["id"], child if child["type"] == "partition" else store.get(child["id"])))


def find_nodes(store, roots: list[str], follow: Callable[[dict], bool] = lambda _: True) -> dict[str, dict]:
    """Objects reachable from databases, tables or index nodes; each is visited once."""
    seen: dict[str, dict] = {}
    queue = list(roots)
    while queue:
        node_id = queue.pop(0)
        if node_id in seen:
            continue
        node = seen[node_id] = store.get(node_id)
        if not follow(node):
            continue
        match node["type"]:
            case "database":
                queue += node["tables"].values()
            case "table":
                queue += [node["data"]] if node["data"] else []
            case "index":
                for c in node["children"]:
                    if c["type"] == "link":
                        queue.append(c["id"])
                    else:
                        seen[c["id"]] = c
    return seen


def _summary(values: list[int]) -> dict:
    return {"min": min(values), "max": max(values), "sum": sum(values), "mean": sum(values) / len(values)}


def collect_table_stats(table) -> dict:
    """Counts and sizes of patch, index nodes and partitions, from manifests alone."""
    store, root = table.store, table.root
    nodes = [n for _, _, n in walk(store, root["data"])]
    out: dict = {"records": table.count}
    if root["patch"]:
        out["patch"] = {"changes": root["patch"]["count"]}
    inner = [n for n in nodes if n["type"] == "index"]
    if inner:
        heights = defaultdict(int)
        for n in inner:
            heights[n["height"]] += 1
        out["index"] = {"count": len(inner), "heights": dict(heights), "size": _summary([store.size(n) for n in inner]), "children": _summary([len(n["children"]) for n in inner])}
    parts = [n for n in nodes if n["type"] == "partition"]
    if parts:
        out["partition"] = {"count": len(parts), "size": _summary([n["size"] for n in parts]), "records": _summary([n["count"] for n in parts])}
    return out


def field_stats(table) -> DataFrame:
    """Per field: its family, records that have it, and the share of all (an aggregate)."""
    of = family_lookup(table.root["families"])
    rows = table.scan(ordered=False)
    row = rows.agg(F.count("*").alias("__v_n"), *(F.count(f"`{c}`").alias(c) for c in table.fields))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(of(c)).alias("family"), F.col(f"`{c}`").alias("records")) for c in table.fields)))
    return row.select("__v_n", pairs.alias("f")).select("f.field", "f.family", "f.records", (F.col("f.records") / F.nullif(F.col("__v_n"), F.lit(0))).alias("share"))


def measures(stats: dict, of: str = "table") -> list[tuple[str, str, float]]:
    """What ``collect_table_stats`` found as rows (part, measure, value)."""
    rows: list[tuple[str, str, float]] = []
    for name, value in stats.items():
        if isinstance(value, dict) and of == "table":
            rows += measures(value, name)
        elif isinstance(value, dict):
            rows += [(of, f"{name}[{k}]", float(v)) for k, v in sorted(value.items())]
        else:
            rows.append((of, name, float(value)))
    return rows


def stats_frame(spark: SparkSession, table) -> DataFrame:
    """``measures`` of a table as a DataFrame, to be queried or joined like any other."""
    return spark.createDataFrame(measures(collect_table_stats(table)), "part string, measure string, value double")


def print_table_stats(stats: dict, out: Callable[[str], None] = print) -> None:
    """One line for each measure."""
    for part, measure, value in measures(stats):
        out(f"{part}.{measure} = {value:,.10g}")


# -- checks -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Result:
    """One check: ``state`` is pass, warn, fail or error."""

    path: str
    type: str
    state: str
    message: str
    expected: str = ""
    actual: str = ""


def validate(table, deep: bool = True) -> list[Result]:
    """Checks the tree's shape and the order between partitions from the nodes and,
    ``deep``, the rows of each partition: their number, distinct keys, first and last key,
    and their order within each file (keys alone are read, each file where it lies)."""
    store, root, out = table.store, table.root, []

    def check(path, kind, ok, message, expected="", actual="", state="fail"):
        out.append(Result("/".join(map(str, path)) or "root", kind, "pass" if ok else state, message, str(expected), str(actual)))

    try:
        found = list(walk(store, root["data"]))
    except Exception as e:  # noqa: BLE001  a broken link is a finding
        return [Result("root", "index", "error", str(e))]
    parts = [(p, n) for p, _, n in found if n["type"] == "partition"]
    limit, fan_out = root["partition_limit"], root["fan_out"]
    token = lambda h: K.sort_token(table.codec, table.codec.decode(bytes.fromhex(h)))
    for path, _, n in found:
        check(path, n["type"], n["type"] in ("index", "partition"), "known type", "index or partition", n["type"])
        if n["type"] == "index":
            kids = n["children"]
            check(path, "index", len(n["keys"]) == len(kids) - 1, "split keys are children less one", len(kids) - 1, len(n["keys"]))
            check(path, "index", len(kids) <= fan_out, "no more children than the fan-out", fan_out, len(kids))
            check(path, "index", not path or len(kids) >= index.min_branches(fan_out), "half the fan-out at least", index.min_branches(fan_out), len(kids), "warn")
            check(path, "index", all(c.get("height", 0) == n["height"] - 1 for c in kids), "children one layer below", n["height"] - 1)
            check(path, "index", n["count"] == sum(c["count"] for c in kids), "count is the children's sum", sum(c["count"] for c in kids), n["count"])
            check(path, "index", all(token(a["last"]) < token(b["first"]) for a, b in zip(kids, kids[1:])), "children in key order, apart")
        else:
            check(path, "partition", n["count"] <= limit, "within the limit", limit, n["count"])
            check(path, "partition", len(parts) == 1 or n["count"] >= partitions.min_limit(limit), "half the limit at least", partitions.min_limit(limit), n["count"], "warn")
            check(path, "partition", token(n["first"]) <= token(n["last"]), "first key not after the last")
    if deep and parts:
        pk = table.primary_key
        for schema_id in sorted({n["schema"] for _, n in parts}):
            some = [(p, n) for p, n in parts if n["schema"] == schema_id]
            seen = _rows_of_folders(table, [n for _, n in some], schema_id)
            for path, n in some:
                r = seen.get("/".join(n["path"].split("/")[-3:]))
                edges = r and tuple(partitions.encode_key(table.codec, r[e], pk).hex() for e in ("lo", "hi"))
                check(path, "partition", edges == (n["first"], n["last"]), "first and last key are those of the rows", (n["first"], n["last"]), edges)
                check(path, "partition", r is not None and not r["down"], "rows of a file are in key order", 0, r and r["down"])
                check(path, "partition", r is not None and r["n"] == n["count"], "rows are as many as counted", n["count"], r and r["n"])
                check(path, "partition", r is not None and r["n"] == r["d"], "keys are distinct", r and r["n"], r and r["d"])
    total = sum(n["count"] for _, n in parts)
    if not root["patch"] and table.pending is None:
        check((), "table", total == table.count, "count is the partitions' sum", total, table.count)
    elif deep:
        actual = table.scan(ordered=False).count()
        check((), "table", actual == table.count, "count is that of visible records", actual, table.count)
    return out


def _rows_of_folders(table, parts: list[dict], schema_id: int) -> dict[str, dict]:
    """By folder of a partition: rows ``n``, distinct keys ``d``, rows ``down`` that come
    after a higher key in their file, and the keys ``lo`` and ``hi``. Where files are in
    key order and apart, all this follows from their stretches; other partitions are
    aggregated."""
    pk, codec = table.primary_key, table.codec
    files: dict[str, dict[str, list]] = {}
    for r in _stretches(table, parts, schema_id).collect():  # a row for each split of a file
        folder = "/".join(r["file"].split("/")[-4:-1])
        files.setdefault(folder, {}).setdefault(r["file"], []).append(r)
    seen, rest = {}, []
    for folder, some in files.items():
        n = down = same = 0
        spans = []
        for stretches in some.values():
            stretches.sort(key=lambda r: r["row"])
            edges = [[{k: r[f"{e}{i}"] for i, k in enumerate(pk)} for e in ("first", "last")] for r in stretches]
            coded = [[K.sort_token(codec, partitions.key_values(codec, k, pk)) for k in e] for e in edges]
            n += sum(r["n"] for r in stretches)
            down += sum(r["down"] for r in stretches) + sum(b[0] < a[1] for a, b in zip(coded, coded[1:]))
            same += sum(r["same"] for r in stretches) + sum(b[0] == a[1] for a, b in zip(edges, edges[1:]))
            spans.append((coded[0][0], coded[-1][1], edges[0][0], edges[-1][1]))
        spans.sort(key=lambda s: s[:2])
        seen[folder] = {"n": n, "d": n - same, "down": down, "lo": spans[0][2], "hi": spans[-1][3]}
        if down or any(b[0] <= a[1] for a, b in zip(spans, spans[1:])):
            rest.append(folder)
    if rest:
        again = [p for p in parts if "/".join(p["path"].split("/")[-3:]) in rest]
        key = F.struct(*(f"`{k}`" for k in pk))
        found = _with_file(table, again, schema_id).withColumn("folder", F.substring_index(F.substring_index("file", "/", -4), "/", 3))
        found = found.groupBy("folder").agg(F.count_distinct(*(f"`{k}`" for k in pk)).alias("d"), F.min_by(key, "rank").alias("lo"), F.max_by(key, "rank").alias("hi"))
        for r in found.collect():
            seen[r["folder"]] |= {"d": r["d"], "lo": r["lo"], "hi": r["hi"]}
    return seen


def _with_file(table, parts: list[dict], schema_id: int) -> DataFrame:
    had = T.StructType.fromJson(table.root["schemas"][schema_id])
    df = table.store.spark.read.schema(had).parquet(*(p["path"] for p in parts))

    def rank(k: str, c: K.Codec) -> Column:
        value, kind, base = F.col(f"`{k}`"), had[k].dataType, c
        while isinstance(base, K.ReverseCodec):
            base = base.inner
        if isinstance(kind, T.ArrayType):  # by their bytes, which Arrow can compare
            value, kind = base.column(value), T.BinaryType()
        return partitions.rankable(value, kind, c)

    ranks = F.struct(*(rank(k, c).alias(f"rank{i}") for i, (k, c) in enumerate(zip(table.primary_key, K.parts_of(table.codec)))))
    return df.select(*(f"`{k}`" for k in table.primary_key), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), ranks.alias("rank"))


def _stretches(table, parts: list[dict], schema_id: int) -> DataFrame:
    """Neighbouring rows of a file that one task reads: their first row's number, how many
    they are, how many come after a higher and after an equal key, first and last key."""
    rows = _with_file(table, parts, schema_id)
    pk = table.primary_key
    kinds = [rows.schema[k].dataType for k in pk]
    own = [c.descending or isinstance(t, T.ArrayType) for c, t in zip(K.parts_of(table.codec), kinds)]
    ranks = [f"rank{i}" if o else f"key{i}" for i, o in enumerate(own)]
    sent = rows.select("file", "row", *(F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(pk)), *(F.col(f"rank.rank{i}").alias(f"rank{i}") for i, o in enumerate(own) if o))
    out = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("row", "n", "down", "same")), *(T.StructField(f"{e}{i}", t) for e in ("first", "last") for i, t in enumerate(kinds))])

    def run(batches):
        held = None  # the stretch that may go on, and its last rank

        def shown(s):
            return pa.RecordBatch.from_pydict({k: pa.array([s[k]], s["types"][k]) if k in s["types"] else [s[k]] for k in out.names})

        for batch in batches:
            if not batch.num_rows:
                continue
            file, row = batch["file"], batch["row"]
            down, same = _steps([batch[c] for c in ranks])
            breaks = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(row[1:], pc.add(row[:-1], 1)))
            starts = [0, *(i + 1 for i in pc.indices_nonzero(breaks).to_pylist())]
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                at = lambda i: tuple(batch[c][i].as_py() for c in ranks)  # noqa: B023, E731
                new = {"file": file[a].as_py(), "row": row[a].as_py(), "n": b - a, "down": pc.sum(down[a : b - 1]).as_py() or 0, "same": pc.sum(same[a : b - 1]).as_py() or 0, "rank": at(b - 1)}
                new |= {f"{e}{i}": batch[f"key{i}"][j].as_py() for i in range(len(pk)) for e, j in (("first", a), ("last", b - 1))}
                new["types"] = {f"{e}{i}": batch.schema.field(f"key{i}").type for i in range(len(pk)) for e in ("first", "last")}
                if held and held["file"] == new["file"] and held["row"] + held["n"] == new["row"]:
                    begin = at(a)
                    new |= {"row": held["row"], "n": held["n"] + new["n"], "down": held["down"] + new["down"] + (begin < held["rank"]), "same": held["same"] + new["same"] + (begin == held["rank"])}
                    new |= {f"first{i}": held[f"first{i}"] for i in range(len(pk))}
                elif held:
                    yield shown(held)
                held = new
        if held:
            yield shown(held)

    return sent.mapInArrow(run, out)


def _steps(ranks: list) -> tuple:
    """Whether each row but the first ranks under the one before, and whether they are equal."""
    down = pa.array([False] * (len(ranks[0]) - 1), pa.bool_())
    same = pa.array([True] * (len(ranks[0]) - 1), pa.bool_())
    for r in ranks:
        down = pc.or_(down, pc.and_(same, pc.fill_null(pc.less(r[1:], r[:-1]), False)))
        same = pc.and_(same, pc.fill_null(pc.equal(r[1:], r[:-1]), False))
    return down, same


def results_frame(spark, results: list[Result]) -> DataFrame:
    return spark.createDataFrame([(r.path, r.type, r.state, r.message, r.expected, r.actual) for r in results], "path string, type string, state string, message string, expected string, actual string")


# -- DOT --------------------------------------------------------------------------------


def dot(store, roots: dict[str, str]) -> str:
    """Graphviz text of what is reachable from named roots."""
    nodes = find_nodes(store, list(roots.values()))
    shapes = {"database": "house", "table": "tab", "index": "ellipse", "partition": "box"}
    names = {v: k for k, v in roots.items()}
    lines = ["digraph vellum {"]
    for node_id, n in nodes.items():
        label = f"{names.get(node_id, n['type'])}\\n{node_id[:8]}" + (f"\\n{n['count']} records" if "count" in n else "")
        lines.append(f'  "{node_id[:12]}" [shape={shapes.get(n["type"], "diamond")}, label="{label}"];')
        links = {**n["tables"]} if n["type"] == "database" else {"data": n["data"]} if n["type"] == "table" and n["data"] else {str(i): c["id"] for i, c in enumerate(n.get("children", ()))}
        lines += [f'  "{node_id[:12]}" -> "{child[:12]}" [label="{name}"];' for name, child in links.items()]
    return "\n".join([*lines, "}"])


def view_table(table) -> str:
    return dot(table.store, {table.name: table.node_id})


def view_database(db) -> str:
    return dot(db.store, {db.name or "database": db.node_id})
