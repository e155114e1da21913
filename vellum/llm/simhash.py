"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits are split into six blocks. Three differing bits touch at most three blocks,
so a linked pair agrees on some three of the six: each distinct fingerprint goes into 20
buckets, one for each choice of three blocks (31 to 33 bits of key), and distances are
verified inside buckets. Copies fall together before that, as one distinct fingerprint.
A bucket yields links that span its linked groups, never all its pairs. One of over BUCKET
fingerprints is split the same way by its other bits: six blocks of those, three of which a
linked pair agrees on as well. What then shares a bucket differs in 18 bits at most.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, map_arrow, spread, stash

SEED, SHINGLE, DISTANCE = 42, 3, 3
BLOCKS, AGREE = 6, 3
#: Fingerprints up to which a bucket is verified as it is, without splitting it again.
BUCKET = 4096
#: Rows of one fingerprint from which its class is broadcast to them.
HOT = 1_000_000


def block_masks(within: int = (1 << 64) - 1) -> list[int]:
    """A mask for each choice of AGREE out of BLOCKS blocks of the bits of ``within``."""
    places = [b for b in range(64) if within >> b & 1]
    edges = [round(len(places) * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(blocks, AGREE)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits; zero if the text has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, those that are set in over half of the hashes; zero if there is none."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """All columns and the fingerprint as a signed long, called ``name``."""

    def make():
        def step(batch):
            at = batch.schema.get_field_index(text_col)
            marks = np.fromiter((fingerprint(v.as_py()) for v in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], [*batch.schema.names, name])

        return step

    return map_arrow(df, make, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def spanning(marks: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (first of its group, member) that connect what is within ``distance``."""
    out, rest = [], np.sort(marks)
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                found = rest[near]
                out += [(root, x) for x in found]
                front += list(found)
                rest = rest[~near]
    return out


def small_links(buckets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Spanning links of each row's array ``fps``."""

    def make():
        def step(batch):
            links: list[tuple[int, int]] = []
            column = batch.column(0)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            ends = ends - ends[0]
            sizes = np.diff(ends)
            two = ends[:-1][sizes == 2]
            a, b = flat[two], flat[two + 1]
            near = np.bitwise_count(a ^ b) <= distance
            for i in np.flatnonzero(sizes > 2):
                links += spanning(flat[ends[i] : ends[i + 1]], distance)
            more = np.array(links, np.uint64).reshape(-1, 2)
            left, right = np.concatenate([a[near], more[:, 0]]), np.concatenate([b[near], more[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])

        return step

    return map_arrow(buckets.select("fps"), make, "a long, b long")


def split_buckets(members: DataFrame) -> DataFrame:
    """Of the rows (t, fp) of over-full buckets: arrays ``fps`` of those that agree on three
    blocks of the bits that mask t left open as well."""
    masks = [[signed(m | n) for n in block_masks((1 << 64) - 1 & ~m)] for m in block_masks()]
    own = F.element_at(F.array(*(F.array(*map(F.lit, some)) for some in masks)), F.col("t") + 1)
    keys = members.select("t", "fp", F.posexplode(F.transform(own, lambda m: F.col("fp").bitwiseAND(m))).alias("n", "k"))
    return keys.groupBy("t", "n", "k").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of
    all pairs within DISTANCE; with a larger ``distance`` also of such pairs within it as
    share a bucket."""
    masks = [signed(m) for m in block_masks()]
    keys = stash(distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "k")), "block_keys")
    sizes = stash(keys.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"), "block_sizes")
    small = keys.join(sizes.filter(F.col("n") <= BUCKET), ["t", "k"]).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    found = small_links(small, distance)
    large = sizes.filter(F.col("n") > BUCKET)
    if not large.isEmpty():
        found = found.unionByName(small_links(split_buckets(keys.join(large, ["t", "k"], "left_semi")), distance))
    return found


def are_stars(links: DataFrame) -> bool:
    """Whether each u of the distinct ``links`` (u, v) has one v, which is no u itself."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    more = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
    return more.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node reachable.

    Alternates large-star and small-star steps; each is aggregates and joins on nodes,
    written to the shared folder, until the links are stars, which the steps leave alone."""
    canon = lambda d: d.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct()
    now = stash(canon(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))), "links")
    while not are_stars(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = canon(both.join(least, "u").filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")))
        large = stash(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        now = stash(canon(small), "small_star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_classes(marks: DataFrame) -> DataFrame:
    """Of (doc_id, fp) rows: (fp, root, component_id, copies), one row per distinct
    fingerprint; root is the least fingerprint of its component, copies its rows."""
    distinct = stash(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprints")
    nodes = components(links(distinct)).withColumnRenamed("node", "fp")
    linked = stash(nodes.join(distinct, "fp"), "linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(roots, "root").select("fp", "root", "component_id")
    return distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"), "copies")


def with_classes(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """``marks`` joined to ``classes`` on fp. Classes of HOT rows or more, of which there are
    few for the number of rows, are broadcast; so no fingerprint gathers in one task."""
    hot = classes.filter(F.col("copies") >= HOT)
    if hot.isEmpty():
        return marks.join(classes, "fp")
    rest = marks.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(classes, "fp")
    return marks.join(F.broadcast(hot), "fp").unionByName(rest)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, fingerprint (16 hex digits), component_id (the least id reachable
    over links of at most three differing bits, its own included), one row per input row.

    A null or empty text, or one of white space, has fingerprint zero, which links like
    any other. Rows that repeat an id each get a row. A null id gets a row too, and is
    never a component's id unless all ids of the component are null. An empty table gives
    an empty one; further columns are left out; texts of any length count whole."""
    rows = spread(id_text(df, id_col, text_col))
    marks = stash(with_fingerprints(rows, "text", "fp").select("doc_id", "fp"), "doc_fingerprints")
    classes = stash(fingerprint_classes(marks), "classes")
    return with_classes(marks, classes).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rooted(marked: DataFrame, marks: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """Of ``marked`` (with ``__fp``) one row for each root of ``classes`` (fp, root): that of
    the least id, null ids last, then of the least fingerprint in ``marks`` (doc_id, fp)."""
    places = marks.join(classes, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("k"))
    keepers = places.select(F.col("k.doc_id").alias("k_id"), F.col("k.fp").alias("k_fp"))
    keepers = stash(keepers.withColumn("k_at", F.xxhash64("k_id", "k_fp")), "keepers")
    # one exchange of the texts, by ``__at``, serves the join and the distinct rows
    placed = marked.withColumn("__at", F.xxhash64(id_col, "__fp"))
    same = (placed["__at"] == keepers["k_at"]) & (placed["__fp"] == keepers["k_fp"])
    return placed.join(keepers, same & placed[id_col].eqNullSafe(keepers["k_id"]), "left_semi").dropDuplicates(["__at", id_col, "__fp"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row for each component: that of its least id (null only
    if all its ids are), and of the least fingerprint under that id. Components that share
    an id, or have none, each keep their row. Rows with one id and one fingerprint are one
    document. Columns stay as they are. Fingerprints are computed twice, for a copy of all
    texts would cost more."""
    marked = with_fingerprints(spread(docs), text_col, "__fp")
    narrow = spread(id_text(docs, id_col, text_col))
    marks = stash(with_fingerprints(narrow, "text", "fp").select("doc_id", "fp"), "marks")
    return keep_rooted(marked, marks, fingerprint_classes(marks).select("fp", "root"), id_col).select(*docs.columns)
