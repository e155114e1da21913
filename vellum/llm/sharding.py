"""Sharding by histogram sort, in DataFrame functions only; law ``bytes``.

Documents are ordered by a 63-bit key: 39 bits of the text's hash, so that equal texts
are neighbours, then 24 bits of the id's, so that a group of any size can be split. Each
round counts the exact bytes below finer candidate boundaries, within those cells alone in
which a splitter still lies, until every splitter meets its tolerance or a single row is
left. Boundaries between texts are preferred. Then the rows are exchanged once.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Key bits below the cells of each round; 24 is where texts part.
SHIFTS = (51, 43, 35, 24, 16, 8, 0)
KEY_BITS, TEXT_SHIFT = 63, 24
#: Of the bytes of a shard: what a splitter may be off, and what it may be off so as not
#: to split equal texts. Of the bytes of a bucket: what its splitter may be off.
TOLERANCE, WHOLE_TOLERANCE, BUCKET_TOLERANCE = 0.002, 0.01, 0.2
#: Bytes of a bucket (what a task sorts), and the most buckets in a shard.
BUCKET_BYTES, SHARD_BUCKETS = 64 << 20, 256


def sort_key(text: Column, doc_id: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS + TEXT_SHIFT), TEXT_SHIFT)
    return high.bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit((1 << TEXT_SHIFT) - 1)))


def splitters(sized: DataFrame, parts: int, shards: int) -> list[int]:
    """parts - 1 boundaries (keys from which a bucket begins), of (key, size) rows.

    A round brings at most 2,048 counts for each open splitter to the driver."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    per_shard, end = parts // shards, 1 << KEY_BITS
    found: dict[int, int] = {}
    # splitter -> (first key of its cell, bytes below that cell)
    opened = {j: (0, 0) for j in range(1, parts)}
    above = KEY_BITS
    for shift in SHIFTS:
        cells = {lo >> above for lo, _ in opened.values()} if above < KEY_BITS else set()
        rows = sized.filter(F.shiftrightunsigned("key", above).isin(*cells)) if cells else sized
        counts = defaultdict(list)
        for r in rows.groupBy(F.shiftrightunsigned("key", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("cell").collect():
            counts[r.cell << shift >> above].append((r.cell << shift, r["size"], r.n))
        still = {}
        for j, (lo, below) in opened.items():
            target = total * j / parts
            edge = lo
            for edge, size, n in counts[lo >> above]:
                if below + size >= target:
                    break
                below += size
            else:  # nothing at or above the target
                found[j] = min(end, (lo >> above) + 1 << above)
                continue
            off, past = target - below, below + size - target
            shard_edge = j % per_shard == 0
            allowed = total / shards * (WHOLE_TOLERANCE if shift == TEXT_SHIFT else TOLERANCE) if shard_edge else total / parts * BUCKET_TOLERANCE
            if n == 1 or shift == 0 or min(off, past) <= allowed:
                found[j] = edge if off <= past else edge + (1 << shift)
            else:
                still[j] = (edge, below)
        opened, above = still, shift
        if not opened:
            break
    keys = [found[j] for j in range(1, parts)]
    walls = [0, *(keys[j - 1] for j in range(per_shard, parts, per_shard)), end]
    out: list[int] = []
    for j, key in enumerate(keys, 1):
        low, high = walls[j // per_shard], walls[min(shards, j // per_shard + 1)]
        out.append(max(min(max(key, low), high), out[-1] if out else 0))
    return out


def bucket_of(key: Column, edges: list[int]) -> Column:
    """The number of edges at or below the key: a table by the key's first twelve bits,
    then the few edges inside that cell."""
    shift = SHIFTS[0]
    inside: dict[int, list[int]] = defaultdict(list)
    for e in edges:
        inside[e >> shift].append(e)
    base, seen = [], 0
    for cell in range(1 << KEY_BITS - shift):
        base.append(seen)
        seen += len(inside[cell])
    cell = F.shiftrightunsigned(key, shift).cast("int")
    first = F.get(F.split(F.lit(",".join(map(str, base))), ",").cast("array<int>"), cell)
    own = F.get(F.split(F.lit(",".join(" ".join(map(str, inside[c])) for c in range(len(base)))), ",", -1), cell)
    return first + F.when(own == "", 0).otherwise(F.size(F.filter(F.split(own, " "), lambda e: e.cast("long") <= key)))


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Puts rows into shards of near equal bytes (a row: bytes of its text in UTF-8, plus
    1). Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in the shard),
    grown_shard (null: the law is not ``key``), then the columns ``carry``, if any, each
    as ``carried_<name>``.

    A null text has size 1 and, like an empty one, crc32 of nothing (0). Ids may be null
    or repeat. Equal texts share a shard unless that would put a splitter off by over
    WHOLE_TOLERANCE of a shard; rows equal in id and text stay together. An empty table
    gives an empty one; columns of any names may clash, since only named ones are kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        sort_key(F.col(text_col), F.col(id_col)).alias("key"),
        *(F.col(c).alias(f"carried_{c}") for c in carry or []),
    )
    rows = stash(rows, "sized")
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = min(SHARD_BUCKETS, max(1, ceil(total / shards / BUCKET_BYTES)))
    parts = per_shard * shards
    edges = splitters(rows.select("key", "size"), parts, shards)
    placed = rows.withColumn("bucket", bucket_of(F.col("key"), edges))
    held = {r.bucket: r.n for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    before = [sum(held.get(b, 0) for b in range(b0 - b0 % per_shard, b0)) for b0 in range(parts)]
    offset = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy("key", "doc_id", "text_crc32", "size")
    return placed.repartitionById(parts, F.col("bucket")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("bucket") / per_shard).cast("int").alias("shard"),
        (offset + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(f"carried_{c}" for c in carry or []),
    )
