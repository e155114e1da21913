"""Benchmark decontamination as a prefix-filtered set join.

A window (ten consecutive words of an item, or all words of a shorter one) is taken as
the set of its word shingles. It is contained in a document only if all its shingles
are, so one of them is a sufficient prefix: the rarest, by the counts of shingles over all
documents. Documents are joined to windows on that prefix shingle alone. Its place in the
window and the two lengths bound where the window can begin; there the words are compared
one by one.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, spread, stash, texts_of

WINDOW, SHINGLE = 10, 3
#: Pairs of a window and an item in one broadcast slice, on average (some 1,000 bytes each
#: with the counts of its shingles). More make more slices, each a pass over the documents.
SLICE_WINDOWS = 50_000

#: Bytes of words stay, A-Z in lower case; others part words.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def windows_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """All windows of an item; none if it has no word."""
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def shingles_of(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    size = min(SHINGLE, len(window))
    return [window[i : i + size] for i in range(len(window) - size + 1)]


def item_windows(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """Distinct (window, item): words joined by spaces, and the id as text."""

    def run(batches):
        for batch in batches:
            for i, text in enumerate(texts_of(batch, "t")):
                found = [b" ".join(w) for w in dict.fromkeys(windows_of(words_of(text)))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([batch.column(0)[i].as_py()] * len(found), pa.string())], ["window", "item"])

    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    return named.mapInArrow(run, "window binary, item string").distinct()


def shingle_counts(docs: DataFrame, known: frozenset[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """How often the shingles ``known`` occur over all documents; no more rows than these
    come to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    sizes = sorted({len(g) for g in known})

    def run(batches):
        known, seen = shared.value, Counter()
        for batch in batches:
            for text in texts_of(batch):
                words = words_of(text)
                for size in sizes:
                    seen.update(filter(known.__contains__, zip(*(words[i:] for i in range(size)))))
        yield pa.RecordBatch.from_arrays([pa.array(map(b" ".join, seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {tuple(bytes(r.shingle).split(b" ")): r.n for r in rows}


def prefix_index(windows: dict[tuple[bytes, ...], list[str]], counts: dict[tuple[bytes, ...], int]) -> dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...], list[str]]]]:
    """Prefix shingle -> (its offset, window, items). Shingles are ordered by their counts;
    the first in this order is the prefix."""
    index = defaultdict(list)
    for window, items in windows.items():
        shingles = shingles_of(window)
        offset = min(range(len(shingles)), key=lambda i: counts.get(shingles[i], 0))
        index[shingles[offset]].append((offset, window, items))
    return dict(index)


def occurrences(words: list[bytes], index: dict, sizes: list[int]):
    """(begin, end, items) of each occurrence of a window in the words."""
    for size in sizes:
        grams = zip(*(words[i:] for i in range(size)))
        for at, gram in enumerate(grams):
            if gram in index:
                for offset, window, items in index[gram]:
                    begin = at - offset
                    if begin >= 0 and begin + len(window) <= len(words) and tuple(words[begin : begin + len(window)]) == window:
                        yield begin, begin + len(window), items


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: bool = False) -> DataFrame:
    """Where benchmark items occur in whole documents, one row per input row.

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window), n_items,
    items (their ids as strings, sorted as strings), items_sha256, contaminated and spans
    (begin and end word of maximal hit runs); with ``keep`` instead all columns of
    ``docs`` and ``__hit`` (boolean). Windows of several items count for each. A null or
    empty text has no words; a null or empty item has no window; a null item id reads
    "null"; repeated items count once; ids of documents may be null or repeat; without
    items or documents all counts are zero or the result is empty. Further columns are
    left out; with ``keep``, names that begin with two underscores are reserved.

    The pairs of windows and items are dealt by hash to slices of SLICE_WINDOWS, so that
    what is broadcast has a fixed size; with more than one the documents are numbered and
    written once, and each slice writes only what it finds."""
    rows, name = (spread(docs), text_col) if keep else (spread(id_text(docs, id_col, text_col)), "text")
    texts = rows.select(F.col(name).alias("text"))
    pairs = stash(item_windows(items, item_col, item_text), "item_windows")
    slices = -(-pairs.count() // SLICE_WINDOWS)
    state = rows.withColumn("__spans", F.lit(b"")).withColumn("__items", F.array().cast("array<string>"))
    if slices == 1:
        state = _pass(state, _shared_index(texts, pairs), name)
    elif slices > 1:
        base = stash(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        narrow = base.select("__row", F.col(name).alias("text")).withColumn("__spans", F.lit(b"")).withColumn("__items", F.array().cast("array<string>"))
        found = None
        for i in range(slices):
            some = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == i)
            shared = _shared_index(narrow.select("text"), some)
            hits = stash(_pass(narrow, shared, "text").filter(F.length("__spans") > 0).drop("text"), "hits")
            shared.destroy()  # what it was for is written
            found = hits if found is None else found.unionByName(hits)
        found = found.groupBy("__row").agg(F.collect_list("__spans").alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
        joined = base.join(found.withColumn("__spans", F.aggregate("__spans", F.lit(b""), lambda a, x: F.concat(a, x))), "__row", "left")
        state = joined.select(*rows.columns, F.coalesce("__spans", F.lit(b"")).alias("__spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))
    return state.select(*docs.columns, (F.length("__spans") > 0).alias("__hit")) if keep else _finish(state)


def _shared_index(texts: DataFrame, pairs: DataFrame) -> Broadcast:
    """(prefix index, sizes of its shingles) of a slice of (window, item), broadcast."""
    windows: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for window, item in pairs.toLocalIterator():
        windows[tuple(bytes(window).split(b" "))].append(item)
    counts = shingle_counts(texts, frozenset(g for window in windows for g in shingles_of(window)))
    index = prefix_index(windows, counts)
    return texts.sparkSession.sparkContext.broadcast((index, sorted({len(g) for g in index})))


def _pass(state: DataFrame, shared: Broadcast, text_col: str) -> DataFrame:
    """Adds the occurrences of one slice of windows to __spans and __items."""

    def make():
        index, sizes = shared.value

        def step(batch):
            at = batch.schema.get_field_index
            spans, names = batch.column(at("__spans")).to_pylist(), batch.column(at("__items")).to_pylist()
            for i, text in enumerate(texts_of(batch, text_col)):
                found = list(occurrences(words_of(text), index, sizes))
                if found:
                    spans[i] += np.array([x[:2] for x in found], "<i8").tobytes()
                    names[i] = sorted({*names[i], *(x for f in found for x in f[2])})
            found = {"__spans": pa.array(spans, pa.binary()), "__items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([found.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

        return step

    return map_arrow(state, make, state.schema)


def merged(spans: bytes) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _finish(state: DataFrame) -> DataFrame:
    def make():
        def step(batch):
            at = batch.schema.get_field_index
            spans = [merged(x) for x in batch.column(at("__spans")).to_pylist()]
            items = batch.column(at("__items")).to_pylist()
            hit = [sum(b - a for a, b in x) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(at("doc_id")),
                    pa.array([len(words_of(t)) for t in texts_of(batch)], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(map(len, items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([n > 0 for n in hit], pa.bool_()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

        return step

    id_type = state.schema["doc_id"].dataType.simpleString()
    return map_arrow(state, make, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin:long,end:long>>")
