"""Near copies by SimHash, confirmed by the exact Jaccard similarity of five-word shingles.

Each set of shingles has a fingerprint, the bits set in over half of its hashes. Sets whose
fingerprints share a bucket of ``simhash`` and differ in at most NEAR bits are candidates;
those as similar as SIMILARITY are linked. Fingerprints bound no similarity: sets just as
similar differ in some ten bits and at times share no bucket. So an exact way follows for
pairs that were not compared by then, which loses none.

Shingles stand in one order for all texts, rare ones first. Two sets as similar as
SIMILARITY share a shingle of their prefixes (the first n - ceil(SIMILARITY n) + 1), so
pairs that meet in a prefix shingle are all there is to compare, and each that a bound by
parities does not rule out is compared by its whole sets. Any order gives the same result;
that frequent shingles come last, as a sample tells them, only keeps the groups that meet
small. Groups are compared with their
least member first, then with PIVOTS others, drawn anew while that links much; after that
only pairs between different components are. The latter two make only pairs that a bound by
parities allows.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import discard, id_text, map_arrow, spread, stash
from .simhash import SEED, components, keep_rooted

#: Words of a shingle, and the similarity from which texts are near copies: SIMILARITY of
#: ten shingles of the union.
SHINGLE, SIMILARITY = 5, 8
#: Differing bits up to which fingerprints of one bucket make a candidate: what unlike sets
#: in it stay over, mostly. It bears on speed only, as the exact way does the rest.
NEAR = 16
#: Documents whose shingles tell which are frequent, occurrences there from which a shingle
#: counts as frequent, and how many of those are known. They bear on speed only.
SAMPLE, FREQUENT, KNOWN = 20_000, 3, 250_000
#: Slots of 64 bits of the filter of texts that are compared, and rows that a task
#: remembers to leave out copies. They bear on speed only as well.
SLOTS, SEEN = 1 << 20, 1 << 20
#: Bits that parities are folded to where pairs are made, and members that a group is
#: compared with at a time before its pairs; draws of these at most, and the share of new
#: links under which no further one is made. They bear on speed only.
FOLDED, PIVOTS, ROUNDS, LITTLE = 512, 8, 4, 0.05

_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words as in ``simhash.fingerprint``.
    Fewer words than SHINGLE are one shingle; none, an empty set."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    marks = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out += marks[i : i + len(out)] * _FACTORS[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out ^ (out >> np.uint64(29)))


def set_mark(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; zero for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), seed=SEED)).astype(np.int64))) if len(found) else 0


def prefix(found: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles in the common order: those not ``known`` by hash, then the known
    by rank."""
    size = len(found) - -(-SIMILARITY * len(found) // 10) + 1 if len(found) else 0
    if not len(known):
        return found[:size]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    rank = np.where(known[at] == found, ranks[at], 0)
    return found[np.argsort(rank, kind="stable")[:size]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted distinct arrays is SIMILARITY or more."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 10 * shared >= SIMILARITY * (len(both) - shared)


def parities(found: np.ndarray) -> bytes:
    """A bit for each value of the low bits of hashes, two to four times as many as there
    are shingles and FOLDED at least: whether an odd number of them has it."""
    width = max(FOLDED, 1 << (2 * len(found)).bit_length())
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def plausible(a: np.ndarray, b: np.ndarray, sizes: int) -> bool:
    """False only if sets of these parities and of ``sizes`` together are not similar: the
    parities that differ are no more than the shingles that only one of them has."""
    a, b = (x.reshape(-1, min(len(a), len(b))) for x in (a, b))
    apart = int(np.bitwise_count(np.bitwise_xor.reduce(a, 0) ^ np.bitwise_xor.reduce(b, 0)).sum())
    return apart * (10 + SIMILARITY) <= (10 - SIMILARITY) * sizes


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and ranks (the rarest least) of shingles frequent in a sample."""

    def make():
        def step(batch):
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(value.as_py()).view(np.int64))], ["s"])

        return step

    share = min(1.0, SAMPLE / max(1, texts.count()))
    counts = map_arrow(texts.select("text").filter(F.rand(5) < share), make, "s long").groupBy("s").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(KNOWN).select("s").toArrow()
    hashes = found.column(0).to_numpy().view(np.uint64)
    ranks = np.arange(len(hashes), 0, -1, dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def with_marks(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """All columns and the mark of the shingle set, called ``name``."""

    def make():
        def step(batch):
            at = batch.schema.get_field_index(text_col)
            marks = np.fromiter((set_mark(shingles(v.as_py())) for v in batch.column(at)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], [*batch.schema.names, name])

        return step

    return map_arrow(df, make, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Of (doc_id, text): doc_id, fp (the set's mark), size of the set, its prefix, parities
    and fingerprint, which are null where the task has given that of the same set before."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent(rows))

    def make():
        (known, ranks), seen = shared.value, set()

        def step(batch):
            marks, sizes, heads, odd, prints = [], [], [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py())
                mark = set_mark(found)
                marks.append(mark)
                sizes.append(len(found))
                heads.append(None if mark in seen else prefix(found, known, ranks).view(np.int64))
                odd.append(None if mark in seen else parities(found))
                prints.append(None if mark in seen else simhash.signed(simhash.majority(found)))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
            new = [pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(odd, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], ["doc_id", "fp", "size", "prefix", "odd", "print"])

        return step

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("fp", "size")), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("odd", T.BinaryType()), T.StructField("print", T.LongType())])
    return map_arrow(rows.select("doc_id", "text"), make, schema)


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash takes for near copies: of equal fingerprints each
    with the least, and these least ones where their fingerprints are near."""
    prints = marks.filter("print is not null").groupBy("fp").agg(F.min("print").alias("print"))
    prints = stash(prints, "set_fingerprints")
    least = stash(prints.groupBy("print").agg(F.min("fp").alias("a")), "distinct_fingerprints")
    same = prints.join(least, "print").filter("fp <> a").select("a", F.col("fp").alias("b"))
    near = simhash.links(least.select(F.col("print").alias("fp")), NEAR).distinct().toDF("print", "other")
    near = near.join(least, "print").join(least.toDF("other", "b"), "other").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stash(same.unionByName(near), "fingerprint_pairs")


def meeting(marks: DataFrame) -> DataFrame:
    """(s, fp, size, least, least_size) for each set with s in its prefix, where two sets
    or more have it; least is the least of them. Runs of sorted rows are read as a stream."""
    entries = marks.filter("prefix is not null").select(F.explode("prefix").alias("s"), "fp", "size").repartition("s").sortWithinPartitions("s", "fp")

    def make():
        last = np.zeros((3, 0), np.int64)  # the last row, and the first of its run
        head = last

        def step(batch):
            nonlocal last, head
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            before = np.concatenate([last, rows], 1)
            if not last.shape[1]:
                before = np.concatenate([~rows[:, :1], rows], 1)
            new = (before[:2, 1:] != before[:2, :-1]).any(0)
            rows = rows[:, new]
            if not rows.shape[1]:
                return
            starts = np.concatenate([[before[0, 0] != rows[0, 0]], rows[0, 1:] != rows[0, :-1]])
            # the run's first row may be the one that is carried on, which stands at 0
            known = head if head.shape[1] else before[:, :1]
            both = np.concatenate([known, rows], 1)
            first = np.maximum.accumulate(np.where(starts, np.arange(1, len(starts) + 1), 0))
            # a first row goes out with its second; ``first`` of that one is the row just before it
            second = ~starts & np.concatenate([[bool(last.shape[1]) and (last[1, 0] == known[1, 0])], starts[:-1]])
            heads = both[:, first[second]]
            rest, under = rows[:, ~starts], both[:, first[~starts]]
            out = np.concatenate([np.concatenate([heads, heads[1:]]), np.concatenate([rest, under[1:]])], 1)
            last, head = rows[:, -1:], both[:, first[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["s", "fp", "size", "least", "least_size"])

        return step

    return map_arrow(entries, make, "s long, fp long, size long, least long, least_size long")


def sets_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, shingles as bytes) of the sets that ``pairs`` (a, b) name, and few others."""
    named = stash(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), "named_sets")
    slot = F.col("fp").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(fp, 58) as int))")
    found = named.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    discard(named)
    filled = np.zeros(SLOTS, np.int64)
    filled[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def make():
        filled, seen = shared.value, set()

        def step(batch):
            marks, sets = [], []
            for value in batch.column(0):
                found = shingles(value.as_py())
                mark = set_mark(found)
                wide = mark & (1 << 64) - 1
                if mark in seen or not int(filled[wide & SLOTS - 1]) >> (wide >> 58) & 1:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
                marks.append(mark)
                sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sets, pa.binary())], ["fp", "set"])

        return step

    return map_arrow(rows.select("text"), make, "fp long, set binary").dropDuplicates(["fp"])


def close(marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those that parities show not to be similar."""
    have = marks.filter("odd is not null").select("fp", "size", "odd").dropDuplicates(["fp"])
    one, two = (have.select(F.col("fp").alias(x), F.col("size").alias(f"size_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")

    def make():
        def step(batch):
            columns = [batch.column(i) for i in range(2, 6)]
            keep = [plausible(*(np.frombuffer(x.as_buffer(), np.uint8) for x in (o, p)), m.as_py() + n.as_py()) for o, p, m, n in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "odd_a", "odd_b", "size_a", "size_b")
    return stash(map_arrow(joined, make, "a long, b long"), "close_pairs")


def verified(rows: DataFrame, marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    pairs = close(marks, pairs)
    sets = stash(sets_of(rows, pairs), "sets")
    joined = pairs.join(sets.withColumnsRenamed({"fp": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"fp": "b", "set": "set_b"}), "b")

    def make():
        def step(batch):
            left, right = batch.column(2), batch.column(3)
            same = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

        return step

    found = stash(map_arrow(joined.select("a", "b", "set_a", "set_b"), make, "a long, b long"), "similar_pairs")
    for scratch in (sets, pairs):
        discard(scratch)
    return found


def near(x: str, y: str) -> F.Column:
    """Whether sets of these sizes can be similar."""
    return 10 * F.least(x, y) >= SIMILARITY * F.greatest(x, y)


def folded(odd: bytes) -> list[int]:
    """Parities of a set as FOLDED bits."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, FOLDED // 64), 0).tolist()


#: Names of the columns of a group's second member.
OTHER = {"fp": "b", "size": "b_size", "root": "b_root", "bits": "b_bits"}


def possible() -> F.Column:
    """Whether two members of different components may be similar by sizes and parities."""
    apart = reduce(add, (F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("b_bits", F.lit(i)))) for i in range(FOLDED // 64)))
    return (F.col("root") != F.col("b_root")) & near("size", "b_size") & (apart * (10 + SIMILARITY) <= (10 - SIMILARITY) * (F.col("size") + F.col("b_size")))


def pivots(placed: DataFrame, turn: int) -> DataFrame:
    """At most PIVOTS members of each group, by hashes of the turn."""
    one = F.struct("fp", "size", "root", "bits")
    draws = [F.min(F.struct(F.xxhash64("fp", F.lit(turn * PIVOTS + i)).alias("h"), one.alias("p")))["p"] for i in range(PIVOTS)]
    some = placed.groupBy("s").agg(F.array_distinct(F.array(*draws)).alias("p")).select("s", F.explode("p").alias("p"))
    return some.select("s", *(F.col(f"p.{c}").alias(d) for c, d in OTHER.items()))


def star(rows: DataFrame, marks: DataFrame, pairs: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``pairs`` (a, b) not ``tested`` before, and those of them that are similar."""
    fresh = stash(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "star_pairs")
    return fresh, verified(rows, marks, fresh)


def merged(known: DataFrame, more: DataFrame) -> DataFrame:
    """The components (fp, root) of ``known`` as the links ``more`` (a, b) join them: their
    stars stand for the links that made them."""
    stars = known.filter("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b"))
    return stash(components(stars.unionByName(more)).withColumnRenamed("node", "fp"), "star_components")


def mixed_groups(groups: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (s, fp, size, root) of groups that hold more than one component of ``known``."""
    placed = groups.select("s", "fp", "size").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = placed.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("s")
    return stash(placed.join(mixed, "s", "left_semi"), "mixed")


def classes_of(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The components (fp, root) of all similar pairs; sets without one may be left out."""
    candidates = fingerprint_pairs(marks)
    by_print = verified(rows, marks, candidates)
    groups = stash(meeting(marks), "meeting")
    pairs = groups.filter((F.col("fp") != F.col("least")) & near("size", "least_size")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    fresh, found = star(rows, marks, pairs, candidates)
    tested, found = fresh.unionByName(candidates), found.unionByName(by_print)
    known = stash(components(found).withColumnRenamed("node", "fp"), "star_components")
    mixed, linked = mixed_groups(groups, known), found.count()
    have = stash(with_folded(marks.join(mixed.select("fp").distinct(), "fp", "left_semi")), "folded")
    for turn in range(ROUNDS):
        placed = mixed.join(have, "fp")
        pairs = placed.join(pivots(placed, turn), "s").filter(possible())
        again, more = star(rows, marks, pairs.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")), tested)
        tested, new = tested.unionByName(again), more.count()
        if new:
            known = merged(known, more)
            mixed = mixed_groups(mixed, known)
        if new <= LITTLE * linked:
            break
        linked += new
    placed = mixed.join(have, "fp")
    cross = placed.join(placed.withColumnsRenamed(OTHER), "s").filter((F.col("fp") < F.col("b")) & possible())
    rest = stash(cross.select(F.col("fp").alias("a"), "b").distinct().join(tested, ["a", "b"], "left_anti"), "cross_pairs")
    return known if rest.isEmpty() else merged(known, verified(rows, marks, rest))


def with_folded(marks: DataFrame) -> DataFrame:
    """(fp, bits) of each set, once."""

    def make():
        def step(batch):
            bits = [folded(x.as_buffer()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["fp", "bits"])

        return step

    return map_arrow(marks.filter("odd is not null").select("fp", "odd").dropDuplicates(["fp"]), make, "fp long, bits array<long>")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row for each component of near copies: that of its
    least id (null only if all its ids are). Texts without a word are copies of each other.
    Rows with one id and one set of shingles are one document. Columns stay as they are.
    Shingles are computed anew where they are needed, for a copy of all would cost more."""
    rows = spread(id_text(docs, id_col, text_col))
    marks = stash(with_prefixes(rows), "set_prefixes")
    linked = classes_of(rows, marks)
    ids = marks.select("doc_id", "fp")
    classes = ids.select("fp").distinct().join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return keep_rooted(with_marks(spread(docs), text_col, "__fp"), ids, classes, id_col).select(*docs.columns)
