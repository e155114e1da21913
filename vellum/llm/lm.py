"""Language-model scoring with a log-frequency Bloom filter.

Counts of words, and of words after others, over all training documents are quantised to
levels (exact up to EXACT, then steps of a logarithm); a sequence of level q is put into the
filter as (sequence, 1) to (sequence, q). Probing (sequence, 1), (sequence, 2), ... until a
miss gives its level back, and from levels come smoothed probabilities:

    p(w)     = (c(w) + 1) / (sum of c over all words + V + 1)
    p(w | h) = (c(h w) + MU p(w)) / (n(h) + E + MU)

with c what a level stands for, n an exact total, and E what false hits add to a context's
sum: their rate for each word. An unseen word is one more outcome of count zero. So p sums
to 1 but for the quantising of counts over EXACT; a larger vocabulary lowers the rate, by
more ones for each sequence, so that E stays under a share of MU.

Each word stands for itself, as a context and after others. Only if OWN is set do the OWN most
frequent words alone; the others then stand for one of a few classes by hash, h' and w', with
c(h' w') c(w) / c(w') for c(h w) and n(h') for n(h): a smaller filter, but no pair of theirs
is counted by itself.

The filter is cut into blocks by hash, so each block is counted and built by one task and
nothing meets at one place. What bears on a word, alone or after others, lies in the range
of blocks of its hash's first bits; so a slice of the filter, some whole ranges of at most
SLICE_BYTES in all, scores its words on its own, and slices, each a broadcast and a pass
over the documents, add up. A larger filter means more slices, never a sparser filter. Texts
are split into words twice, to count words and to write each document once as numbers of
words; pairs are counted, and passes made, from those. What
p divides by bears on the word before, and each token of a text is before one other (the end
before the first); so it is taken from the score token by token, from exact counts.

The exact base score needs exact counts as well: those of the FREQUENT most frequent words
are broadcast; other words are joined to their counts by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from math import ceil, log2, log10
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, remainder, small_batches, spread, stash, texts_of

#: Counts that have a level of their own, and the step of the levels beyond.
EXACT, BASE = 8, 9 / 8
#: The highest level, of counts over 10**14.
LEVELS = 288
#: Share of ones that a block of the filter is sized for; words of it that hold level one of a
#: sequence, ones in each of them, and ones for each further level.
FILL, FIRST, FIRST_BITS, NEXT_BITS = 0.5, 3, 6, 8
#: How often a sequence that is not there reads as level one, by what factor a further word of
#: its level one lowers that, and the share of MU that E may reach.
FALSE, FALSER, ROOM = 2.0**-15, 2.0**-5, 0.5
#: Greatest slice of the filter that is broadcast at a time.
SLICE_BYTES = 96 << 20
#: Words whose exact counts are broadcast (some 30 bytes each), and the first bits of a hash
#: that tell its range of blocks.
FREQUENT, CLASS_BITS = 1 << 17, 8
#: Frequent words that stand for themselves, others for the class of their range; None: all do.
OWN: int | None = None
#: Tokens for each block of the filter; counts that the one-word estimate weighs.
BLOCK_TOKENS, MU = 1 << 19, 16.0
#: Tokens after which a task passes on its sequences, those it works on at a time, and the
#: distinct words that it keeps in memory.
FLUSH, STEP, WORD_FLUSH = 1 << 20, 1 << 17, 1 << 17
#: The end of a text, which also stands before the first word; no word has white space.
END = b"\n"

U = np.uint64


def tokens_of(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """Word -> number, with the words' hashes as an array; some words may be given."""

    def __init__(self, given: list[bytes] = (), hashes: np.ndarray | None = None):
        super().__init__(zip(given, range(len(given))))
        self.list: list[bytes] = list(given)
        self.hashes = np.zeros(0, U) if hashes is None else hashes
        self.given = len(self.list)

    def forget(self) -> None:
        """Drops all words but those given."""
        for word in self.list[self.given :]:
            del self[word]
        del self.list[self.given :]
        self.hashes = self.hashes[: self.given]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.list)
        self.list.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = self.list[len(self.hashes) :]
        if not new:
            return out
        self.hashes = np.concatenate((self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), U, len(new))))
        return out


def classes(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of words the hash where they are contexts of their own, else that of their class."""
    return np.where(own, hashes, mix((hashes >> U(64 - CLASS_BITS)) + U(0x9E3779B97F4A7C15)))


def pair_keys(hashes: np.ndarray, past: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Keys of what stands after ``past`` (both as ``classes``), in the words' own ranges."""
    top = U((1 << 64) - (1 << 64 - CLASS_BITS))
    return hashes & top | mix(past * U(0x9E3779B97F4A7C15) + now) >> U(CLASS_BITS)


def shifted(values: np.ndarray, starts: np.ndarray, end) -> np.ndarray:
    """Of each token that of the one before; the first of a text follows an end."""
    out = np.concatenate((values[:1], values[:-1]))
    out[starts] = end
    return out


def end_hash() -> np.uint64:
    return U(xxhash.xxh64_intdigest(END))


# -- counting -------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all rows: tasks count in part, the parts are added up."""

    def run(batches):
        seen: Counter[bytes] = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for text in texts_of(batch):
                seen.update(tokens_of(text))
                if len(seen) >= WORD_FLUSH:
                    yield from out()
        yield from out()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(keys: np.ndarray, counts: np.ndarray, block_bits: int) -> pa.RecordBatch:
    """Keys in order, with their counts, as a row for each block."""
    edges = np.searchsorted(keys >> U(64 - block_bits), np.arange((1 << block_bits) + 1, dtype=U))
    rows = []
    for b in np.flatnonzero(np.diff(edges)):
        part, c = keys[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]
        at = np.flatnonzero(c > 1)
        rows.append((int(b), part.tobytes(), at.astype("<u4").tobytes(), c[at].astype("<u8").tobytes()))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "hashes", "places", "counts"])


def word_blobs(counts: DataFrame, block_bits: int) -> DataFrame:
    """(block, hashes, places, counts): keys of words, and the counts over one with their
    places, packed."""

    def run(batches):
        held, ones, n = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0

        def out():
            keys, weights = np.concatenate(held), np.concatenate(ones)
            del held[1:], ones[1:]
            order = np.argsort(keys)
            return packed(keys[order], weights[order], block_bits)

        for batch in batches:
            held.append(np.fromiter(map(xxhash.xxh64_intdigest, batch.column(0).to_pylist()), U, batch.num_rows))
            ones.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= FLUSH:
                yield out()
                n = 0
        yield out()

    return counts.select("word", "n").mapInArrow(run, "block int, hashes binary, places binary, counts binary")


def sequence_blobs(train: DataFrame, block_bits: int, shared: Broadcast) -> DataFrame:
    """The same of pairs of words, of ``coded`` documents."""

    def run(batches):
        frequent: Frequent = shared.value
        held, n, end = [], 0, frequent.end_class()

        def out():
            keys, counts = np.unique(np.concatenate(held or [np.zeros(0, U)]), return_counts=True)
            held.clear()
            return packed(keys, counts, block_bits)

        for batch in batches:
            for _, lengths, numbers, rare in decoded(batch):
                h = np.concatenate((frequent.hashes, rare))[numbers]
                k = frequent.kinds(h, numbers)
                held.append(pair_keys(h, shifted(k, np.cumsum(lengths) - lengths, end), k))
                n += len(numbers)
                if n >= FLUSH:
                    yield out()
                    n = 0
        yield out()

    return train.select("codes", "rare", "given").mapInArrow(run, "block int, hashes binary, places binary, counts binary")


# -- the filter -----------------------------------------------------------------------


def level_of(counts: np.ndarray) -> np.ndarray:
    high = EXACT + np.floor(np.log(np.maximum(counts, 1) / EXACT) / np.log(BASE) + 1e-9).astype(np.int64)
    return np.minimum(np.where(counts <= EXACT, counts, high), LEVELS)


def estimates() -> np.ndarray:
    """Count that a level stands for: the middle of its range; 0 at level 0."""
    steps = EXACT * BASE ** np.arange(LEVELS + 1 - EXACT)
    low, high = np.ceil(steps - 1e-6), np.ceil(steps * BASE - 1e-6) - 1
    return np.concatenate((np.arange(EXACT), (low + np.maximum(low, high)) / 2))


@lru_cache
def masks(bits: int) -> np.ndarray:
    """65,536 random words with so many ones (fixed seed)."""
    at = np.random.default_rng(bits).permuted(np.tile(np.arange(64, dtype=np.uint8), (1 << 16, 1)), axis=1)[:, :bits]
    return np.bitwise_or.reduce(U(1) << at.astype(U), axis=1)


def spot(keys: np.ndarray, salt: int, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word inside its block and ones in there, for each key."""
    h = mix(keys + U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((h >> U(32)) * words >> U(32)).astype(np.int64), masks(bits)[(h & U(0xFFFF)).astype(np.int64)]


def first_words(distinct: int, mu: float) -> int:
    """Words of the filter that hold level one of a sequence, so that E is small."""
    return FIRST + max(0, ceil(log2(max(1.0, FALSE * distinct / (ROOM * mu))) / -log2(FALSER)))


def build_block(keys: np.ndarray, counts: np.ndarray, first: int = FIRST) -> bytes:
    """The filter's block over distinct keys, as 64-bit words; ``first`` hold level one."""
    levels = level_of(counts)
    ones = len(keys) * first * FIRST_BITS + int((levels - 1).sum()) * NEXT_BITS
    words = np.zeros(max(1, ceil(-ones / np.log(1 - FILL) / 64)), U)

    def put(salt: int, bits: int) -> None:
        at, mask = spot(keys, salt, U(len(words)), bits)
        np.bitwise_or.at(words, at, mask)

    for part in range(first):
        put(part, FIRST_BITS)
    for level in range(2, int(levels.max()) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        put(first + level, NEXT_BITS)
    return words.tobytes()


def build_blocks(blobs: DataFrame, first: int = FIRST) -> DataFrame:
    """(block, content); a block's blobs come to one task, which holds one block."""

    def run(batches):
        now, held, ones = None, [], []

        def out():
            keys, weights = np.concatenate(held), np.concatenate(ones)
            order = np.argsort(keys)
            keys, weights = keys[order], weights[order]
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            content = build_block(keys[new], np.add.reduceat(weights, new), first)
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([content], pa.binary())], ["block", "content"])

        for batch in batches:
            for block, hashes, places, counts in zip(*(batch.column(i) for i in range(4))):
                if now is not None and block.as_py() != now:
                    yield from out()
                    held, ones = [], []
                now = block.as_py()
                held.append(np.frombuffer(hashes.as_py(), "<u8"))
                count = np.ones(len(held[-1]), np.int64)
                count[np.frombuffer(places.as_py(), "<u4")] = np.frombuffer(counts.as_py(), "<u8")
                ones.append(count)
        if now is not None:
            yield from out()

    return blobs.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, content binary")


class Filter:
    """Blocks ``low`` to ``high`` of the filter; keys of other blocks read as level 0."""

    def __init__(self, block_bits: int, low: int, high: int, blocks: Iterable[tuple[int, bytes]], size: int, first: int = FIRST):
        """blocks: (block, content), of ``size`` bytes of content in all."""
        self.shift, self.low, self.first = U(64 - block_bits), low, first
        self.start, self.words = np.zeros(high - low + 1, np.int64), np.zeros(high - low + 1, U)
        self.content, at = np.zeros(size // 8, U), 0
        for block, content in blocks:
            part = np.frombuffer(content, U)
            self.start[block - low], self.words[block - low] = at, len(part)
            self.content[at : at + len(part)] = part
            at += len(part)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, by probing until a miss."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        block = (keys >> self.shift).astype(np.int64) - self.low
        alive = np.flatnonzero((block >= 0) & (block < len(self.words)))
        alive = alive[self.words[block[alive]] > 0]
        keys, start, words = keys[alive], self.start[block[alive]], self.words[block[alive]]

        def probe(salt: int, bits: int) -> None:
            nonlocal alive, keys, start, words
            at, mask = spot(keys, salt, words, bits)
            hit = self.content[start + at] & mask == mask
            if not hit.all():
                alive, keys, start, words = alive[hit], keys[hit], start[hit], words[hit]

        for part in range(self.first):
            probe(part, FIRST_BITS)
        level = 1
        while len(alive):
            out[alive] = level
            if level == LEVELS:
                break
            level += 1
            probe(self.first + level, NEXT_BITS)
        return out[back]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether the blocks of the keys are among these."""
        block = (keys >> self.shift).astype(np.int64) - self.low
        return (block >= 0) & (block < len(self.words))


# -- scoring --------------------------------------------------------------------------


class Frequent:
    """The frequent words, the most frequent first, with hashes and counts, packed."""

    def __init__(self, words: list[bytes], counts: list[int]):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.blob = b" ".join(words[i] for i in order)  # no word holds a space
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in order), U, len(order))
        self.counts = np.array([counts[i] for i in order], float)
        self.whole = OWN is None  # no word stands for a class
        self.own = len(order) if self.whole else min(OWN, len(order))

    def words(self) -> list[bytes]:
        return self.blob.split(b" ") if self.blob else []

    def kinds(self, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """What the words of these hashes and numbers stand for."""
        return hashes if self.whole else classes(hashes, numbers < self.own)

    def end_number(self) -> int:
        """Number of the end, or one past all."""
        return int(np.append(np.flatnonzero(self.hashes == end_hash()), len(self.hashes))[0])

    def end_class(self) -> np.uint64:
        return self.kinds(np.array([end_hash()]), np.array([self.end_number()]))[0]


def frequent_words(counts: DataFrame) -> Frequent:
    """The words over a count that at most FREQUENT reach; that count comes from a
    histogram of its logarithm, so that only those words come to the driver."""
    step = F.floor(F.log2("n") * 16)
    shares = sorted(((r.s, r.c) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = None, 0
    for s, c in shares:
        held += c
        if held > FREQUENT:
            break
        least = s
    table = counts.filter(step >= (least if least is not None else 1 << 20)).toArrow()
    return Frequent(table["word"].to_pylist(), table["n"].to_pylist())


def class_sums(counts: DataFrame, shared: Broadcast) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact totals of the classes, the sums of what the levels of their words stand for,
    and the latter over all words."""

    def run(batches):
        frequent: Frequent = shared.value
        own, count = set(frequent.words()[: frequent.own]), estimates()
        n, mass = np.zeros(1 + (1 << CLASS_BITS)), np.zeros(1 + (1 << CLASS_BITS))
        for batch in batches:
            words, some = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            kind = np.fromiter((1 << CLASS_BITS if w in own else xxhash.xxh64_intdigest(w) >> 64 - CLASS_BITS for w in words), np.int64, len(words))
            n += np.bincount(kind, some, len(n))
            mass += np.bincount(kind, count[level_of(some)], len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(mass)], ["kind", "n", "mass"])

    rows = counts.select("word", "n").mapInArrow(run, "kind long, n double, mass double").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect()
    n, mass = np.zeros(1 + (1 << CLASS_BITS)), np.zeros(1 + (1 << CLASS_BITS))
    for r in rows:
        n[r.kind], mass[r.kind] = r.n, r.mass
    return n[:-1], mass[:-1], float(mass.sum())


class Model(NamedTuple):
    """What a pass scores by: a slice of the filter, the frequent words, the totals of the
    classes and the sums of their words' estimates (both empty without classes), all tokens and distinct words of the
    training texts, the sum over all words, and the weight of the one-word estimate."""

    filter: Filter
    frequent: Frequent
    class_totals: np.ndarray
    class_mass: np.ndarray
    total: int
    distinct: int
    mass: float
    mu: float

    def false_mass(self) -> float:
        kinds = self.frequent.own + len(self.class_totals) if len(self.class_totals) else self.distinct
        return FALSE * FALSER ** (self.filter.first - FIRST) * kinds


def weight(word: np.ndarray, share: np.ndarray, past: np.ndarray, now: np.ndarray, both: np.ndarray, model: Model) -> np.ndarray:
    """What p divides, over MU: from the words' counts, their shares of their classes, the
    totals of the classes before (infinite if not at hand) and of their own, and the counts
    of both together."""
    alone = (word + 1) / (model.mass + model.distinct + 1)
    return np.minimum(both, np.minimum(now, past)) * share / model.mu + alone


def room(past: np.ndarray, model: Model) -> np.ndarray:
    """What p divides by, over MU, from the total of the class before. (Without a total
    nothing after it is in the filter, and a pass that knows that gives no credit.)"""
    return 1 + (past + np.where(past > 0, model.false_mass(), 0.0)) / model.mu


def smoothed(word: np.ndarray, share: np.ndarray, past: np.ndarray, now: np.ndarray, both: np.ndarray, model: Model) -> np.ndarray:
    """p of words."""
    return weight(word, share, past, now, both, model) / room(past, model)


#: Columns of coded documents: what the base score needs of the frequent words, a code for
#: each token, and the hashes of the rare words, with these words and their numbers of tokens.
#: A code is the number of a frequent word or, past the ``given`` ones, a place in ``rare``.
_CODED = {"row": pa.int64(), "doc_id": None, "n_tokens": pa.int64(), "known": pa.int64(), "sums": pa.float64(), "given": pa.int32(), "codes": pa.binary(), "rare": pa.binary(), "words": pa.list_(pa.binary()), "tfs": pa.list_(pa.int64())}
_CODED_SQL = "row long, doc_id {}, n_tokens long, known long, sums double, given int, codes binary, rare binary, words array<binary>, tfs array<long>"


def coded(docs: DataFrame, shared: Broadcast, total: int, distinct: int) -> DataFrame:
    """Of (doc_id, text), a row for each document: its words as numbers."""

    def run(batches):
        frequent: Frequent = shared.value
        words, base = Words(frequent.words(), frequent.hashes), np.append(np.log10(frequent.counts + 1), 0.0)
        row, given = TaskContext.get().partitionId() << 40, words.given

        def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
            offsets = (edges * values.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])

        for batch in batches:
            ids, texts, done = batch.column(0), texts_of(batch), 0
            while done < batch.num_rows:
                flat, lengths = [], []
                while done + len(lengths) < batch.num_rows and len(flat) < STEP:
                    more = tokens_of(next(texts))
                    flat += more
                    lengths.append(len(more))
                if len(words) >= given + WORD_FLUSH:
                    words.forget()
                numbers, n = words.numbers(flat), np.array(lengths)
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = np.add.reduceat(base[np.minimum(numbers, given)], ends[:-1]) - n * log10(total + distinct + 1)
                known = np.add.reduceat((numbers < given).astype(np.int64), ends[:-1])
                at = np.flatnonzero(numbers >= given)
                doc = np.repeat(np.arange(len(n)), n)[at]
                keys, place, tf = np.unique((doc << 32) + numbers[at], return_inverse=True, return_counts=True)
                edges = np.searchsorted(keys >> 32, np.arange(len(n) + 1))
                codes, rare = numbers.astype("<u4"), keys & 0xFFFFFFFF
                codes[at] = given + place - edges[doc]
                spelt = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array([words.list[i] for i in rare.tolist()], pa.binary()))
                tfs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tf, pa.int64()))
                columns = [row + np.arange(len(n)), ids.slice(done, len(n)), n, known, sums, np.full(len(n), given), binaries(codes, ends), binaries(words.hashes[rare].astype("<u8"), edges), spelt, tfs]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _CODED.values())], list(_CODED))
                done, row = done + len(n), row + len(n)

    return docs.mapInArrow(run, _CODED_SQL.format(docs.schema["doc_id"].dataType.simpleString()))


def decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of (codes, rare, given, ...) some STEP tokens at a time: the first of the documents,
    their lengths, the numbers of their words, and the hashes of those past the given ones."""
    codes, rare = batch.column(0), batch.column(1)
    lengths = pc.binary_length(codes).to_numpy().astype(np.int64) // 4
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        held = ends[first - 1] if first else 0
        last = min(len(lengths), int(np.searchsorted(ends, held + STEP)) + 1)
        numbers = np.frombuffer(b"".join(codes.slice(first, last - first).to_pylist()), "<u4").astype(np.int64)
        own = rare.slice(first, last - first)
        n, sizes = lengths[first:last], pc.binary_length(own).to_numpy().astype(np.int64) // 8
        shift = np.repeat(np.cumsum(sizes) - sizes, n)
        numbers += np.where(numbers >= batch.column(2)[0].as_py(), shift, 0)
        yield first, n, numbers, np.frombuffer(b"".join(own.to_pylist()), "<u8")
        first = last


def _pass(docs: DataFrame, shared: Broadcast, first: bool) -> DataFrame:
    """Of ``coded`` documents (row, score): the scores by this slice; the ``first`` pass
    also divides by what comes after the frequent words."""

    def run(batches):
        model: Model = shared.value
        frequent, filter_, count = model.frequent, model.filter, estimates()
        given, own, end = len(frequent.hashes), frequent.own, frequent.end_class()
        level, mine = np.full(given, -1), filter_.holds(frequent.hashes)

        def totals_of(hashes):
            """Totals of words that do not stand for themselves by the broadcast counts."""
            return np.full(len(hashes), np.inf) if frequent.whole else model.class_totals[(hashes >> U(64 - CLASS_BITS)).astype(np.int64)]

        def spent(totals):
            return np.log10(room(np.where(np.isinf(totals), 0, totals), model))

        total = np.concatenate((frequent.counts[:own], totals_of(frequent.hashes[own:])))
        total_end = np.append(total, totals_of(np.array([end_hash()])))[frequent.end_number()]
        divided = spent(total)

        for batch in batches:
            for done, n, numbers, rare in decoded(batch):
                # of the words: the frequent ones, then the rare ones of these documents
                hashes, starts = np.concatenate((frequent.hashes, rare)), np.cumsum(n) - n
                totals, holds = np.concatenate((total, totals_of(rare))), filter_.holds(rare)
                here = np.flatnonzero(np.concatenate((mine, holds))[numbers])  # other words are another slice's
                some = numbers[here]
                seen = np.zeros(given, bool)
                seen[some[some < given]] = True
                unknown = np.flatnonzero(seen & (level < 0))
                level[unknown] = filter_.levels(frequent.hashes[unknown])
                word = count[np.concatenate((level, filter_.levels(rare)))[some]]
                k = frequent.kinds(hashes, np.arange(len(hashes)))
                past, before = shifted(totals[numbers], starts, total_end)[here], shifted(k[numbers], starts, end)[here]
                h, now = hashes[some], totals[some]
                share, most = 1.0, np.where(np.isinf(now), word, now)
                if not frequent.whole:
                    mass = model.class_mass[(h >> U(64 - CLASS_BITS)).astype(np.int64)]
                    share = np.where(some >= own, word / np.maximum(1, mass), 1.0)
                both = count[filter_.levels(pair_keys(h, before, k[some]))]
                p = np.zeros(len(numbers))
                p[here] = np.log10(weight(word, share, past, most, both, model))
                if first:
                    p -= np.concatenate((divided, spent(totals[given:])))[numbers]
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(done, len(n)), pa.array(np.add.reduceat(p, starts))], ["row", "score"])

    return docs.select("codes", "rare", "given", "row").mapInArrow(run, "row long, score double")


def filter_slices(blocks: DataFrame, block_bits: int, size: int) -> list[tuple[int, int, int]]:
    """(first block, last block, bytes) of each slice: whole ranges of blocks (those of one
    class), of at most ``size`` bytes unless one range is larger. They cover all blocks."""
    width = block_bits - CLASS_BITS
    ranges = blocks.groupBy(F.shiftright("block", width).alias("r")).agg(F.sum(F.length("content")).alias("n"))
    sizes = {r.r: r.n for r in ranges.collect()}
    slices = [(0, (1 << width) - 1, sizes.get(0, 0))]
    for r in range(1, 1 << CLASS_BITS):
        low, _, held = slices[-1]
        last, n = ((r + 1) << width) - 1, sizes.get(r, 0)
        if held + n <= size:
            slices[-1] = low, last, held + n
        else:
            slices.append((r << width, last, n))
    return slices


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, mu: float = MU) -> DataFrame:
    """Learns from the rows whose crc32 of the id modulo ``folds`` is not ``held`` and
    scores all rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words in lower case (A-Z only) and one end for each text; a null or empty
    text is the end alone. Ids may be null (fold 0) or repeat; each row counts and gets a
    row. An empty table gives an empty one; without training rows nothing is known and
    each score is that of an empty model. Further columns are left out; texts of any
    length count whole."""
    rows = spread(id_text(df, id_col, text_col))
    with small_batches(df.sparkSession):
        return _scored(rows, folds, held, mu)


def _scored(rows: DataFrame, folds: int, held: int, mu: float) -> DataFrame:
    """All passes run in here; what is returned reads their tables."""
    train = rows.filter(remainder("doc_id", folds) != held)
    counts = stash(word_counts(train), "word_counts")
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = found.n, found.v
    context = rows.sparkSession.sparkContext
    frequent = frequent_words(counts)
    known = context.broadcast(frequent)
    totals, masses, mass = class_sums(counts, known)
    if frequent.whole:
        totals = masses = np.zeros(0)
    first = first_words(distinct, mu)
    block_bits = CLASS_BITS + max(0, ceil(log2(max(1, total) / BLOCK_TOKENS)) - CLASS_BITS)
    docs = stash(coded(rows, known, total, distinct), "coded", compression="zstd")
    train = docs.filter(remainder("doc_id", folds) != held)
    blobs = word_blobs(counts, block_bits).unionByName(sequence_blobs(train, block_bits, known))
    blocks = stash(build_blocks(blobs, first), "filter_blocks")
    known.destroy()
    passes = []
    for i, (low, high, size) in enumerate(filter_slices(blocks, block_bits, SLICE_BYTES)):
        part = blocks.filter(F.col("block").between(low, high)).toLocalIterator()
        model = Model(Filter(block_bits, low, high, part, size, first), frequent, totals, masses, total, distinct, mass, mu)
        shared = context.broadcast(model)
        passes.append(stash(_pass(docs, shared, i == 0), "scored"))
        shared.destroy()  # what it was for is written
    scores = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.sum("score").alias("score"))
    rare = docs.select("row", F.explode(F.arrays_zip("words", "tfs")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.tfs").alias("tf")).join(counts, "word")
    false = model.false_mass()
    spent = F.sum(F.col("tf") * F.log10(1 + (F.col("n") + false) / mu)) if frequent.whole else F.lit(0.0)
    rare = rare.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("gain"), spent.alias("spent"))
    rows = docs.select("row", "doc_id", "n_tokens", "known", "sums").join(scores, "row").join(rare, "row", "left")
    rows = rows.withColumn("known", F.col("known") + F.coalesce("more", F.lit(0)))
    if frequent.whole:  # a pass cannot tell false hits after words that are not known
        unseen = (F.col("n_tokens") - F.col("known")) * F.lit(log10(1 + false / mu))
        rows = rows.withColumn("score", F.col("score") - F.coalesce("spent", F.lit(0.0)) - unseen)
    return rows.select(
        "doc_id",
        (remainder("doc_id", folds) == held).alias("held_out"),
        "n_tokens",
        F.col("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )
