"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a linear classifier over hashed
character n-grams says which half of the languages a text belongs to. Decoding adds up
each language's losses over the bits, weighted by how well a bit's classifier does on that
language, and takes the nearest codeword; a close second flags the text as ambiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, map_arrow, remainder, spread, texts_of

#: Hashed n-grams (orders 1 to 3) fall into this many dimensions.
DIMENSIONS, ORDERS = 2048, 3
#: Labelled rows that classifiers are fitted on: SAMPLE in all, but EACH of a language.
SAMPLE, EACH = 6000, 12
#: Seed of the draw of those rows.
DRAW = 3
#: Ridge of the fit, sharpness of the scores, and the score gap below which a text is
#: ambiguous.
RIDGE, SHARPNESS, GAP = 0.3, 12.0, 0.2
#: Characters that are hashed, and documents and losses that are decoded, at a time.
CHUNK, STEP, LOSSES = 1 << 20, 512, 512 * 256 * 80


@lru_cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def marked(text: str) -> Iterator[np.ndarray]:
    """Codes of the text, CHUNK at a time, zero for what is no letter; a zero at each end."""
    yield np.zeros(1, np.uint64)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        codes[~letters()[codes]] = 0
        yield codes
    yield np.zeros(1, np.uint64)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of n-gram counts, at length one; None without a letter. What is no
    letter parts words, as one mark. What a chunk ends with is carried into the next."""
    counts, carry, lettered = np.zeros(DIMENSIONS), np.zeros(0, np.uint64), False
    for codes in marked((text or "").lower()):
        before = np.concatenate((carry[-1:] if len(carry) else [1], codes[:-1]))
        codes = codes[(codes != 0) | (before != 0)]
        if not len(codes):
            continue
        lettered = lettered or bool(codes.any())
        whole = np.concatenate((carry, codes))
        for order in range(ORDERS):
            part = whole[max(0, len(carry) - order) :]
            size = len(part) - order
            if size <= 0:
                continue
            grams = part[:size]
            for i in range(1, order + 1):
                grams = grams * np.uint64(0x110001) + part[i : i + size]
            spread = (grams + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)
            counts += np.bincount(spread.astype(np.int64), minlength=DIMENSIONS)
        carry = whole[-(ORDERS - 1) :]
    return (np.sqrt(counts) / np.sqrt(counts.sum())).astype(np.float32) if lettered else None


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all ways to part up to five languages; else random ones (fixed
    seed), the draw of the largest least distance out of 64."""
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, int).reshape(-1, n).T
    random, width = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(64):
        draw = random.choice((-1, 1), (n, width))
        exact = draw.astype(np.float32)
        least = width
        for at in range(0, n, 256):
            same = exact[at : at + 256] @ exact.T
            same[np.arange(len(same)), at + np.arange(len(same))] = -width
            least = min(least, (width - int(same.max())) // 2)
        if least > most:
            best, most = draw, least
    return best


class Codes:
    """Fitted classifiers and their decoder."""

    def __init__(self, names: list[str], vectors: np.ndarray, labels: np.ndarray):
        self.names, self.words = names, codewords(max(1, len(names)))
        if self.words.shape[1] == 0:
            return
        x = np.ones((len(vectors), vectors.shape[1] + 1), np.float32)
        x[:, :-1] = vectors
        share = np.bincount(labels, minlength=len(names))
        weight = (1 / np.maximum(1, share))[labels, None].astype(np.float32)  # each language counts alike
        right_side = x.T @ (self.words[labels] * weight).astype(np.float32)
        gram = (x.T @ (x * weight)).astype(np.float64)
        gram[np.diag_indices_from(gram)] += RIDGE * len(names) * 1e-2
        self.planes = np.linalg.solve(gram, right_side)
        right = (np.sign(x @ self.planes) == self.words[labels]).astype(float)
        trust = np.array([right[labels == i].mean(0) if (labels == i).any() else np.ones(self.words.shape[1]) for i in range(len(names))]) + 1e-9
        self.trust = trust / trust.sum(1, keepdims=True)

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score, and gap to the second."""
        if self.words.shape[1] == 0:
            return np.zeros(len(vectors), int), np.ones(len(vectors)), np.ones(len(vectors))
        margins = vectors @ self.planes[:-1] + self.planes[-1]
        losses = (self.trust[None] * np.exp(-margins[:, None, :] * self.words[None])).sum(2)
        odds = np.exp(SHARPNESS * (losses.min(1, keepdims=True) - losses))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        first = odds[np.arange(len(odds)), best]
        odds[np.arange(len(odds)), best] = 0
        return best, first, first - odds.max(1)


def fit(labelled: DataFrame) -> Codes:
    """Classifiers from (doc_id, text, lang) rows.

    Every language is learned. Some SAMPLE labelled rows are fitted on, the same number of
    each language, EACH at least, drawn row by row with a fixed seed, whatever their ids
    and texts; their feature vectors, of fixed size, come to one task, and what it has
    fitted to the driver. Shares are so much larger than they need be (six deviations) that
    no language falls short."""
    labelled = labelled.filter("text is not null and lang is not null")
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    names = sorted(r.lang for r in found)
    if not names:
        return Codes([], np.zeros((0, DIMENSIONS)), np.zeros(0, int))
    each = max(EACH, SAMPLE // len(names))
    drawn = each + 6 * sqrt(each) + EACH
    shares = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, drawn / r.n)) for r in found], "lang string, share double")

    def make():
        def step(batch):
            found = [(lang, v.astype("<f2").tobytes()) for lang, t in zip(batch.column(1).to_pylist(), texts_of(batch)) if (v := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["lang", "vector"])

        return step

    some = labelled.select("text", "lang", F.rand(DRAW).alias("at")).join(F.broadcast(shares), "lang").filter(F.col("at") < F.col("share"))
    return fitted(names, map_arrow(some.select("text", "lang"), make, "lang string, vector binary"))


def fitted(names: list[str], rows: DataFrame) -> Codes:
    """Classifiers from (lang, vector) rows, fitted in one task, in one order of the rows:
    vectors and the matrices of the fit take some 200 MB, which the driver need not have."""

    def run(batches):
        found = sorted(pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns)))
        vectors = np.frombuffer(b"".join(v for _, v in found), "<f2").astype(np.float32).reshape(-1, DIMENSIONS)
        number = {name: i for i, name in enumerate(names)}
        codes = Codes(names, vectors, np.array([number[lang] for lang, _ in found], int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(codes)], pa.binary())], ["codes"])

    row = rows.repartition(1).mapInArrow(run, "codes binary").first()
    return pickle.loads(row.codes) if row else Codes(names, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int))


def only(name: str) -> Codes:
    """What gives ``name`` to every text with a letter."""
    return Codes([name], np.zeros((0, DIMENSIONS)), np.zeros(0, int))


def predict(df: DataFrame, codes: Codes, text_col: str = "text") -> DataFrame:
    """All columns and __lang, __score (0 to 1) and __ambiguous. A text without a letter,
    or null, is ``und`` with score 0 and not ambiguous; so is any text if no language was
    learned. Texts count whole, of any length."""
    shared = df.sparkSession.sparkContext.broadcast(codes)

    def make():
        codes = shared.value

        def step(batch):
            step = max(1, min(STEP, LOSSES // max(1, codes.words.size)))
            for at in range(0, batch.num_rows, step):
                yield predicted(batch.slice(at, step))

        def predicted(batch):
            vectors = [features(v.as_py()) for v in batch.column(batch.schema.get_field_index(text_col))]
            known = np.array([v is not None for v in vectors], bool) & bool(codes.names)
            langs, scores, close = np.array(["und"] * len(vectors), object), np.zeros(len(vectors)), np.zeros(len(vectors), bool)
            if known.any():
                best, score, gap = codes.decode(np.array([v for v, k in zip(vectors, known) if k]))
                langs[known] = [codes.names[i] for i in best]
                scores[known], close[known] = score, gap < GAP
            new = [pa.array(langs, pa.string()), pa.array(scores), pa.array(close)]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "__lang", "__score", "__ambiguous"])

        return step

    new = [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__ambiguous", T.BooleanType())]
    return map_arrow(df, make, T.StructType([*df.schema.fields, *new]))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the rows whose crc32 of the id modulo ``folds`` is not ``held`` and
    predicts all: doc_id, held_out, lang_pred, score, ambiguous; one row per input row.

    Rows with a null text or lang teach nothing. Ids may be null (fold 0, so they teach)
    or repeat. An empty table gives an empty one; further columns are left out."""
    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    codes = fit(rows.filter(remainder("doc_id", folds) != held))
    found = predict(id_text(rows), codes)
    return found.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__ambiguous").alias("ambiguous"))
