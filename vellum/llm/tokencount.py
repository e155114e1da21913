"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, of fixed greatest
size; tier two encodes the others through a cache in each worker. Pre-tokens are never
shuffled: each task summarises its own by a bounded heavy-hitter count, one row, and only
these rows meet, FAN of them at a time, until one is left. The table changes the speed
alone, never a count.

A SentencePiece model whose pieces hold the space mark only at their start, and no line
feed, never merges across the start of a run of spaces or a line feed. So the tokens of
a text are those of its pre-tokens: spaces with what follows them, or line feeds.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, spread, stash, texts_of

#: Entries of the broadcast table, and the longest pre-token in it (characters).
TABLE_ENTRIES, TABLE_LENGTH = 1 << 16, 32
#: Pre-tokens that a task counts at a time, and those that it reports.
TASK_COUNTERS, TASK_REPORTS = 1 << 18, 1 << 12
#: Summaries that one task merges.
FAN = 64
#: Entries of a worker's cache.
CACHE_ENTRIES = 1 << 19

PRE_TOKEN = re.compile(r" +[^ \n]*|[^ \n]+|\n+")


def pre_tokens(text: str) -> list[str]:
    """Of the text as the model sees it: the space mark is a space, one is put first."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast table first, then what was encoded
    here; what was encoded is dropped when full."""

    def __init__(self, model: bytes, table: dict[str, int]):
        super().__init__(table)
        self.table = table
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.lead = len(self.encode("\n"))

    def __missing__(self, piece: str) -> int:
        n = len(self.encode("\n" + piece)) - self.lead  # a line feed parts it from the mark put first
        if len(piece) <= TABLE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def check_model(model: bytes) -> None:
    """The splits need these properties; a model without them is refused."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")
    if sp.encode(" ", out_type=str) == [] or len(sp.encode("a  b")) == len(sp.encode("a b")) or sp.encode("ﬁ", out_type=str)[-1] == "fi":
        raise ValueError("the model's normaliser changes texts")


def summary(seen: Counter[str], size: int) -> pa.RecordBatch:
    """One row of the most frequent entries."""
    top = [(p, c) for p, c in seen.most_common(size) if len(p) <= TABLE_LENGTH]
    return pa.RecordBatch.from_arrays([pa.array([[p for p, _ in top]], pa.list_(pa.string())), pa.array([[c for _, c in top]], pa.list_(pa.int64()))], ["pieces", "counts"])


def merged(summaries: DataFrame, tasks: int) -> DataFrame:
    """The summaries added up in so many tasks, each keeping at most TASK_COUNTERS."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for pieces, counts in zip(*batch.columns):
                seen.update(dict(zip(pieces.as_py(), counts.as_py())))
                if len(seen) > TASK_COUNTERS:
                    seen = Counter(dict(seen.most_common(TASK_COUNTERS // 2)))
        yield summary(seen, TABLE_ENTRIES)

    return summaries.repartition(tasks).mapInArrow(run, "pieces array<string>, counts array<long>")


def frequent(df: DataFrame, model: bytes) -> dict[str, int]:
    """Lengths of at most TABLE_ENTRIES frequent pre-tokens over all rows of ``text``.
    Each task keeps at most TASK_COUNTERS counters (the rarer half goes when full) and
    reports TASK_REPORTS; the sums of these reports rank the table."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(pre_tokens(text or ""))
                if len(seen) > TASK_COUNTERS:
                    seen = Counter(dict(seen.most_common(TASK_COUNTERS // 2)))
        yield summary(seen, TASK_REPORTS)

    found = stash(df.select("text").mapInArrow(run, "pieces array<string>, counts array<long>"), "summaries")
    left = found.count()
    while left > 1:
        left = -(-left // FAN)
        found = stash(merged(found, left), "summaries")
    row, lengths = found.first(), Lengths(model, {})
    return {piece: lengths[piece] for piece in row.pieces} if row else {}


def count_tokens(df: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and SentencePiece tokens of each whole text, one row per input row.

    model: content of a model file, broadcast (its size is that of the file).
    Returns doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). A null
    text counts as empty: no bytes, no tokens. Ids may be null or repeat; an empty table
    gives an empty one; further columns are left out."""
    check_model(model)
    rows = spread(id_text(df, id_col, text_col))
    shared = df.sparkSession.sparkContext.broadcast((model, frequent(rows, model)))

    def make():
        lengths = Lengths(*shared.value)

        def step(batch):
            n_bytes, n_tokens = [], []
            for text in texts_of(batch):
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(sum(map(lengths.__getitem__, pre_tokens(text or ""))))
            over = pa.array([n > limit for n in n_tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
