"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The canonical tokens of byte strings form a monoid under *join*: the tokens of ``a + b``
come from those of ``a`` and ``b`` by re-encoding a window around the boundary. A token
sequence is canonical exactly if each neighbouring pair is (the two tokens re-encode to
themselves); so the window is large enough as soon as the pair at each of its ends is
canonical, and tokens outside it provably stay. A piece is encoded by halves down to its
bytes, joined up the tree; decoding concatenates neighbours up such a tree, level by level.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import batched
from operator import concat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, spread, texts_of

#: Entries of a worker's cache of encoded pieces, and bytes of the longest cached piece.
CACHE_ENTRIES, CACHE_PIECE = 250_000, 48
#: Bytes up to which a node of the tree is remembered.
SHORT = 8
#: Pieces of a text that are held at a time.
CHUNK = 1 << 20


class ByteBPE:
    """Encoder over a table of ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._short: dict[bytes, list[int]] = {}
        self.joins = 0

    @classmethod
    def from_tiktoken(cls, content: bytes) -> ByteBPE:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def window(self, data: bytes) -> list[int]:
        """Canonical tokens of the bytes of a window; short ones are remembered."""
        if (known := self._short.get(data)) is not None:
            return known
        out = self.merge(data)
        if len(data) <= SHORT:
            self._remember(data, out)
        return out

    def merge(self, data: bytes) -> list[int]:
        """The merges by definition: always the pair of lowest rank, the leftmost first."""
        ranks, n = self.ranks, len(data)
        if data in ranks:
            return [ranks[data]]
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if mid >= n or mid < 0 or end[mid] != stop:
                continue
            end[i], end[mid] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def canonical(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, re-encode to themselves."""
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) > CACHE_ENTRIES:
                self._pairs.clear()
            known = self._pairs[a, b] = self.window(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation, by growing boundary windows."""
        if not left or not right:
            return left or right
        self.joins += 1
        if self.canonical(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.window(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.canonical(left[a - 1], window[0])) and (b == len(right) or self.canonical(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        """Canonical tokens: those of the halves, joined; a leaf is one byte. Nodes of few
        bytes are remembered."""
        if (known := self._short.get(data)) is not None:
            return known
        if len(data) < 2:
            return [self.ranks[data]] if data else []
        half = len(data) // 2
        out = self.join(self.tree(data[:half]), self.tree(data[half:]))
        if len(data) <= SHORT:
            self._remember(data, out)
        return out

    def _remember(self, data: bytes, tokens: list[int]) -> None:
        if len(self._short) >= CACHE_ENTRIES:
            self._short.clear()
        self._short[data] = tokens

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is a token is that token; others go through the tree."""
        return [self.ranks[data]] if data in self.ranks else self.tree(data)

    def decode(self, ids) -> bytes:
        """Bytes of the tokens, concatenated up the tree: each level joins neighbours."""
        parts = list(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        while len(parts) > 1:
            last = parts[len(parts) & ~1 :]
            parts = [*map(concat, parts[::2], parts[1::2]), *last]
        return parts[0] if parts else b""


class PieceCache(dict):
    """Piece -> ids as little-endian 32-bit integers; emptied when full."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.bpe.encode_piece(data), "<u4").tobytes()
        if len(data) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def encode_text(text: str, pattern: regex.Pattern, cache: PieceCache) -> bytes:
    """Ids of the text as little-endian unsigned 32-bit integers."""
    if len(text) < CHUNK:
        return b"".join(map(cache.__getitem__, pattern.findall(text)))
    pieces = (m[0] for m in pattern.finditer(text))
    return b"".join(b"".join(map(cache.__getitem__, some)) for some in batched(pieces, CHUNK))


def encode_documents(df: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text; one row per input row, whatever its id.

    vocabulary: content of a rank file, broadcast (its size is that of the file).
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``,
    token_ids (little-endian unsigned 32-bit). A null or empty text has no tokens; ids
    may be null or repeat; an empty table gives an empty one; further columns are left
    out. A text of any length is encoded whole. A decoding that differs from the text
    is an error."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        bpe = ByteBPE.from_tiktoken(shared.value)
        cache, compiled = PieceCache(bpe), regex.compile(pattern)

        def step(batch):
            n, sha, back, blobs = [], [], [], []
            for text in texts_of(batch):
                blob = encode_text(text or "", compiled, cache)
                decoded = bpe.decode(np.frombuffer(blob, "<u4"))
                if decoded != (text or "").encode():
                    raise ValueError("decoded bytes differ from the text")
                n.append(len(blob) // 4)
                sha.append(hashlib.sha256(blob).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    blobs.append(blob)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

        return step

    rows = spread(id_text(df, id_col, text_col))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(rows, make, schema + (", token_ids binary" if with_ids else ""))
