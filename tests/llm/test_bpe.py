import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import bpe
from vellum.llm.queries import vocabulary

CONTENT = vocabulary("byte_bpe_multi_50k.tiktoken")
BPE = bpe.ByteBPE.from_tiktoken(CONTENT)
PATTERN = regex.compile(P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}, special_tokens={})


def encoded(text):
    return np.frombuffer(bpe.encode_text(text, PATTERN, bpe.PieceCache(BPE)), "<u4").tolist()


def test_every_token_encodes_to_itself():
    assert all(BPE.merge(b) == [i] for b, i in BPE.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_texts_as_the_library(text):
    assert encoded(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab the\n", max_size=400), st.integers(0, 400))
def test_join_at_any_place(text, at):
    data = text.encode()
    at = min(at, len(data))
    assert BPE.join(BPE.merge(data[:at]) if at else [], BPE.merge(data[at:]) if at < len(data) else []) == (BPE.merge(data) if data else [])


def test_pieces_of_documents_go_up_the_tree(spark, sf_dir):
    """Every piece that is no token itself is joined from its halves."""
    bpe_ = bpe.ByteBPE.from_tiktoken(CONTENT)
    cache, pieces = bpe.PieceCache(bpe_), set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = r.text or ""
        ids = np.frombuffer(bpe.encode_text(text, PATTERN, cache), "<u4")
        assert ids.tolist() == LIBRARY.encode_ordinary(text) and bpe_.decode(ids) == text.encode()
        pieces.update(p.encode() for p in PATTERN.findall(text))
    assert bpe_.joins >= sum(p not in bpe_.ranks for p in pieces) > 1000


def test_decoding_of_any_number_of_tokens():
    ids = [i % 50_000 for i in range(0, 700_000, 7)]
    for n in (0, 1, 2, 3, 7, 64, 65, len(ids)):
        assert BPE.decode(ids[:n]) == b"".join(BPE.bytes_of[i] for i in ids[:n])


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3001, "%#" * 2000, "\n" * 999, "é" * 1500, "abcabcab" * 700, "人" * 800, "\x00‍" * 500])
def test_long_pieces_go_up_the_tree(text):
    assert encoded(text) == LIBRARY.encode_ordinary(text)


def test_all_code_points_are_split_as_by_the_library():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 40_000):
        text = "".join(f"x{c}1{c} {c}." for c in points[at : at + 40_000 : 7])
        assert encoded(text) == LIBRARY.encode_ordinary(text)


def test_chunks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 10)
    text = "One two three, four. " * 40
    assert encoded(text) == LIBRARY.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (None, "ab" * 9000, "x"), (3, None, "x"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(bpe.encode_documents(df, CONTENT, P.PATTERN, with_ids=True).collect(), key=repr)
    assert len(found) == 5
    want = sorted((d, len(i := LIBRARY.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in [(x[0] or -1, x[1], 0) for x in rows])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in found)
    assert bpe.encode_documents(df.limit(0), CONTENT, P.PATTERN).count() == 0
