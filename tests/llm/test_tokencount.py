import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import tokencount
from vellum.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
LENGTHS = tokencount.Lengths(MODEL, {})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=120), st.text(" \n▁ab.é人\t<s>/", max_size=80)))
def test_counts_as_the_library(text):
    assert sum(map(LENGTHS.__getitem__, tokencount.pre_tokens(text))) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "\n", "\n ", " \n", "▁", "▁▁ a▁b", "<s></s><unk>", "\x00", "\r\n", "a　b", "ﬁ①", " " * 5000, "a" * 5000, "é " * 3000])
def test_special_texts(text):
    assert sum(map(LENGTHS.__getitem__, tokencount.pre_tokens(text))) == len(LIBRARY.encode(text))


def test_documents(spark, monkeypatch):
    texts = ["Hello  world\n", None, "", "word " * 5000, "Hello  world\n", "çé ▁x"]
    df = spark.createDataFrame([(i % 4 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    want = sorted(((i % 4 or 0), len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in enumerate(texts))
    for entries, counters, cache in ((1 << 16, 1 << 18, 1 << 19), (2, 3, 4), (0, 3, 1)):
        monkeypatch.setattr(tokencount, "TABLE_ENTRIES", entries)
        monkeypatch.setattr(tokencount, "TASK_COUNTERS", counters)
        monkeypatch.setattr(tokencount, "CACHE_ENTRIES", cache)
        rows = tokencount.count_tokens(df, MODEL).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and any(r.over_limit for r in rows)
    assert tokencount.count_tokens(df.limit(0), MODEL).count() == 0


def test_summaries_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "FAN", 2)
    df = spark.createDataFrame([(i, "common words here " * 20 + f"rare{i}") for i in range(60)], "doc_id long, text string").repartition(9)
    found = tokencount.frequent(df, MODEL)
    assert {" common", " words", " here"} <= set(found) and len(found) == 63
    assert all(n == len(LIBRARY.encode("\n" + p)) - len(LIBRARY.encode("\n")) for p, n in found.items())
    monkeypatch.setattr(tokencount, "TABLE_ENTRIES", 3)
    assert set(tokencount.frequent(df, MODEL)) == {" common", " words", " here"}
