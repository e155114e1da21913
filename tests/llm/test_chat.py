import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import chat

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<", "[", "\\", "/", "s>", "INST]", " ", "\n", "é", "x"]


def plain(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    return sorted((tuple(r)[:5] for r in chat.read_back(chat.examples(df)).collect()), key=repr)


def test_round_trip(spark):
    rows = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "a"), (1, 2, "assistant", "[INST] b [/INST]</s>"), (1, 3, "user", "c"), (1, 4, "assistant", "é<s>"), (1, 5, "user", "tail")]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", ""), (3, 1, "assistant", "second"), (None, 2, "assistant", "null id"), (None, None, "user", "no turn")]
    rows += [(4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (4, 1, "ass[INST] istant", "role\nline"), (5, 0, "user", "only"), (6, 0, "assistant", "long " * 100_000)]
    assert found(spark, rows) == plain(rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>", "a\\"]), st.lists(st.sampled_from(CONTROL), max_size=12).map("".join)), min_size=1, max_size=40))
def test_any_control_strings(spark, turns):
    rows = [(i // 7, i, r, t) for i, (r, t) in enumerate(turns)]
    assert found(spark, rows) == plain(rows)


def test_examples(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.example): r for r in chat.examples(df).collect()}
    assert sorted(got) == [(1, 2), (1, 4), (2, 1)]
    assert got[1, 2].formatted == "<s>user[INST] q1 [/INST]</s><s>assistant[INST] a1 [/INST]</s>"
    for key, reply in (((1, 2), "a1"), ((1, 4), "a2"), ((2, 1), "")):
        r = got[key]
        assert r.formatted[r.mask_start : r.mask_start + r.mask_chars] == reply
    assert chat.examples(df.limit(0)).count() == 0


def test_no_control_string_is_left_inside(spark):
    df = spark.createDataFrame([("<s></s>[INST][/INST]<\\s>[\\\\/INST]",)], "t string")
    r = df.select(chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).first()
    assert not any(c in r.e for c in CONTROL[:4]) and r.u == df.first().t
