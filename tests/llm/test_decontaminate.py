import hashlib
import random
import re

from vellum.llm import decontaminate as D


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for item, t in items:
            v = plain_words(t)
            n = min(10, len(v))
            for g in ([v[i : i + n] for i in range(len(v) - n + 1)] if v else []):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == g:
                        hit |= set(range(p, p + n))
                        names.add("null" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def fixture():
    random.seed(5)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Straße", "12"]
    items = [(i, " ".join(random.choices(vocab, k=random.choice([1, 2, 5, 9, 10, 11, 25])))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "--!!"), (3, items[3][1]), (None, "Null Item, here it is: some ten words of it!"), (10, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(80):
        words = random.choices(vocab, k=random.randint(0, 60))
        if i % 3 == 0:
            words[5:5] = (random.choice(items)[1] or "").upper().split()
        docs.append((i % 70, ", ".join(words)))
    docs += [(None, "null item here it is some ten words of it"), (200, None), (201, ""), (202, " ".join(["w1"] * 5000))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    docs, items = fixture()
    want = plain(docs, items)
    assert any(x[5] for x in want) and not all(x[5] for x in want)
    a, b = frames(spark, docs, items)
    assert found(D.find_items(a, b)) == want
    monkeypatch.setattr(D, "SLICE_WINDOWS", 7)
    assert found(D.find_items(a, b)) == want


def test_empty_tables(spark):
    docs, items = fixture()
    a, b = frames(spark, docs, items)
    assert D.find_items(a.limit(0), b).count() == 0
    assert not any(r.contaminated for r in D.find_items(a, b.limit(0)).collect())


def test_kept_columns(spark):
    docs, items = fixture()
    a, b = frames(spark, docs, items)
    df = D.find_items(a, b, keep=True)
    assert df.columns == ["doc_id", "text", "n_hit", "__hit"]
    assert df.filter("__hit").count() == sum(x[5] for x in plain(docs, items))


def test_spans_are_maximal_runs(spark):
    a, b = frames(spark, [(1, "x a b c y a b c a b c")], [(1, "a b c")])
    assert [tuple(s) for s in D.find_items(a, b).first().spans] == [(1, 4), (5, 11)]


def test_a_window_of_very_many_items_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_WINDOWS", 40)
    docs = spark.createDataFrame([(1, "x one shared window of seven words y"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(i, "one shared window of seven words") for i in range(300)], "item_id long, text string")
    r = {r.doc_id: r for r in D.find_items(docs, items).collect()}
    assert (r[1].n_items, r[1].n_hit, r[2].n_items) == (300, 6, 0) and list(r[1]["items"]) == sorted(map(str, range(300)))
