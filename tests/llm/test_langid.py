import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import langid


def plain_features(text):
    """n-gram counts one by one, in Python integers."""
    marks = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    if not marks.strip():
        return None
    while "  " in marks:
        marks = marks.replace("  ", " ")
    codes = [0 if c == " " else ord(c) for c in marks]
    counts = [0] * langid.DIMENSIONS
    for order in range(langid.ORDERS):
        for at in range(len(codes) - order):
            gram = 0
            for c in codes[at : at + order + 1]:
                gram = gram * 0x110001 + c
            counts[((gram + order) * 0x9E3779B97F4A7C15 % 2**64) >> 53] += 1
    return np.sqrt(np.array(counts) / sum(counts))


class PlainCodes:
    """The same classifiers and decoding, language by language in double precision."""

    def __init__(self, rows):
        """rows: (text, lang)."""
        some = [(v, lang) for text, lang in rows if (v := plain_features(text)) is not None]
        self.names = sorted({lang for _, lang in rows})
        self.words = langid.codewords(len(self.names))
        x = np.array([[*v, 1.0] for v, _ in some])
        y = np.array([self.words[self.names.index(lang)] for _, lang in some], float)
        of = {n: [i for i, (_, lang) in enumerate(some) if lang == n] for n in self.names}
        w = np.array([1 / len(of[lang]) for _, lang in some])
        self.planes = np.linalg.solve(x.T @ np.diag(w) @ x + np.eye(x.shape[1]) * langid.RIDGE * len(self.names) * 1e-2, x.T @ np.diag(w) @ y)
        right = np.sign(x @ self.planes) == y
        self.trust = {n: right[of[n]].mean(0) + 1e-9 for n in self.names}

    def losses(self, text):
        margin = np.array([*plain_features(text), 1.0]) @ self.planes
        return [float((self.trust[n] / self.trust[n].sum() * np.exp(-margin * word)).sum()) for n, word in zip(self.names, self.words)]

    def predict(self, text):
        """(language, score, gap)."""
        odds = np.exp(-langid.SHARPNESS * np.array(self.losses(text)))
        odds /= odds.sum()
        order = np.argsort(-odds)
        return self.names[order[0]], odds[order[0]], odds[order[0]] - (odds[order[1]] if len(order) > 1 else 0)


TEXTS = ["", "a", "!", "ab  cd", "The  cat's 2 hats", "Straße über\n\tÄcker", "日本語 text", " x ", "I\u0307stanbul"]


def test_features_by_definition(monkeypatch):
    for chunk in (1, 2, 3, 5, 1 << 20):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for text in (None, *TEXTS, " ".join(TEXTS) * 3):
            want, found = plain_features(text), langid.features(text)
            assert (want is None) == (found is None)
            assert want is None or np.allclose(want, found, atol=1e-6)


def test_predictions_against_plain_decoding(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
    teach = [r[1:] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    plain = PlainCodes(teach)
    want = {r[0]: plain.predict(r[1]) for r in rows if plain_features(r[1]) is not None}
    found = {r.doc_id: r for r in langid.identify(df).collect()}
    same = [found[i].lang_pred == lang and abs(found[i].score - score) < 0.02 for i, (lang, score, gap) in want.items() if gap > 0.02]
    assert len(same) > 150 and all(same)
    assert all(found[i].ambiguous == (gap < langid.GAP) for i, (_, _, gap) in want.items() if abs(gap - langid.GAP) > 0.02)


def test_null_and_repeated_ids_teach_like_others(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 40)
    alphabets = {"xa": "abcd", "xb": "efgh", "xc": "ijkl"}
    text = lambda i, letters: " ".join("".join(np.random.default_rng(i).choice(list(letters), 5)) for _ in range(9))
    rows = [(None, text(i, letters), lang) for i in range(400) for lang, letters in alphabets.items()]
    rows += [(None, "abab dcdc", "xa")] * 500  # copies of one text
    for doc_id in (None, next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)):
        df = spark.createDataFrame([(doc_id, *r[1:]) for r in rows], "doc_id long, text string, lang string")
        found = langid.identify(df).groupBy("lang_pred").count().collect()
        assert {r.lang_pred: r["count"] for r in found} == {"xa": 900, "xb": 400, "xc": 400}

def test_codewords_correct_errors():
    for n in (2, 3, 4, 5, 6, 20, 60):
        words = langid.codewords(n)
        assert len(words) == n
        least = min((words[i] != words[j]).sum() for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2 if n == 3 else 4)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (None, "the dog", "en"), (4, "123 !!", "en"), (5, "", None), (1, "the cat", None), (6, "und", None), (7, "x" * 3_000_000, None)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double")
    found = langid.identify(df).collect()
    assert len(found) == len(rows)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {3, 4, 5} and all(r.score == 0 for r in found if r.lang_pred == "und")
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_one_language(spark):
    df = spark.createDataFrame([(i, "hello there", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("en", 1.0)}


def test_many_languages(spark):
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzäö"]
    rows = [(i, " ".join(np.random.default_rng(i).choice(list(alphabets[i % 7]), 30)), f"l{i % 7}") for i in range(280)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 7}" for r in found if r.held_out]) > 0.95


def test_more_than_256_languages_are_all_learned(spark):
    n = 300
    word = lambda i: "".join(chr(0x4E00 + 7 * i + k) for k in range(4))
    rows = [(r * n + i, " ".join([word(i)] * 6), f"l{i:03}") for i in range(n) for r in range(8)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {r[0]: r[2] for r in rows}
    assert {r.lang_pred for r in found} == set(want.values())
    assert sum(r.lang_pred == want[r.doc_id] for r in found) > 0.95 * len(rows)


def test_fit_takes_little_of_the_driver_and_any_order_of_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    tracemalloc.start()
    codes = langid.fit(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    again = langid.fit(df.orderBy(F.desc("doc_id")).repartition(3))
    assert np.array_equal(codes.planes, again.planes) and np.array_equal(codes.trust, again.trust)
    letterless = langid.fit(spark.createDataFrame([(1, "12", "en"), (2, "!", "de")], "doc_id long, text string, lang string"))
    assert letterless.names == ["de", "en"]
