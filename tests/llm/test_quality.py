import random
from collections import Counter
from math import comb, exp, fsum, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def plain_counts(text):
    text = text or ""
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    random.seed(6)
    out = [None, "", " \t", "one", "a b c d e", "a b c d e f", "x x x x x x x", "a b c d e a b c d e", "é ü\x0b#*$%&|<>\r\nline\nline\n line\n\n\nline", "u v w x\u0085y"]
    for _ in range(150):
        words = random.choices("abcd", k=random.randint(0, 40)) if random.random() < 0.5 else [f"w{random.randint(0, 500)}" for _ in range(random.randint(0, 80))]
        out.append("".join(w + random.choice([" ", "  ", "\n", "\t"]) for w in words))
    return out


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts())], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.quality_rules(df, labels).collect():
        want = plain_counts(texts()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts()[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept != r.base_failed


def test_long_text(spark):
    text = "alpha beta gamma " * 30_000
    r = quality.quality_rules(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (90_000, 90_000, True)


@pytest.mark.parametrize("risk", [0.005, 0.05])
def test_binomial_tail(spark, risk):
    pairs = [(n, k) for n in (1, 5, 40, 300, 2000, 9000) for k in (0, 1, 2, 5, 9, 40) if k <= n]
    df = spark.createDataFrame(pairs, "n long, k long")
    for r in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), risk).alias("p")).collect():
        want = 1.0 if r.k > risk * r.n else fsum(exp(log(comb(r.n, i)) + i * log(risk) + (r.n - i) * log(1 - risk)) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9 * max(want, 1e-3)


def _corpus(spark, n, junk_good):
    """Clean texts of label 1 and, under label 0, texts of symbols; ``junk_good`` of the
    latter are labelled good."""
    clean = [(i, " ".join(f"w{(i * 31 + j) % 997}" for j in range(40)), "en", 1) for i in range(n)]
    junk = [(n + i, " ".join(f"w{(i * 17 + j) % 997}|" for j in range(40)), "en", int(i < junk_good)) for i in range(60)]
    few = [(10 * n + i, " ".join(f"v{i}{j}|" for j in range(30)), None, 0) for i in range(5)]
    rows = clean + junk + few
    return spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")


def test_cutoffs_reject_junk_with_enough_labels(spark, monkeypatch):
    for most in (10_000, -1):  # broadcast, then by shuffle
        monkeypatch.setattr(quality, "BROADCAST_STRATA", most)
        df, labels = _corpus(spark, 1600, 0)
        rows = quality.quality_rules(df, labels).collect()
        assert all(r.kept for r in rows if r.doc_id < 1600)
        assert not any(r.kept for r in rows if 1600 <= r.doc_id < 1660)
        assert all(r.kept for r in rows if r.doc_id >= 16_000)  # no labels there


def test_some_220_good_labels_let_the_rules_act(spark):
    for n, acts in ((140, False), (149, True)):  # one stratum: log(0.05) / log(0.98) is 148.3
        df, labels = _corpus(spark, n, 0)
        rows = quality.quality_rules(df, labels).collect()
        assert all(r.kept for r in rows if r.doc_id < n)
        assert any(r.kept for r in rows if n <= r.doc_id < n + 60) != acts


def plain_step(signals):
    """The last safe step for one stratum's good documents, of ``made`` strata."""

    def step(some, made):
        found = -1
        for i in range(quality.STEPS):
            k = sum(any(s[r] > cuts[i] for r, cuts in quality.LADDER.items()) for s in some)
            n = len(some)
            tail = sum(comb(n, j) * quality.RISK**j * (1 - quality.RISK) ** (n - j) for j in range(k + 1))
            if tail > quality.ERROR / made:
                break
            found = i
        return found

    return {lang: step(some, len(signals)) for lang, some in signals.items()}


def test_rules_that_act_against_brute_force(spark):
    """At a size where every language has an active step."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: (r.text, r.lang, plain_counts(r.text)) for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}

    def signal(text, counts):
        n, chars, symbols, dups, repeated = counts
        lines = sum(bool(x.strip(SPACE)) for x in (text or "").split("\n"))
        return {"symbols_per_word": symbols / n if n else 0, "dup_line_share": dups / lines if lines else 0, "repeat_share": repeated / n if n else 0, "mean_word_chars": chars / n if n else 0}

    failed = lambda c: c[0] < 10 or 100 * c[4] > 20 * c[0]
    held = {}
    for i in good & rows.keys():
        text, lang, counts = rows[i]
        if not failed(counts):
            held.setdefault(lang, []).append(signal(text, counts))
    steps = plain_step(held)
    assert len(steps) >= 4 and min(steps.values()) >= 1
    found = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).select("doc_id", "kept").collect()}
    for i, (text, lang, counts) in rows.items():
        at, s = steps.get(lang, -1), signal(text, counts)
        assert found[i] == (not failed(counts) and not (at >= 0 and any(s[r] > cuts[at] for r, cuts in quality.LADDER.items()))), i
    assert sum(not found[i] and not failed(rows[i][2]) for i in rows) > 100  # rules that reject


def test_guarantee_by_simulation():
    """However the signals of good documents are spread, the share of draws of labels after
    which more than RISK of them would be rejected stays under ERROR."""
    random_ = np.random.default_rng(5)
    levels = np.array([0.0, 0.012, 0.03, 0.07, 0.15, 0.3, 0.7, 2.0])
    for shares in ((0.97, 0.005, 0.005, 0.005, 0.005, 0.005, 0.0025, 0.0025), (0.979, 0.021, 0, 0, 0, 0, 0, 0), (0.978, 0, 0, 0.011, 0.011, 0, 0, 0)):
        bad = 0
        for _ in range(300):
            drawn = random_.choice(levels, 600, p=np.array(shares) / sum(shares))
            some = [{"symbols_per_word": s, "dup_line_share": 0, "repeat_share": 0, "mean_word_chars": 0} for s in drawn]
            at = plain_step({"x": some})["x"]
            lost = sum(p for v, p in zip(levels, shares) if at >= 0 and v > quality.LADDER["symbols_per_word"][at])
            bad += lost > quality.RISK
        assert bad <= 300 * quality.ERROR + 3 * (300 * quality.ERROR) ** 0.5


def test_too_few_labels_reject_nothing(spark):
    df, labels = _corpus(spark, 120, 0)
    assert all(r.kept for r in quality.quality_rules(df, labels).collect())


def test_false_rejections_keep_a_rule_idle(spark):
    df, labels = _corpus(spark, 1600, 40)
    assert all(r.kept for r in quality.quality_rules(df, labels).collect())


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f g h i j k", "en"), (1, "a b c d e f g h i j k", None), (1, "a b c d e f g h i j k", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert [r.kept for r in quality.quality_rules(df, labels).collect()] == [True] * 3
    assert quality.quality_rules(df.limit(0), labels).count() == 0
    assert quality.judge(df, labels).columns[:3] == df.columns
