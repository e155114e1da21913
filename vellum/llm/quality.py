"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose signal lies above a cutoff. The cutoffs of all rules are
chosen together, as a step of a ladder that grows stricter for every rule. For each
stratum (language) a labelled holdout says how many good documents (label 1) a step would
reject; the step is safe if by the exact binomial bound that share is under RISK. Steps
are tested from the most lenient on and the last safe one before the first unsafe is
taken; such a fixed order needs no correction inside a stratum, and ERROR is shared out
over the strata (Bonferroni). So with probability 1 - ERROR no stratum loses more than
RISK of its good documents to the rules. Where labels are too few to show that (under
log(ERROR / strata) / log(1 - RISK) good ones, 217 for four languages), the rules stay
idle and only the base rules reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, stash

RISK, ERROR = 0.02, 0.05
#: Rule -> its cutoff at each step of the ladder, from lenient to strict.
LADDER: dict[str, list[float]] = {
    "symbols_per_word": [1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01],
    "dup_line_share": [0.5, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeat_share": [0.2, 0.2, 0.18, 0.15, 0.1, 0.05, 0.02],
    "mean_word_chars": [15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5],
}
STEPS = 7
#: Deviations below the k-th term of a binomial sum beyond which terms are nil.
DEVIATIONS = 12
#: The contract's own rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SPAN = 10, 20, 5
#: Strata up to which the table of cutoffs is broadcast (some 100 bytes each).
BROADCAST_STRATA = 10_000

SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(value: Column) -> Column:
    """The same value, marked so that the optimizer neither copies its expression into each
    place that uses it nor moves it below a filter on it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _repeated(words: Column, n: Column) -> Column:
    """Words inside five-word windows that occur twice or more, exactly: windows are
    sorted with their places, equal neighbours found, and the places' cover added up."""
    steps = F.sequence(F.lit(0), n - SPAN)
    grams = F.sort_array(F.transform(steps, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, SPAN)).alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda j, d: F.coalesce(F.get(s, j)["g"] == F.when(j + d >= 0, F.get(s, j + d)["g"]), F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, 1) | same(j, -1))
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def cover(p: Column) -> Column:
        gap = lambda j: F.least(F.lit(SPAN), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(SPAN)))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda a, j: a + gap(j)))

    return _let(_let(grams, places), cover)


def with_signals(df: DataFrame, text_col: str = "text", prefix: str = "__") -> DataFrame:
    """All columns, and the five counts and the number of lines under ``prefix``.

    Windows are first compared by 64-bit hashes, which can only find too many equal; a
    text with equal ones is then counted exactly."""
    p, keep = prefix, df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(f"{p}words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    df = df.withColumn(f"{p}hashes", F.transform(f"{p}words", lambda w: F.xxhash64(w)))
    h, n = F.col(f"{p}hashes"), F.size(f"{p}words")
    windows = F.when(n > SPAN, F.transform(F.sequence(F.lit(0), n - SPAN), lambda i: F.xxhash64(*(F.get(h, i + d) for d in range(SPAN)))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    df = df.select(*keep, f"{p}words", windows.alias(f"{p}windows"), lines.alias(f"{p}line_list"))
    distinct = F.coalesce(F.size(F.array_distinct(f"{p}windows")) == F.size(f"{p}windows"), F.lit(True))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size(f"{p}line_list") - F.size(F.array_distinct(f"{p}line_list")),
        "n_repeat_words": F.when(distinct, F.lit(0)).otherwise(_repeated(F.col(f"{p}words"), n)),
        "n_lines": F.size(f"{p}line_list"),
    }
    return df.select(*keep, *(_once(c.cast("long")).alias(f"{p}{name}") for name, c in counts.items()))


def base_failed(p: str = "__") -> Column:
    return (F.col(f"{p}n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{p}n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col(f"{p}n_words"))


def signal(rule: str, p: str = "__") -> Column:
    part, whole = {"symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "mean_word_chars": ("word_chars", "n_words")}[rule]
    return F.coalesce(F.col(f"{p}{part}") / F.nullif(F.col(f"{p}{whole}"), F.lit(0)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series at x + 8, and down from there."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + F.lit(1 / 12) / z - F.lit(1 / 360) / (z * z * z) + F.lit(1 / 1260) / F.pow(z, F.lit(5)) - F.lit(1 / 1680) / F.pow(z, F.lit(7))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X ~ Bin(n, risk); 1 where k > risk * n, which is never small. The
    largest term comes from logarithms, the others from their ratios to it, down to where
    they are nil: their number grows with the root of n."""
    n, k = n.cast("double"), k.cast("long")
    log_choose = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    top = log_choose + k * F.log(F.lit(risk)) + (n - k) * F.log(F.lit(1 - risk))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        i = k - j
        return _let(a["t"] * i * (1 - risk) / ((n - i + 1) * risk), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s")))

    terms = F.least(k, F.ceil(DEVIATIONS * F.sqrt(n * risk)) + 50)
    ratios = F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), terms - 1), start, add, lambda a: a["s"]))
    return F.when(k > F.lit(risk) * n, F.lit(1.0)).otherwise(F.exp(top) * ratios)


def cutoffs(signals: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, p: str = "__") -> DataFrame:
    """One row for each stratum with a safe step: __stratum and a cutoff by rule. Label
    rows of one id count once, as good if any says so."""
    good = labels.groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("quality").alias("__quality")).filter("__quality = 1")
    rows = signals.filter(~base_failed(p)).select(F.col(id_col).alias("__label_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0")).alias("__stratum"), *(signal(r, p).alias(r) for r in LADDER))
    rejected = [F.greatest(*((F.col(r) > some[i]).cast("int") for r, some in LADDER.items())) for i in range(STEPS)]
    counts = rows.join(good, "__label_id").groupBy("__stratum").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"k{i}") for i, x in enumerate(rejected)))
    counts = stash(counts, "rejection_counts")
    error = ERROR / max(1, counts.count())
    step, safe = F.lit(-1), F.lit(True)
    for i in range(STEPS):
        safe = safe & (binomial_tail(F.col("n"), F.col(f"k{i}"), RISK) <= error)
        step = F.when(safe, i).otherwise(step)
    steps = stash(counts.select("__stratum", step.alias("step")), "steps").filter("step >= 0")
    at = lambda some: F.get(F.array(*map(F.lit, some)), F.col("step"))
    return steps.select("__stratum", *(at(some).alias(f"__cut_{r}") for r, some in LADDER.items()))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all of ``df`` by default) with ``__n_words``,
    ``__word_chars``, ``__n_symbols``, ``__n_dup_lines``, ``__n_repeat_words``,
    ``__base_failed`` and ``__kept``; one row per input row.

    labels: doc_id and quality (1: good). A null or empty text has no words and so fails
    the base rules. A null stratum is a stratum of its own. Ids may be null (never
    labelled) or repeat (each row is judged; each counts if labelled). Without labels, or
    with too few, only the base rules reject. An empty table gives an empty one. The
    table of cutoffs has a row per stratum; over BROADCAST_STRATA it is joined by a
    shuffle instead of a broadcast.

    Signals are computed once and written, with what is carried, to the shared folder: a
    copy of the texts costs far less than their signals."""
    carry, df = df.columns if carry is None else carry, spread(df)
    few = list(dict.fromkeys([*carry, id_col, stratum_col]))
    counts = [f"__{c}" for c in (*COUNTS, "n_lines")]
    signals = stash(with_signals(df.select(*dict.fromkeys([*few, text_col])), text_col).select(*few, *counts), "signals")
    cuts = cutoffs(signals, labels, id_col, stratum_col)
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    rows = signals.withColumn("__stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0"))).join(cuts, "__stratum", "left")
    over = F.lit(False)
    for r in LADDER:
        over = over | F.coalesce(signal(r) > F.col(f"__cut_{r}"), F.lit(False))
    return rows.select(*carry, *(f"__{c}" for c in COUNTS), base_failed().alias("__base_failed"), (~base_failed() & ~over).alias("__kept"))


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``judge`` with doc_id, the five counts, base_failed and kept under these names."""
    rows = judge(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang")), labels, carry=["doc_id"])
    return rows.select("doc_id", *(F.col(f"__{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")))
