import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from vellum.llm import nearcopies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Places of the rows that stay, by brute force over all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups.values()


def check(found, rows):
    """One row of each group stays, of its least id."""
    where = {}
    groups = plain_kept(rows)
    for g, group in enumerate(groups):
        for i in group:
            where[rows[i]] = (g, min((rows[j][0] is None, rows[j][0] or 0) for j in group))
    assert len(found) == len(groups) and len({where[r][0] for r in found}) == len(found)
    assert all((r[0] is None, r[0] or 0) == where[r][1] for r in found)


def edited(words, n):
    words = list(words)
    for i in random.sample(range(len(words)), n):
        words[i] = f"x{random.random()}"
    return " ".join(words)


def made():
    random.seed(6)
    common, rows = [f"c{i}" for i in range(30)], []
    for g in range(12):
        base = [f"w{random.randrange(5000)}" for _ in range(random.randrange(40, 400))]
        rows += [(random.randrange(10**6), edited(base, random.randrange(1 + len(base) // 30))) for _ in range(8)]
    rows += [(i, " ".join(random.sample([f"v{j}" for j in range(5000)], 20) + common)) for i in range(60)]
    rows += [(None, ""), (None, None), (3, "one"), (4, "One"), (None, "q w e r"), (None, "q w e r t"), (5, " ".join(common)), (5, rows[0][1]), (5, rows[0][1])]
    return rows


def test_near_duplicate_stage_against_brute_force(spark, sf_dir):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check([tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()], rows)


def test_near_duplicate_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()]
    check(found, rows)
    assert not {145, 177} & {r[0] for r in found}  # similar to 6 and 1 by 0.83; over three bits apart


def test_meeting_across_batches(spark):
    random.seed(7)
    sets = {i: sorted(random.sample(range(40), 6)) for i in range(1, 900)} | {900: [77], 901: [78], 902: [78]}
    marks = spark.createDataFrame([(i, len(s), s) for i, s in sets.items()] + [(5, 6, sets[5]), (7, 6, None)], "fp long, size long, prefix array<long>")
    want = set()
    for s in range(100):
        have = [i for i in sets if s in sets[i]]
        want |= {(s, i, len(sets[i]), min(have), len(sets[min(have)])) for i in have if len(have) > 1}
    found = [tuple(r) for r in nearcopies.meeting(marks).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert np.array_equal(nearcopies.shingles("a b c d e f"), nearcopies.shingles("A b  c d\ne f"))


def test_parities_never_rule_out_similar_sets():
    random.seed(8)
    draw = np.random.default_rng(8)
    for n in [1, 2, 5, 9, 31, 64, 500, 3000]:
        for _ in range(20):
            a = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
            b = np.unique(np.concatenate([a[random.randrange(1 + n // 6) :], draw.integers(0, 1 << 63, random.randrange(1 + n // 4), np.uint64)]))
            seen = nearcopies.plausible(*(np.frombuffer(nearcopies.parities(x), np.uint8) for x in (a, b)), len(a) + len(b))
            assert seen or not nearcopies.similar(a, b)
    far = [draw.integers(0, 1 << 63, n, np.uint64) for n in (400, 500)]
    assert not nearcopies.plausible(*(np.frombuffer(nearcopies.parities(x), np.uint8) for x in far), 900)


def test_fingerprints_find_and_exact_sets_decide(spark, monkeypatch):
    """SimHash alone links near copies of few differing bits, and what it leaves the exact way finds."""
    random.seed(12)
    base = [f"w{i}" for i in range(400)]
    near = [(i, " ".join(base[:i] + ["x"] + base[i:])) for i in range(1, 400, 20)]
    rows = near + [(1000 + i, " ".join(f"u{random.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    narrow = docs.select("doc_id", "text")
    marks = nearcopies.stash(nearcopies.with_prefixes(narrow), "marks")
    prints = {r.fp: r["print"] & (1 << 64) - 1 for r in marks.collect()}
    for _, text in rows:
        found = nearcopies.shingles(text)
        bits = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in found) > len(found))
        assert prints[nearcopies.set_mark(found)] == bits
    pairs = nearcopies.fingerprint_pairs(marks)
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= nearcopies.NEAR for r in pairs.collect())
    linked = {x for r in nearcopies.verified(narrow, marks, pairs).collect() for x in (r.a, r.b)}
    near_marks = {nearcopies.set_mark(nearcopies.shingles(t)) for _, t in near}
    assert linked <= near_marks and len(linked) > len(near_marks) / 2
    check([tuple(r) for r in nearcopies.keep_one(docs).collect()], rows)
    used = []
    monkeypatch.setattr(nearcopies, "fingerprint_pairs", lambda marks: used.append(1) or pairs)
    corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert used


def test_merged_components_are_those_of_all_links(spark, monkeypatch):
    schema = "a long, b long"
    first, more = [(1, 2), (2, 3), (5, 6), (7, 8), (8, 9)], [(3, 6), (9, 11), (12, 13)]
    known = nearcopies.components(spark.createDataFrame(first, schema)).withColumnRenamed("node", "fp")
    found = {tuple(r) for r in nearcopies.merged(known, spark.createDataFrame(more, schema)).collect()}
    assert found == {tuple(r) for r in nearcopies.components(spark.createDataFrame(first + more, schema)).collect()}
    random.seed(9)
    rows, searches, components = made(), [], nearcopies.components
    monkeypatch.setattr(nearcopies, "components", lambda links: searches.append(links) or components(links))
    check([tuple(r) for r in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()], rows)
    assert len(searches) == 2  # at first, and after the one turn that finds links
