import random
import re
from itertools import combinations

import xxhash

from vellum.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(marks)):
        groups.setdefault(find(i), []).append(i)
    return {frozenset(g) for g in groups.values()}


def test_masks_cover_all_close_pairs():
    masks = simhash.block_masks()
    assert len(masks) == 20
    for flips in combinations(range(0, 64), 3):
        x = sum(1 << b for b in flips)
        assert any(x & m == 0 for m in masks)


def test_masks_of_open_bits_cover_all_close_pairs():
    for m in simhash.block_masks():
        inner = simhash.block_masks((1 << 64) - 1 & ~m)
        assert len(inner) == 20 and all(n & m == 0 for n in inner)
        assert max(64 - (m | n).bit_count() for n in inner) <= 18
        open_bits = [b for b in range(64) if not m >> b & 1]
        for flips in combinations(open_bits, 3):
            x = sum(1 << b for b in flips)
            assert any(x & n == 0 for n in inner)


def test_fingerprints(spark):
    random.seed(1)
    texts = [None, "", " \t\n", "One", "one two", "A b C d e f", "É à Ü straße İ"] + [" ".join(random.choices("abcdefgh", k=random.randint(1, 60))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def _check(spark, ids, texts):
    df = spark.createDataFrame(list(zip(ids, texts, ids)), "doc_id long, text string, fp long")
    found = simhash.near_duplicates(df).collect()
    marks = [plain_fingerprint(t) for t in texts]
    want = []
    for group in plain_components(marks):
        known = [ids[i] for i in group if ids[i] is not None]
        want += [(ids[i], f"{marks[i]:016x}", min(known) if known else None) for i in group]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_groups_of_near_copies(spark):
    random.seed(2)
    base = " ".join(random.choices([f"w{i}" for i in range(400)], k=900)).split()
    texts, ids = [], []
    for i in range(120):
        words = list(base)
        for _ in range(i % 4):
            words[random.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
        ids.append(i)
    texts += ["one two three"] * 3 + [None, "", "  "] + [" ".join(random.choices("abcdefghijkl", k=50)) for _ in range(40)]
    ids += [500, 500, 700, 701, None, 702] + list(range(1000, 1040))
    _check(spark, ids, texts)


def test_a_hot_fingerprint_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    texts = ["one text that many rows hold"] * 40 + ["another one of these texts"] * 3 + ["long word " * 200_000, None]
    _check(spark, list(range(100, 100 + len(texts))), texts)


def test_all_null_ids_and_empty(spark):
    _check(spark, [None, None], ["a b c d", "a b c d"])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _links(spark, marks):
    df = spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long")
    nodes = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for i, m in enumerate(marks):
        groups.setdefault(nodes.get(simhash.signed(m), simhash.signed(m)), []).append(i)
    return {frozenset(g) for g in groups.values()}


def test_full_buckets_are_split_by_their_other_bits(spark, monkeypatch):
    random.seed(3)
    centres = [random.getrandbits(64) for _ in range(6)]
    marks = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for b in random.sample(range(64), random.randint(1, 6)):
                x ^= 1 << b
            marks.add(x)
    marks = sorted(marks)
    want = plain_components(marks)
    assert _links(spark, marks) == want
    monkeypatch.setattr(simhash, "BUCKET", 3)
    assert _links(spark, marks) == want


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_keep_one(spark):
    rows = [(3, "a b c d e", "en"), (1, "a b c d e", "fr"), (1, "a b c d e", "fr"), (9, "q r s t u v", None), (None, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id, r.lang) for r in kept if r.doc_id) == [(1, "fr"), (9, None)]
    assert [r.lang for r in kept if r.doc_id is None] == ["x"]
    assert len(kept) == 3 and df.columns == simhash.keep_one(df).columns


def test_keep_one_of_unrelated_texts_under_one_id(spark):
    random.seed(4)
    texts = [" ".join(random.choices("abcdefghijklmnop", k=40)) for _ in range(7)]
    a, b, c, d, e, f, g = texts
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (9, e), (7, f), (7, f), (3, g), (None, g)]
    assert len(plain_components([plain_fingerprint(t) for t in texts])) == 7
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, a), (None, b), (None, c), (7, d), (7, e), (7, f), (3, g)], key=repr)


def test_components_step_only_while_links_are_no_stars(spark, monkeypatch):
    steps, stash = [], simhash.stash
    monkeypatch.setattr(simhash, "stash", lambda df, label: steps.append(label) or stash(df, label))
    random.seed(4)
    graphs = [[], [(1, i) for i in range(2, 9)] + [(20, 30)], [(i, i + 1) for i in range(12)], [(2, 9), (3, 9), (3, 4)], [(random.randrange(60), random.randrange(60)) for _ in range(45)]]
    for links in graphs:
        steps.clear()
        root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
        for _ in root:
            for a, b in links:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        found = [tuple(r) for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()]
        assert sorted(found) == sorted(root.items())
        assert (steps == ["links"]) == (links in graphs[:2])
