import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import langid

from .test_bpe import LIBRARY
from .test_decontaminate import plain_words
from .test_langid import PlainCodes, plain_features
from .test_nearcopies import plain_kept
from .test_quality import plain_counts


def plain_pipeline(docs, items):
    """(doc_id, text, lang) rows through the five stages, one by one."""
    kept = []
    for d in docs:
        n, _, _, _, repeated = plain_counts(d[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            kept.append(d)
    teach = [d[1:3] for d in kept if zlib.crc32(str(d[0]).encode()) % 4 != 2 and d[1] is not None and d[2] is not None]
    codes = PlainCodes(teach)
    clear = [d for d in kept if plain_features(d[1]) is not None and codes.predict(d[1])[2] >= langid.GAP]
    first = [clear[min(group, key=lambda i: clear[i][0])] for group in plain_kept([d[:2] for d in clear])]
    windows = set()
    for _, text in items:
        w = plain_words(text)
        windows |= {f" {' '.join(w[i : i + 10])} " for i in range(max(1, len(w) - 9))} if w else set()
    hits = {d[0] for d in first if any(g in f" {' '.join(plain_words(d[1]))} " for g in windows)}
    return sorted((d[0], hashlib.sha256(np.array(LIBRARY.encode_ordinary(d[1]), "<u4").tobytes()).hexdigest()) for d in first if d[0] not in hits)


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in source.collect()]
    more = [(900, None, "en", "s", 0), (901, "12 34 " * 20 + "!", "en", "s", 1), (902, "few words", "en", "s", 2), (903, "12 34 56 78 90 1 2 3 4 5 6 7", None, "s", 3), (904, rows[1][1], "en", "s", 4), (905, rows[2][1] + " more", None, None, 5)]
    docs = spark.createDataFrame(rows + more, source.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline([r[:3] for r in rows + more], items)
    assert sorted((r.doc_id, r.ids_sha256) for r in found) == want
    assert 100 < len(found) < len(rows)


def test_each_stage_keeps_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).withColumn("n_words", corpus_pipeline.F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_columns_of_any_name_ride_along(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for name in ("__kept", "__n_words", "__fp", "__spans", "__items", "__lang", "__at", "root", "a.b", "quality", "item_id"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        assert all(r["__kept"] == "__kept" and r["a.b"] == "a.b" for r in found.collect())


def test_stages_on_odd_rows(spark, sf_dir):
    text = "some plain words of one text that are long enough to pass the rules of the first stage"
    rows = [(None, None, None, None, None, None), (None, text, None, None, None, "x"), (1, text, "en", "s", 5, None), (1, text, "en", "s", 5, None), (2, "", "en", "s", 0, "y"), (3, "word " * 200_000, "en", "s", 9, "z"), (4, " \n\t ", None, "s", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        ids = [r.doc_id for r in found.collect()]
        assert set(ids) <= {None, 1, 2, 3, 4}
        if name == "quality_rules":
            assert sorted(ids, key=str) == [1, 1, None]
        if name == "simhash_near_dedup":
            assert ids.count(1) == 1 and len(ids) == 3
        if name in ("benchmark_decontamination", "byte_bpe"):
            assert len(ids) == len(rows)


def test_language_stage_without_labels_keeps_lettered_texts(spark, sf_dir):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "\u044f", None), (None, "x", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_stage(spark, docs, sf_dir).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
