"""Ids that are large, null or repeated, and components that are very large."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.llm import ann, cws, langid, mixing, mixing_sql, suffixdedup, warc
from tests.conftest import rows_of
from tests.llm.test_llm import documents

PAGES = "page_id long, url string, html string"


def test_archives_keep_ids_of_64_bits(spark):
    top = 2**63 - 1
    rows = [(top - k, "u", "same") for k in range(3)] + [(2**60 + 1, "u", "pair"), (2**60 + 3, "u", "pair"), (None, "u", "same"), (None, "u", None), (-(2**63), "u", "low"), (5, None, "pair")]
    got = {(r.page_id, r.payload_bytes): r.refers_to for r in warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert got == {(top, 4): None, (top - 1, 4): top, (top - 2, 4): top, (2**60 + 1, 4): 2**60 + 3, (2**60 + 3, 4): None, (None, 4): top, (None, 0): None, (-(2**63), 3): None, (5, 4): 2**60 + 3}


def test_neighbours_of_very_large_vectors(spark):
    rows = [(20, [1.0, 2.0]), (21, [1e200, 0.0]), (22, [3.0, 3.0]), (23, [-1e200, 1e200]), (40, [1e200, 1e180]), (60, [1e-200, 0.0])]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    told = {q: [r.vec_id for r in got if r.query_id == q] for q in (20, 40, 60)}
    assert told[20] == [21, 23, 40, 22, 60]  # the first three score alike in doubles
    assert sorted(told[40]) == [20, 21, 22, 23, 60] and told[40][0] == 21 and told[40][-1] == 23
    assert {r.vec_id: r.score for r in got if r.query_id == 20}[22] == 9.0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8)) * 10.0 ** rng.integers(120, 153, (3000, 1))
    found = ann.Search(ann.build_tree(np.arange(3000), x), np.arange(0, 3000, 100), x[::100], 5, 1.0)
    with np.errstate(over="ignore"):
        scores = np.array([ann.inner(np.repeat(x[q][None], 3000, axis=0), x) for q in range(0, 3000, 100)])
    scores[np.arange(30), np.arange(0, 3000, 100)] = -np.inf
    assert (np.sort(-scores, axis=1)[:, :5] == -found.best_score).all()


def test_language_sample_is_bounded(spark):
    rows = [(f"text number {k} of one and the same id", 9) for k in range(4000)] + [("one text", 11)] * 4000
    docs = documents(spark, [t for t, _ in rows], [i for _, i in rows], langs=["en" if k % 2 else "fr" for k in range(8000)])
    seen = []
    old = langid.ByteNet.train
    langid.ByteNet.train = lambda self, windows, labels: seen.append(np.bincount(labels)) or self
    try:
        langid.fit(docs)
    finally:
        langid.ByteNet.train = old
    assert (seen[0] <= langid.TRAIN_DOCS * langid.TRAIN_WINDOWS).all() and seen[0].sum() > 100


def test_rows_of_one_id_are_spread(spark):
    texts = [f"text {k} " * (k % 5) for k in range(2000)]
    docs = documents(spark, texts, [None if k % 2 else 7 if k % 4 == 0 else k for k in range(2000)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = cws.fingerprints(docs)
        sizes = got.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert got.count() == 2000 and sizes[sizes > 50].max() < 900
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_mixture_with_repeated_and_null_ids_by_sql(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 40))) for _ in range(900)] + [None, "", "same text"] * 10
    ids = [None if k % 3 == 0 else 5 if k % 3 == 1 else k for k in range(930)]
    docs = documents(spark, texts, ids, [None if k % 7 == 0 else f"s{k % 5}" for k in range(930)])
    got = mixing.mix_summary(docs).toPandas()
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    assert rows_of(got.astype({"doc_id": "Int64"})) == rows_of(c.execute(mixing_sql.MIX).df().astype({"doc_id": "Int64"}))
    pieces = mixing.mixed_documents(docs)
    assert pieces.agg(F.sum(mixing.words_of(F.col("text")))).first()[0] == int(got.taken.sum())


@pytest.mark.parametrize("repeated", [True, False])
def test_passages_of_texts_that_share_an_id(spark, repeated):
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    shared = [fresh(60) for _ in range(40)]
    texts = [fresh(10) + " " + shared[k % 40] + " " + fresh(200) for k in range(160)]
    ids = [k // 40 if repeated else k for k in range(160)]
    docs = documents(spark, [*texts, texts[5], None], [*ids, ids[5], 0])
    cores = suffixdedup.shared_cores(docs).collect()
    assert max(len(r["keys"]) for r in cores) < 12
    got = suffixdedup.without_repeats(docs).collect()
    # every passage stays where its first id has it; texts of one id are no matches of each other
    cut = [r for r in got if r.removed_words]
    assert len(cut) == 120 and all(r.removed_words == 60 and r.kept_in for r in cut)
    assert len(got) == 162 and all(r.doc_id >= (1 if repeated else 40) for r in cut)
    assert pd.Series([r.text for r in got if r.doc_id == 0 and r.text]).str.split().str.len().min() >= 200
