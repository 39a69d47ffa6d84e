"""The corpus pipeline: every stage against brute force on what the stage before it kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import mixing
from meterlake.llm.common import materialize
from tests.conftest import DATA
from tests.llm.test_llm import brute_components, brute_repeats, encode


def test_stages(spark):
    inputs = {}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = materialize(stage(spark, docs, DATA), name)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "passage_dedup", "mix_sources", "pack_sequences"]

    before = inputs["language_id"].toPandas()
    kept = set(r.doc_id for r in inputs["near_dedup"].select("doc_id").collect())
    assert kept <= set(before.doc_id) and len(kept) >= 0.98 * len(before)

    rows = sorted((r.doc_id, r.text) for r in inputs["near_dedup"].collect())
    _, low = brute_components([t for _, t in rows], 5, 80)
    assert sorted(r.doc_id for r in inputs["passage_dedup"].collect()) == [i for k, (i, _) in enumerate(rows) if low[k] == k]

    rows = [(r.doc_id, r.text) for r in inputs["passage_dedup"].collect()]
    gone = brute_repeats(rows)
    after = {r.doc_id: r for r in inputs["mix_sources"].collect()}
    assert after.keys() == gone.keys()
    for i, text in rows:
        assert after[i].text.encode().split() == [w for p, w in enumerate(text.encode().split()) if p not in gone[i]]
        assert gone[i] or after[i].text == text
        assert after[i].n_chars == len(after[i].text)

    goals = {r.doc_id: r for r in mixing.mix_summary(inputs["mix_sources"]).collect()}
    mixed = inputs["pack_sequences"].withColumn("words", mixing.words_of(F.col("text"))).toPandas()
    assert mixed.groupby("doc_id").words.sum().to_dict() == {i: r.taken for i, r in goals.items() if r.taken}
    for source, total in mixed.groupby("source").words.sum().items():
        target = next(goals[i].target for i, r in after.items() if r.source == source)
        assert abs(total - target) <= 3 * mixing.BLOCK_WORDS

    packed = docs.toPandas()
    assert packed.length.sum() == sum(map(len, encode(mixed.text.to_list())))
    sizes = packed.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes)


def test_run_agrees_with_itself(spark):
    one, two = (corpus_pipeline.run(spark, DATA).agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first() for _ in range(2))
    assert one == two and np.all(np.array(one) > 0)


def test_stages_with_odd_documents(spark):
    """Null and empty texts, ids and sources, repeated rows, very long texts and columns with names of the stages' own go through all stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    long = docs.orderBy("doc_id").limit(1).withColumns({"doc_id": F.lit(9001).cast("long"), "text": F.concat_ws(" ", F.array_repeat("text", 40))})
    odd = spark.createDataFrame(
        [(None, "A text without an id, but with words enough to tell.", "en", None), (9002, None, None, "s"), (9003, "", "en", "s"), (9004, " \t\n", "en", None), (9005, "one", None, "s"), (9005, "one", None, "s")],
        "doc_id long, text string, lang string, source string",
    ).withColumn("n_chars", F.length("text").cast("long"))
    whole = docs.unionByName(long).unionByName(odd).unionByName(odd.limit(1)).withColumns({c: F.lit("clash") for c in ("key", "copy", "size", "tag", "print", "doc", "d", "p")})
    for name, stage in corpus_pipeline.STAGES:
        before, whole = whole.count(), materialize(stage(spark, whole, DATA), name)
        assert 0 < whole.count() and (name in ("mix_sources", "pack_sequences") or whole.count() <= before)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
