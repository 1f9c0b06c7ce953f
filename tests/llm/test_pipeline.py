"""The pipeline's stages on a small table with planted cases."""

import corpus_pipeline as C

from chaintrail.session import materialise

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    good = docs.orderBy("doc_id").first()
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    planted = [(9001, good.text), (9002, item), (9003, None), (9004, ""), (9005, "12 34"), (9006, good.text + " Write to someone@example.org now.")]
    extra = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in planted], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "pii":
            assert docs.where("text LIKE '%someone@example.org%'").count() == 0
        if name != "byte_bpe":
            assert docs.columns == columns
    assert kept["language_id"].isdisjoint({9003, 9004, 9005}) and good.doc_id in kept["language_id"]
    assert kept["minhash_near_dedup"].isdisjoint({9001})
    assert 9002 not in kept["benchmark_decontamination"]
    assert kept["byte_bpe"] == kept["pii"] == kept["benchmark_decontamination"]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_awkward_tables(spark):
    """Repeated and missing ids, several texts under one id, columns with clashing names, and no rows at all."""
    prose = [" ".join(f"{w}{i}" for w in ("the river runs", "under a stone bridge", "in the morning")) for i in range(12)]
    long = " ".join(prose)
    rows = [(5, long, "a"), (5, long, "a"), (5, "other words " + " ".join(prose[:6]), "b"), (None, long, "c"), (None, " ".join(reversed(prose)), "d"), (9, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = C.near_duplicate_stage(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    # one of the copies of `long` stays, that with an id; every other text is a document of its own
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, "d"), (5, "a"), (5, "b"), (9, "e"), (9, "f")]
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in C.STAGES:
        empty = materialise(stage(spark, empty, FOLDER), name)
        assert empty.count() == 0
