import corpus_pipeline
from pyspark.sql import functions as F

from tickloom.llm import langid, minhash, mixing, secrets
from tickloom.llm.common import cut


def test_stages_against_their_operators(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    dirty = docs.unionByName(spark.createDataFrame([(9_000_001, None, None, None, None), (9_000_002, "12 34", "en", "src0", 5), (9_000_003, docs.first().text, "en", "src0", 5)], docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = dirty
        dirty = cut(stage(spark, before, tables), name)
        kept[name] = dirty
        if name != "bpe":
            assert dirty.columns == docs.columns
        if name == "language":
            assert {r.doc_id for r in dirty.collect()} == {r.doc_id for r in before.filter("text IS NOT NULL AND text RLIKE '\\\\p{L}'").collect()}
        if name == "near_dedup":
            want = {r.doc_id for r in minhash.groups(before, 5, 80).filter("kept").collect()}
            assert {r.doc_id for r in dirty.collect()} == want and 9_000_003 not in want
        if name == "secrets":
            assert dirty.count() == before.count()
            left = secrets.digest(dirty).agg(F.sum("n_assign"), F.sum("n_access"), F.sum("n_hex")).first()
            assert tuple(left) == (0, 0, 0)
        if name == "mixing":
            assert dirty.count() == mixing.mix(before).agg(F.sum("copies")).first()[0]
        if name == "bpe":
            assert dirty.count() == before.count() and dirty.filter("n_tokens <> size(ids)").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and langid


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 100
