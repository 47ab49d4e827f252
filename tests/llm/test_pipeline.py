"""The pipeline against its stages' own laws at a small scale."""

import corpus_pipeline
from pricewell.llm import bpe, queries
from pricewell.llm.common import env_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= seen
        if name == "jaccard_join":
            known = {r["doc_id"]: r["component_id"] for r in queries.jaccard.join(docs).collect()}
            assert all(k == v for k, v in known.items())
        seen = kept
    codec = bpe.Codec(env_path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], list(codec.encode(r["text"] or ""))) for r in docs.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
