"""Exactly which rows each stage of the pipeline keeps."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from pricewell.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def rows(d):
    return Counter(tuple(r) for r in d.collect())


def test_near_copies_by_row(spark):
    r = random.Random(3)
    a, b, c, d, e, f = (" ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(60)) for _ in range(6))
    made = [(1, a), (2, a + " tail"), (5, a + " end"), (5, b), (7, c), (7, d), (8, e), (8, e), (8, e.upper()), (9, d), (10, ""), (10, None), (None, f), (None, f)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = Counter([(1, a), (5, b), (7, c), (7, d), (8, e.upper()), (10, None), (None, f), (None, f)])
    assert rows(corpus_pipeline.drop_near_copies(spark, docs, SF)) == want


def test_stages_keep_what_they_state(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    toxic, lang = queries.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet")), queries.lang_model(docs)
    clean = Counter(tuple(x) for x in docs.collect() if toxic.score(x["text"]) < queries.TOXIC_FROM)
    assert rows(corpus_pipeline.drop_toxic(spark, docs, SF)) == clean and clean
    known = Counter(tuple(x) for x in docs.collect() if (p := lang.predict(x["text"]))[0] != "und" and p[1] >= 0.5)
    assert rows(corpus_pipeline.drop_unrecognised(spark, docs, SF)) == known and known
    copies = {x["doc_id"]: x["_copies"] for x in mixing.mix(docs, mixing.cuts(docs)).collect()}
    mixed = rows(corpus_pipeline.mix_sources(spark, docs, SF))
    assert mixed == Counter({tuple(x): copies[x["doc_id"]] for x in docs.collect() if copies[x["doc_id"]]}) and mixed
    near = {x["doc_id"]: x["component_id"] for x in queries.jaccard.join(docs).collect()}
    assert rows(corpus_pipeline.drop_near_copies(spark, docs, SF)) == Counter(tuple(x) for x in docs.collect() if near[x["doc_id"]] == x["doc_id"])


def test_columns_of_any_name_and_type_go_through(spark):
    """Names that stages use on the way, maps and structs, with repeated ids: every kept row is as it came."""
    r = random.Random(5)
    a, b, c = (" ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(60)) for _ in range(3))
    base = [(1, a), (1, a), (1, b), (2, a + " end"), (3, c), (None, c), (4, None), (4, "")]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(base)], "doc_id long, text string, k int")
    mine = {n: F.concat(F.lit(n), F.col("k").cast("string")) for n in ("_key", "_row", "key", "comp", "component_id", "_mix_key", "_mix_n", "_mix_of", "_mix_again", "_copies", "_size", "_target", "_part", "other_0", "c0", "score")}
    d = d.withColumns({"source": F.lit("s"), "lang": F.lit("en"), **mine, "m": F.create_map(F.lit("k"), F.col("k")), "st": F.struct(F.col("k").alias("x"), F.create_map(F.lit("y"), F.col("k")).alias("z"))})
    came = {repr(x) for x in d.collect()}
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        out = stage(spark, d, SF)
        assert out.dtypes == d.dtypes
        got = [repr(x) for x in out.collect()]
        assert got and set(got) <= came
    kept = corpus_pipeline.drop_near_copies(spark, d, SF).collect()
    assert sorted(x["k"] for x in kept)[:2] == [0, 2] and sum(x["doc_id"] == 1 for x in kept) == 2
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_unrecognised):
        docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_key": F.lit("mine"), "score": F.lit(7), "m": F.create_map(F.lit("a"), F.col("doc_id"))})
        got = stage(spark, docs, SF).collect()
        assert got and all(x["_key"] == "mine" and x["score"] == 7 and x["m"] == {"a": x["doc_id"]} for x in got)
