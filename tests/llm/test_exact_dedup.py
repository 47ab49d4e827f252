"""Exact deduplication: against SQL's rule in Python, over several runs, with digests that clash, on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricewell.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def wanted(rows):
    """doc_id, keep_id, group_size, text_sha256 of every row, and how many of each group's rows are kept: one."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    best = {k: min(v)[3] for k, v in groups.items()}
    return sorted((repr(i), repr(best[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)


def given(df):
    got = df.collect()
    ones = {}
    for r in got:
        ones[r["text_sha256"]] = ones.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(ones.values()) <= {1}
    return sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got)


def odd_rows():
    r = random.Random(4)
    texts = ["", None, " \n", "a b", "ab", "a\tb ", "A b", "é è", "éè", "x" * 300_000, "x " * 300_000, "lone"]
    rows = [(r.choice([None, *range(12)]), r.choice(texts)) for _ in range(160)] + [(7, "same row")] * 5 + [(100 + k, f"only {k}") for k in range(20)]
    return rows + [(1_000 + k, "a large group") for k in range(200)]


def landed(spark, rows, path, parts=3):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.withColumns({"_metadata": F.lit(1), "digest": F.lit("mine"), "file": F.lit(2), "norm": F.lit("n")}).repartition(parts).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert given(queries.op13_exact_dedup(spark, SF)) == wanted([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows_and_clashing_names(spark, tmp_path):
    rows = odd_rows()
    landed(spark, rows, str(tmp_path / "documents.parquet"))
    got = queries.op13_exact_dedup(spark, str(tmp_path))
    assert given(got) == wanted(rows)
    assert all("Python" not in line and "Pandas" not in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.mark.parametrize("kinds", [1, 7])
def test_digests_that_clash(spark, tmp_path, kinds):
    """With a digest of a few values the bytes decide, and exactly."""
    rows, path = odd_rows(), str(tmp_path / "d")
    schema = landed(spark, rows, path)
    weak = lambda norm: F.encode((F.crc32(norm.cast("binary")) % kinds).cast("string"), "utf-8")
    d = exact_dedup.deduplicated(spark, path, schema, digest=weak)
    sizes = {}
    for doc_id, text in rows:
        sizes.setdefault(normal(text), []).append(doc_id)
    got = d.collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(sizes)
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"]) for r in got) == sorted(x[:3] for x in wanted(rows))


def test_state_goes_on_over_runs(spark, tmp_path):
    """A second run takes in the new files only, and finds copies of the first run's texts."""
    rows, path, state = odd_rows(), str(tmp_path / "d"), str(tmp_path / "state")
    schema = landed(spark, rows[:150], path)
    first = exact_dedup.deduplicated(spark, path, schema, state).withColumn("text_sha256", F.lower(F.hex("digest")))
    assert given(first) == wanted(rows[:150])
    landed(spark, rows[150:], path)
    stream = spark.readStream.schema(schema).parquet(path)
    run = exact_dedup.remember(stream, state)
    run.awaitTermination()
    assert sum(p["numInputRows"] for p in run.recentProgress) == len(rows) - 150
    assert "rocksdbPutCount" in run.lastProgress["stateOperators"][0]["customMetrics"]
    known = exact_dedup.ledger(spark, state)
    assert known.agg(F.sum("group_size")).first()[0] == len(rows) and known.count() == len({normal(t) for _, t in rows})
    again = exact_dedup.deduplicated(spark, path, schema, state).withColumn("text_sha256", F.lower(F.hex("digest")))
    assert given(again) == wanted(rows)


def test_large_groups_are_compared_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART", 20)
    monkeypatch.setattr(exact_dedup, "HOT", 0.05)
    rows, path = odd_rows(), str(tmp_path / "d")
    schema = landed(spark, rows, path)
    d = spark.read.schema(schema).parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    exact_dedup.remember(stream, str(tmp_path / "s")).awaitTermination()
    known = exact_dedup.ledger(spark, str(tmp_path / "s")).filter("group_size > 1")
    found = exact_dedup.hits(d, known, len(rows), exact_dedup.sha256, "doc_id", "text").cache()
    assert found.filter("salts > 1").select("salt").distinct().count() > 5
    assert exact_dedup.clashes(found).isEmpty()
    spoiled = found.withColumn("norm", F.when((F.col("doc_id") == 1_100), "other").otherwise(F.col("norm")))
    assert exact_dedup.clashes(spoiled).count() == 1


def test_nothing_to_read(spark, tmp_path):
    schema = landed(spark, [], str(tmp_path / "none"), 1)
    assert exact_dedup.deduplicated(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "empty").mkdir()
    assert exact_dedup.deduplicated(spark, str(tmp_path / "empty"), schema).count() == 0
