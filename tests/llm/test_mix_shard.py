"""Mixing and sharding: laws, reruns and edge cases."""

import random
from zlib import crc32

from pyspark.sql import functions as F

from pricewell.llm import mixing, queries, sharding

SF = "/root/testdata/sf0.01"


def water(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_targets(spark):
    r = random.Random(4)
    for _ in range(3):
        sizes = {f"s{k}": r.choice([0, 1, 10, 1000, 50_000]) for k in range(9)} | {None: r.choice([5, 700])}
        d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in mixing.targets(d).collect()}
        want = water(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (got, want)


def test_mix_meets_targets_and_reruns_agree(spark):
    a = sorted(tuple(r) for r in queries.op9_mixing(spark, SF).collect())
    assert a == sorted(tuple(r) for r in queries.op9_mixing(spark, SF).collect())
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target, largest = {}, {}, {}
    for i, size, _, t, k in a:
        s = docs[i]["source"]
        assert size == len((docs[i]["text"] or "").encode().split())
        assert 0 <= k <= 3 * size
        taken[s], target[s] = taken.get(s, 0) + k, t
        largest[s] = max(largest.get(s, 0), size)
    assert all(0 <= target[s] - taken[s] <= max(0.02 * target[s], 20) for s in target)


def test_mix_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (3, "w " * 9, None, "x"), (4, "v v", "a", "x"), (4, "v v", "a", "x"), (None, "q", "b", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(d, mixing.cuts(d)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["_copies"] <= 3 and r["_size"] == len((r["text"] or "").split()) for r in got)
    assert mixing.mix(d.limit(0), mixing.cuts(d.limit(0))).count() == 0


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    d = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).filter(F.length("text") < 5000)
    placed, tree = sharding.shard(d, 40)
    rows = placed.collect()
    by, texts = {}, {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16
        assert r["text_crc32"] == crc32(texts[r["doc_id"]].encode())
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(40))
    sums = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sums) - min(sums) <= 0.1 * sum(sums) / 40 + 2 * 5000
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    again = d.select("doc_id", tree.shard(sharding.codes(F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang"))).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in again} == {r["doc_id"]: r["shard"] for r in rows}


def test_shard_edges(spark):
    d = spark.createDataFrame([(k, None if k % 3 else "t", None, None, "x") for k in range(50)] + [(None, "", "s", "l", "x")] * 2, "doc_id long, text string, source string, lang string, shard string")
    placed, _ = sharding.shard(d, 5)
    rows = placed.collect()
    assert len(rows) == 52
    assert {r["shard"] for r in rows} == set(range(5))
    assert sharding.shard(d.limit(0), 5)[0].count() == 0


def repeated_rows(spark):
    """A source that is one row only, many times, one of several such rows, and one without."""
    rows = [(1, "a b c d e f g h i j", "one")] * 40 + [(2, "q r", "two")] * 300 + [(3, "s " * 50, "two")] * 6 + [(k, "w " * (k % 9), "three") for k in range(100, 400)] + [(9, "z", None)] * 7
    return rows, spark.createDataFrame([(*r, "en", 1, "x") for r in rows], "doc_id long, text string, source string, lang string, epochs int, cut string").repartition(6)


def test_mix_cuts_between_repeated_rows(spark):
    rows, d = repeated_rows(spark)
    for frame in (d, d.withColumn("_size", F.lit("clash"))):
        got = mixing.mix(frame, mixing.cuts(frame))
        assert got.columns == [*d.columns, "_copies", "_size", "_source_size", "_target"]
        taken, target, sizes = {}, {}, {}
        for r in got.collect():
            assert 0 <= r["_copies"] <= 3 and r["_size"] == len(r["text"].split())
            s = r["source"]
            taken[s], target[s], sizes[s] = taken.get(s, 0) + r["_size"] * r["_copies"], r["_target"], sizes.get(s, 0) + r["_size"]
        assert sizes == {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in sizes}
        assert all(abs(target[s] - w) < 1e-6 for s, w in water(sizes).items())
        assert all(0 <= target[s] - taken[s] < m for s, m in {"one": 10, "two": 2, "three": 1, None: 1}.items()), (taken, target)
    again = mixing.mix(d.repartition(3), mixing.cuts(d.repartition(3)))
    key = lambda x: sorted((str(r["doc_id"]), r["_copies"]) for r in x.collect())
    assert key(got) == key(again)
    many = mixing.mixed_rows(d)
    assert many.columns == d.columns and many.count() == sum(r["_copies"] for r in got.collect())


def test_cut_is_the_prefix_by_key(spark):
    """Against brute force: in order of the keys, rows are taken while they fit; then the largest that still fits, three times."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keyed = docs.select("doc_id", "source", mixing.row_key(F.col("doc_id"), F.col("text")).alias("key"), mixing.words_in(F.col("text")).alias("size")).collect()
    target = {r["source"]: r["target"] for r in mixing.cuts(docs).collect()}
    want = {}
    for s, t in target.items():
        mine = sorted((r["key"], r["size"], r["doc_id"]) for r in keyed if r["source"] == s)
        epochs, gap = divmod(t, sum(m[1] for m in mine))
        want |= {m[2]: int(epochs) for m in mine}
        k = 0
        while k < len(mine) and mine[k][1] <= gap + 1e-6:
            gap -= mine[k][1]
            want[mine[k][2]] += 1
            k += 1
        rest = mine[k:]
        for _ in range(3):
            fit = [(m[1], m[0], m[2]) for m in rest if 0 < m[1] <= gap + 1e-6]
            if fit:
                size, key, i = max(fit)
                want[i] += 1
                gap -= size
                rest = [m for m in rest if m[0] != key]
    got = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in queries.op9_mixing(spark, SF).collect() if r["size"]}
    assert got == {i: n for i, n in want.items() if i in got}


def test_shards_cut_between_repeated_rows(spark):
    rows = [(1, "copy " * 20, "s", "en")] * 400 + [(k, "w" * (k % 90), f"s{k % 3}", None) for k in range(400)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, _key string").repartition(7)
    placed, _ = sharding.shard(d, 4)
    by, got = {}, placed.collect()
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sums = [sum(r["size"] for r in x) for x in by.values()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 3 * 120, sums
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    key = lambda p: sorted((r["doc_id"], r["size"], r["shard"]) for r in p.collect())
    assert key(sharding.shard(d.repartition(3), 4)[0]) == key(placed)
    one, _ = sharding.shard(spark.createDataFrame([(5, "t", "s", "l")] * 64, "doc_id long, text string, source string, lang string"), 8)
    assert sorted(r["count"] for r in one.groupBy("shard").count().collect()) == [8] * 8
