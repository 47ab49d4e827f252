"""Shared helpers: look-ups with hot keys, numbers of rows alike, running sums, stored tables."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewell.llm import common


def test_look_ups_take_hot_keys_by_themselves(spark):
    r = random.Random(1)
    keys = ["hot"] * 700 + [None] * 20 + [f"k{r.randrange(300)}" for _ in range(1_500)] + ["lost"] * 3
    rows = spark.createDataFrame([(k, i, "x") for i, k in enumerate(keys)], "key string, i int, value string").repartition(5)
    sizes = Counter(k for k in keys if k and k != "lost")
    by = spark.createDataFrame([(k, n, f"v-{k}") for k, n in sizes.items()], "key string, n long, found string")
    got = common.looked_up(rows, by, "key", "n", len(keys), ["found"])
    assert sorted((r["i"], r["found"]) for r in got.collect()) == [(i, f"v-{k}" if k and k != "lost" else None) for i, k in enumerate(keys)]
    assert got.columns == ["key", "i", "value", "found"]
    assert by.filter(F.col("n") > common.HOT * len(keys)).count() <= 1 / common.HOT
    assert common.looked_up(rows.limit(0), by, "key", "n", 0, ["found"]).count() == 0


def test_rows_alike_are_numbered(spark):
    keys = [5] * 90 + [6] * 2 + list(range(100, 400))
    for own in ([], ["a"]):
        d = spark.createDataFrame([(k, k % 3) for k in keys], "key long, a int").select("key", *own).repartition(6).withColumn("_part", F.spark_partition_id())
        got = common.copies(common.stored(d, "copies-test"), "key")
        by = {}
        for r in got.collect():
            by.setdefault(r["key"], []).append(r["_copy"])
        assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in Counter(keys).items()}
        alone = common.stored(d.filter("key > 50"), "copies-test")
        assert {r["_copy"] for r in common.copies(alone, "key").collect()} == {0}
        assert common.copies(alone.limit(0), "key").count() == 0


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", None, "b"]), r.randrange(1 << 62), r.randrange(9)) for _ in range(700)]
    d = spark.createDataFrame(rows, "g string, key long, v long").repartition(4)
    for size in (10, 2_000):
        got = {(x["g"], x["key"]): x["s"] for x in common.prefix_sums(d, ["g"], "key", [], "v", "s", size).collect()}
        assert got == {(g, k): sum(v for h, j, v in rows if h == g and j <= k) for g, k, _ in rows}


def test_stored_tables_go(spark):
    d = spark.range(3)
    with common.scratch(spark) as kept:
        a = kept(d, "scratch-test")
        path = Path(a._stored_at.removeprefix("file://"))
        assert a.count() == 3 and path.exists()
    assert not path.exists()
    b = common.stored(d, "kept-test")
    common.dropped(None, d)
    assert b.count() == 3


def test_local_folder_is_for_local_mode_only():
    class Far:
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]"})
        conf = type("F", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)
