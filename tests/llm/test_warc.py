"""The fixity audit against a plain comparison, and the query against its SQL twin."""

import random

import duckdb
from pyspark.sql import functions as F

from pricewell.llm import queries, warc

SF = "/root/testdata/sf0.001"


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(queries.OP6_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(repr(dict(zip(names, r, strict=True))[c]) for r in cur.fetchall() for c in sorted(names))
    df = queries.op6_warc_fixity(spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(r[c]) for r in df.collect() for c in sorted(df.columns)) == want


def test_audit_is_a_comparison(spark):
    r = random.Random(6)
    a, at = {}, 0
    for k in range(3):
        at = 0
        for _ in range(80):
            a[k, at] = f"{r.random()}"
            at += r.choice([10, 5_000, 90_000, 3_000_000])
    b = {key: ("x" if r.random() < 0.03 else h) for key, h in a.items() if r.random() > 0.03} | {(1, at + 5): "new", (9, 0): "file"}
    frame = lambda m: spark.createDataFrame([(*k, h, "c") for k, h in m.items()], "file int, offset long, sha256 string, node string").drop("node")
    got = {(x["file"], x["offset"]): x["status"] for x in warc.audit(frame(a), frame(b)).collect()}
    want = {k: "missing" if k not in b else "added" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert got == want
    assert warc.audit(frame(a), frame(a)).count() == 0


def test_edges(spark):
    d = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, "u", "é" * 9000, "x")], "page_id long, url string, html string, file string")
    rows = warc.layout(d).orderBy("offset").collect()
    assert len(rows) == 4
    assert [x["offset"] for x in rows] == [sum(y["length"] for y in rows[:k]) for k in range(4)]
    assert warc.layout(d.limit(0)).count() == 0
    assert warc.audit(warc.layout(d.limit(0)), warc.layout(d.limit(0))).count() == 0
    assert warc.audit(warc.layout(d), warc.layout(d.filter(F.col("page_id") == 2))).count() >= 1


def pages(spark):
    rows = [(k, f"u{k % 7}", "x" * (k * 37 % 900)) for k in range(200)] + [(None, "u", "n"), (None, None, None), (7, None, ""), (7, None, ""), (7, "v", "é"), (11, "u", "lost"), (60, "u", "w")]
    return spark.createDataFrame([(*x, "x") for x in rows], "page_id long, url string, html string, offset string")


def test_query_with_nulls_and_repeated_pages(spark, tmp_path):
    pages(spark).drop("offset").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(queries.OP6_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(repr([r[k] for k in sorted(range(len(names)), key=names.__getitem__)]) for r in cur.fetchall())
    df = queries.op6_warc_fixity(spark, str(tmp_path))
    got = sorted(repr([r[c] for c in sorted(names)]) for r in df.collect())
    assert got == want and len(got) == pages(spark).count()
    assert {r["status"] for r in df.filter("page_id is null").collect()} == {"ok"}


def test_files_hold_the_layout_and_show_damage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 50)
    path, kept = str(tmp_path / "warc"), warc.layout(pages(spark)).cache()
    warc.write(pages(spark), path)
    rows = lambda d: sorted((r["file"], r["offset"], r["length"], r["sha256"]) for r in d.collect())
    assert rows(warc.manifest(spark, path)) == rows(kept)
    hit = kept.filter("page_id = 100").first()
    [file] = (tmp_path / "warc" / f"file={hit['file']}").glob("part-*")
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    data = bytearray(file.read_bytes())
    data[hit["offset"] + hit["length"] - 6] ^= 1
    data[hit["offset"]] ^= 1  # and its header
    file.write_bytes(bytes(data))
    found = warc.audit(kept, warc.manifest(spark, path)).collect()
    assert [(r["file"], r["offset"], r["status"]) for r in found] == [(hit["file"], hit["offset"], "changed")]


def test_pages_alike_go_over_all_files(spark, monkeypatch, tmp_path):
    """Equal pages fill files like others do, and the files written have the places of the layout."""
    monkeypatch.setattr(warc, "PER_FILE", 100)
    d = spark.range(1_000).select(F.lit(7).alias("page_id"), F.lit("http://a").alias("url"), F.lit("same").alias("html"))
    d = d.unionByName(spark.range(200).select(F.col("id").cast("int").alias("page_id"), F.lit("http://b").alias("url"), F.col("id").cast("string").alias("html"))).repartition(3)
    made = warc.layout(d)
    sizes = [r["count"] for r in made.groupBy("file").count().collect()]
    assert sum(sizes) == 1_200 and len(sizes) == 12 and max(sizes) < 180
    warc.write(d, str(tmp_path / "w"))
    place = lambda x: sorted((r["file"], r["offset"], r["length"], r["sha256"]) for r in x.collect())
    assert place(warc.manifest(spark, str(tmp_path / "w"))) == place(made)
