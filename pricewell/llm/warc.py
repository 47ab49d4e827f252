"""WARC fixity audit by Merkle trees.

Pages are laid out as WARC records, each at an offset of a file. A replica's manifest holds a hash per record; per file a
tree is hashed over ordered offset ranges: the lowest nodes cover RANGE bytes, each level above FANOUT nodes of the one
below. Two replicas are compared root by root, and only the children of nodes that differ are looked at, level by level,
down to the records that are changed, missing or added. Offsets and not counts bound the ranges, so a lost record leaves
its neighbours' branches as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.llm.common import importable, stored

RANGE, FANOUT, PER_FILE = 1 << 16, 16, 1_000
#: What a record ends with.
END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the text of a WARC record; nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, body, F.lit(END))


def layout(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", also: dict[str, Column] | None = None) -> DataFrame:
    """file, page_id, offset, length, sha256 of every page's record, and the columns of `also`, made from the page.

    Files take about PER_FILE records by a hash of id and address, which goes over all files for pages that repeat
    (of pages of the same id and address the first is placed by these alone, the others by their number too); within a file records are ordered by id, null first, then
    hash. Nulls count as empty; repeated pages have a record each; other columns of pages are left out; an empty table gives
    no rows. Only hashes, lengths and `also` are shuffled.
    """
    n = max(1, -(-pages.count() // PER_FILE))
    whole = record(F.col(page_id), F.col(url), F.col(html))
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), _place(F.col(page_id), F.col(url)).alias("_place"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("sha256"), *[c.alias(k) for k, c in (also or {}).items()])
    d = _each_copy(d).withColumn("file", _file(F.col("_place"), F.col("_copy"), n))
    before = W.partitionBy("file").orderBy(F.asc_nulls_first("page_id"), "sha256").rowsBetween(W.unboundedPreceding, -1)
    return d.select("file", "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "sha256", *(also or {}))


def _place(page_id: Column, url: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("long").cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))


def _each_copy(d: DataFrame) -> DataFrame:
    """d with _copy: 0, 1 and so on for rows that are alike. They are counted, within tasks first, and dealt out again."""
    return d.groupBy(*d.columns).agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")


def _file(place: Column, copy: Column, files: int) -> Column:
    """The first of pages alike goes by its id and address, the others by their number too."""
    key = F.when(copy == 0, place).otherwise(F.md5(F.concat_ws("|", place, copy.cast("string"))))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % files).cast("int")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the pages as the WARC files of layout(): path/file=N/part-*.txt holds file N's records, byte for byte.

    A task writes whole files, of about PER_FILE records each, so that a record's place is the one in the layout.
    """
    n = max(1, -(-pages.count() // PER_FILE))
    whole = record(F.col(page_id), F.col(url), F.col(html))
    d = _each_copy(pages.select(_place(F.col(page_id), F.col(url)).alias("_place"), F.col(page_id).cast("long").alias("_id"), whole.alias("value")))
    d = d.select(_file(F.col("_place"), F.col("_copy"), n).alias("file"), "_id", F.sha2("value", 256).alias("_sha"), "value")
    # the writer ends each value with END, so the record goes without its own
    d = d.repartition("file").sortWithinPartitions("file", F.asc_nulls_first("_id"), "_sha").select("file", F.expr(f"left(value, length(value) - {len(END)})").alias("value"))
    d.write.partitionBy("file").option("lineSep", END).text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, sha256 of every record in the WARC files under path, one row per record.

    A record goes from its "WARC/" line to the end that its Content-Length gives. What isn't such a record (a damaged
    header) makes one row from there to the next place that starts like a record, or to the end of the file.
    """
    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                spans = list(records(data))
                rows = [[file] * len(spans), [a for a, _ in spans], [b - a for a, b in spans], [hashlib.sha256(data[a:b]).hexdigest() for a, b in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "offset", "length", "sha256"])

    return named.mapInArrow(run, "file int, offset long, length long, sha256 string")


HEAD = re.compile(rb"WARC/\d+\.\d+\r\n(?:[^\r\n]+\r\n)*?Content-Length: *(\d+)\r\n(?:[^\r\n]+\r\n)*\r\n")
NEXT = re.compile(rb"\r\n\r\n(?=WARC/\d+\.\d+\r\n)")


def records(data: bytes) -> Iterator[tuple[int, int]]:
    """(begin, end) of the records of a WARC file."""
    at = 0
    while at < len(data):
        head = HEAD.match(data, at)
        end = head.end() + int(head[1]) + len(END) if head else 0
        if not head or end > len(data) or data[end - len(END) : end] != END.encode():
            found = NEXT.search(data, at)
            end = found.end() if found else len(data)
        yield at, end
        at = end


def levels_for(manifest: DataFrame, *others: DataFrame) -> int:
    """Levels until one node covers the longest file."""
    most = max((m.agg(F.max("offset")).first()[0] or 0) for m in (manifest, *others))
    levels, span = 1, RANGE
    while span <= most:
        levels, span = levels + 1, span * FANOUT
    return levels


def tree(manifest: DataFrame, levels: int) -> list[DataFrame]:
    """Per level, lowest first: file, node, sha256. manifest: file, offset, sha256."""
    node = F.expr(f"offset div {RANGE}")
    leaves = manifest.select("file", node.alias("node"), F.struct(F.col("offset").alias("at"), F.col("sha256").alias("h")).alias("child"))
    out = []
    for k in range(levels):
        made = leaves.groupBy("file", "node").agg(F.array_sort(F.collect_list("child")).alias("c"))
        hashed = F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["h"])), ","), 256)
        out.append(stored(made.select("file", "node", hashed.alias("sha256")), f"merkle-{k}"))
        leaves = out[-1].select("file", F.expr(f"node div {FANOUT}").alias("node"), F.struct(F.col("node").alias("at"), F.col("sha256").alias("h")).alias("child"))
    return out


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under which one side's hash isn't the other's."""
    x, y = a.select(*keys, F.col("sha256").alias("ha")), b.select(*keys, F.col("sha256").alias("hb"))
    return x.join(y, keys, "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """file, offset, status ('changed', 'missing', 'added'), expected_sha256, found_sha256 of the records that differ.

    Both are manifests (file, offset, sha256), one record per file and offset. Equal manifests, and empty ones, give no row.
    """
    levels = levels_for(original, replica)
    a, b = tree(original, levels), tree(replica, levels)
    bad = _differing(a[-1], b[-1], ["file", "node"]).select("file", "node")
    for k in range(levels - 2, -1, -1):
        parents = bad.select("file", F.col("node").alias("parent"))
        below = [t[k].withColumn("parent", F.expr(f"node div {FANOUT}")).join(parents, ["file", "parent"], "left_semi") for t in (a, b)]
        bad = _differing(*below, ["file", "node"]).select("file", "node")
    records = [m.withColumn("node", F.expr(f"offset div {RANGE}")).join(bad, ["file", "node"], "left_semi") for m in (original, replica)]
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").otherwise("changed")
    return _differing(*records, ["file", "offset"]).select("file", "offset", status.alias("status"), F.col("ha").alias("expected_sha256"), F.col("hb").alias("found_sha256"))
