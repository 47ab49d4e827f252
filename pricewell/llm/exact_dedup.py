"""Exact deduplication by a stateful stream: keyed state on disk, without expiry, and a check of all bytes on hits.

remember() streams the documents' files into a keyed state of RocksDB stores, one entry per digest of a normalised text: how
many rows had it, and of the row to keep its id and the place of its content (file and row). Nothing expires, so a copy is
found however late it comes; a later run reads the new files only. ledger() reads that state as a table. decide() gives each
row its group, after the bytes of every row whose digest was seen elsewhere were compared with those at the kept row's place.

Texts are equal when identical without the characters of white space; a null text is an empty one. Of equal texts the row
with the most code points stays, then that with the smallest id (null ids last), then the first by file and row: of rows
that repeat an id and a text, exactly one is kept. Further columns of any name are left alone; no rows give no rows. Texts
of any length pass as a whole. All is expressions, joins and aggregations of Spark.

A group may hold any share of the rows: its counts are summed within tasks first, its values reach its rows by a broadcast
of the at most 1,000 groups that hold over a thousandth of the rows, and the bytes of such a group are compared in salted parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm.common import HOT, filed, looked_up, scratch, shared_dir, stored

#: The characters that don't count: blank, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: How the state is kept: on disk, and without files laid out ahead, as a state has many stores of which most are small.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bits of the map that keeps rows of no repeated digest where they are: 8 MB, whatever the number of rows.
MAP_BITS = 26
#: Rows of a large group that are compared in one part.
PART = 2_000

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def entries(docs: DataFrame, digest: Digest = sha256, doc_id: str = "doc_id", text: str = "text", bytes_too: bool = False) -> DataFrame:
    """digest, doc_id, chars, file, row (and norm) of rows read from files, in a batch or a stream."""
    place = docs.metadataColumn("_metadata")
    t = docs[text]
    d = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(F.length(t), F.lit(0)).alias("chars"), place["file_path"].alias("file"), place["row_index"].alias("row"), normalised(t).alias("norm"))
    return d.select(digest(F.col("norm")).alias("digest"), "doc_id", "chars", "file", "row", *["norm"] * bytes_too)


def best_row() -> Column:
    """The row to keep of a group: the most code points, the smallest id, the first place."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))


def remember(stream: DataFrame, checkpoint: str, digest: Digest = sha256, doc_id: str = "doc_id", text: str = "text"):
    """Starts the query that takes the stream's new files into the state under `checkpoint`, and ends when none is left."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        groups = entries(stream, digest, doc_id, text).groupBy("digest").agg(F.count("*").alias("n"), best_row().alias("best"))
        return groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, group_size, keep_id, keep_file, keep_row: the state as it is, without rows before the first run with files."""
    files, where = filed(spark, f"{checkpoint}/commits/0")
    if not files.exists(where):
        return spark.createDataFrame([], LEDGER)
    d = spark.read.format("statestore").load(checkpoint)
    return d.select("key.digest", F.col("value.count").alias("group_size"), F.col("value.min.doc_id").alias("keep_id"), F.col("value.min.file").alias("keep_file"), F.col("value.min.row").alias("keep_row"))


LEDGER = "digest BINARY, group_size BIGINT, keep_id BIGINT, keep_file STRING, keep_row BIGINT"
KEPT = ["group_size", "keep_id", "keep_file", "keep_row"]


def perhaps_in(d: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of d whose digest is marked in a bit map of the given digests: those of them, and few others.

    The map has 2^MAP_BITS bits, in rows of 4 KB, and is broadcast; where it fills up, more rows go on, and none is lost.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(1 << MAP_BITS)) + 1
    bits = digests.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    e = d.withColumn("_slot", slot)
    e = e.join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_part"))
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return e.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) != 0).select(*d.columns)


def hits(docs: DataFrame, repeated: DataFrame, total: int, digest: Digest, doc_id: str, text: str) -> DataFrame:
    """The rows of the repeated digests with their bytes: digest, salt, salts, doc_id, chars, file, row, norm, is_kept.

    repeated: the ledger's rows of more than one row. A digest of more than HOT of all rows is dealt over salts.
    """
    salts = F.when(F.col("group_size") > HOT * total, F.ceil(F.col("group_size") / PART)).otherwise(1).cast("int")
    known = repeated.withColumn("salts", salts)
    hot = F.broadcast(known.filter("salts > 1").select("digest", F.col("salts").alias("_salts")))  # 1 / HOT rows at most
    d = perhaps_in(entries(docs, digest, doc_id, text, bytes_too=True), repeated).join(hot, "digest", "left")
    d = d.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("file", "row"), "_salts"), F.lit(0)).cast("int")).drop("_salts")
    known = known.select("digest", "salts", "keep_file", "keep_row", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    found = d.join(known, ["digest", "salt"])
    return found.select("digest", "salt", "salts", "doc_id", "chars", "file", "row", "norm", ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("is_kept"))


def clashes(found: DataFrame) -> DataFrame:
    """The digests, once each, that have a row whose bytes differ from those at the kept row's place."""
    kept = found.filter("is_kept").select("digest", F.col("norm").alias("kept"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return found.filter("not is_kept").join(kept, ["digest", "salt"]).filter("norm <> kept").select("digest").distinct()


def decide(docs: DataFrame, known: DataFrame, digest: Digest = sha256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, group_size, keep_id, kept of every row of docs, whose files the ledger `known` has taken in.

    Rows of one digest but of other bytes form groups of their own, exactly by their bytes.
    """
    spark = docs.sparkSession
    rows = stored(entries(docs, digest, doc_id, text), "dedup-rows")
    total = rows.count()
    with scratch(spark) as put:
        repeated = stored(known.filter("group_size > 1"), "dedup-groups")
        found = put(hits(docs, repeated, total, digest, doc_id, text), "dedup-hits")
        wrong = put(clashes(found), "dedup-clashes")
        d = looked_up(rows, repeated, "digest", "group_size", total, KEPT)
        if not wrong.isEmpty():
            d = d.join(by_bytes(found.join(wrong, "digest", "left_semi"), put), ["file", "row"], "left")
            d = d.select("doc_id", "digest", "file", "row", *[F.when(F.col("exact_size").isNull(), F.col(c)).otherwise(F.col(c.replace("group", "exact").replace("keep", "exact"))).alias(c) for c in KEPT])
            d = stored(d, "dedup-decided")
    alone = F.col("group_size").isNull()
    is_kept = alone | ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))
    return d.select("doc_id", "digest", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), is_kept.alias("kept"))


def by_bytes(found: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """file, row, exact_size, exact_id, exact_file, exact_row of rows grouped by their bytes, for digests that clash."""
    groups = found.groupBy("norm").agg(F.count("*").alias("exact_size"), best_row().alias("b"))
    groups = put(groups.select("norm", "exact_size", F.col("b.doc_id").alias("exact_id"), F.col("b.file").alias("exact_file"), F.col("b.row").alias("exact_row")), "dedup-exact")
    return found.select("norm", "file", "row").join(groups, "norm").drop("norm")


def deduplicated(spark: SparkSession, path: str, schema, checkpoint: str | None = None, files_per_batch: int = 1_000, **how) -> DataFrame:
    """decide() over the Parquet files under `path` (a folder or pattern), after their new files are in the state.

    checkpoint: the state's folder, which a later run over more files goes on with; by default one for this run alone.
    """
    checkpoint = checkpoint or f"{shared_dir(spark)}/dedup-state-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    remember(stream, checkpoint, **how).awaitTermination()
    return decide(spark.read.schema(schema).parquet(path), ledger(spark, checkpoint), **how)
