"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.storage import filed, shared_dir

#: A word: a run of characters other than the ASCII white space of these six codes.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than this share of the rows is joined by itself, so at most 1 / HOT keys are.
HOT = 0.001


#: What empties the caches that operators keep in this Python worker.
KEEPERS: list[Callable[[], None]] = []


def let_go() -> None:
    """Empties what earlier tasks of other operators left in this Python worker, which Spark uses again.

    Freed memory goes back to the system, as an executor's workers share its memory with its JVM.
    """
    for empty in KEEPERS:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library's, where it has one
        trim(0)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; clusters use --py-files or an install."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read back, which cuts the lineage.

    The table goes when the driver ends; one that no result reads goes sooner under scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = filed(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the tables that stored() wrote; others and None are left alone."""
    for d in tables:
        if path := getattr(d, "_stored_at", None):
            files, where = filed(d.sparkSession, path)
            files.delete(where, True)
            d._stored_at = None


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A stored() whose tables go at the end of the block: for what the block's result doesn't read any more."""
    made: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    try:
        yield put
    finally:
        dropped(*made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def mixed(*cols: Column) -> Column:
    """A non-negative 62-bit hash of the columns, alike in every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """The columns `keys` are alike in both, nulls too."""
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        out = out & a[k].eqNullSafe(b[k])
    return out


def looked_up(rows: DataFrame, by: DataFrame, key: str, weight: str, total: int, values: list[str]) -> DataFrame:
    """rows with the `values` of `by` for their key (null if it isn't there). by: one row per key, `weight` rows of `rows` each.

    Keys with more than HOT of all `total` rows are at most 1 / HOT and are broadcast; the others are joined by a shuffle in
    which no key has more rows than that. Null keys have no values.
    """
    own = [F.col(c) for c in rows.columns]
    is_hot = F.col(weight) > HOT * total
    hot = F.broadcast(by.filter(is_hot).select(F.col(key).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values]))
    d = rows.join(hot, rows[key] == hot["_hot"], "left")
    cold = by.filter(~is_hot & F.col(key).isNotNull()).select(F.col(key).alias("_cold"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    easy = d.filter(F.col("_hot").isNotNull() | F.col(key).isNull()).select(*own, *[F.col(f"_hot_{v}").alias(v) for v in values])
    hard = d.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*own)
    return easy.unionByName(hard.join(cold, hard[key] == cold["_cold"], "left").select(*own, *[F.col(f"_cold_{v}").alias(v) for v in values]))


def prefix_sums(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str, rows_per_bucket: int = 2_000) -> DataFrame:
    """Adds `out`: the inclusive running sum of `value` within `group` in the order of (key, ties).

    key is a hash from mixed(), which few rows share. The hash range is cut into equal buckets, about rows_per_bucket rows
    each, so that a group with any share of the rows is dealt over many tasks: bucket totals give each bucket's offset, and
    only the rows of one bucket are summed by one task. Reads df three times; pass a stored table.
    """
    n = df.count()
    buckets = 1
    while buckets * rows_per_bucket < n:
        buckets *= 2
    width = (1 << 62) // buckets
    d = df.withColumn("_bucket", F.floor(F.col(key) / F.lit(width)).cast("int")) if buckets > 1 else df.withColumn("_bucket", F.lit(0))
    keys = [*group, "_bucket"]
    totals = d.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = W.partitionBy(*keys).orderBy(key, *ties).rowsBetween(W.unboundedPreceding, 0)
    running = d.withColumn("_within", F.sum(value).over(within))
    return running.join(offsets, same(running, offsets, keys)).select(*[running[c] for c in df.columns], (running["_within"] + offsets["_offset"]).alias(out))


def copies(df: DataFrame, key: str, out: str = "_copy") -> DataFrame:
    """The rows of a stored table with `out`: a number from 0 on, without gaps, among the rows of one key.

    The table needs a column _part, spark_partition_id() as it was written. Rows alone with their key take part in one count
    and get 0; the others are numbered within each part of the table that holds them, beyond the numbers of the parts
    before, so that a key with any share of the rows is dealt over as many tasks as the table was.
    """
    sizes = df.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    repeated = sizes.groupBy(key).agg(F.sum("_n").alias("_all")).filter("_all > 1")
    if repeated.isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = [c for c in df.columns if c not in (key, "_part")]
    n = F.row_number().over(W.partitionBy(key, "_part").orderBy(*own)).cast("long") if own else F.row_number().over(W.partitionBy(key, "_part").orderBy(key)).cast("long")
    d = df.withColumn("_n", n - 1)
    return d.join(offsets.drop("_n"), same(d, offsets, [key, "_part"])).select(*[d[c] for c in df.columns], (F.col("_n") + F.col("_before")).alias(out))


def orderable(kind: T.DataType) -> bool:
    """Whether Spark can compare values of a type: not maps, variants and intervals of the calendar, nor what holds these."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def in_order(d: DataFrame) -> Column:
    """A struct that orders the rows by their columns; those that Spark cannot compare by their JSON."""
    return F.struct(*[F.col(f"`{f.name}`") if orderable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))).alias(f.name) for f in d.schema.fields])


def env_path(name: str) -> str:
    """Place of a public tokenizer file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
