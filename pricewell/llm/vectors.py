"""What the vector searches share: valid rows, blocks, and the pairing of query blocks with candidate blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.llm.common import copies, dropped, mixed, stored


def valid(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id long, vec array<double>, n: its length, row: a number of its own) of the rows that take part, stored.

    Rows with null id, null or empty vector, null or non-finite components stay out, as do all-zero vectors unless `zero`.
    Other columns of df are left out. `row` is a hash of id, vector and the row's number among rows alike, so that repeated
    ids and rows stay apart, in the same way in every run.
    """
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))))
    if not zero:
        d = d.filter(F.exists("vec", lambda x: x != 0))
    key = mixed(F.lit(8), F.col("vec_id"), F.col("vec"))
    first = stored(d.select("vec_id", "vec", F.size("vec").alias("n"), key.alias("_key"), F.spark_partition_id().alias("_part")), "vectors")
    # the numbers of rows alike need their keys only
    slim = first.select("_key", "_part")
    if slim.groupBy("_key", "_part").count().groupBy("_key").agg(F.sum("count").alias("m")).filter("m > 1").isEmpty():
        return first.select("vec_id", "vec", "n", F.col("_key").alias("row"))
    out = stored(copies(first, "_key").select("vec_id", "vec", "n", F.when(F.col("_copy") == 0, F.col("_key")).otherwise(mixed("_key", "_copy")).alias("row")), "vectors")
    dropped(first)
    return out


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    return np.asarray(c.flatten(), dtype=dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def searched(base: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, base_rows: int = 16_384, query_rows: int = 1_024) -> DataFrame:
    """search(candidates, queries) of every block of candidates with every block of queries of the same length n.

    Blocks are dealt by the rows' own numbers into parts of about the given rows, so that a task's memory is bounded
    whatever ids and vectors repeat. Each side is repeated once per block of the other: a stated query set against all rows.
    """
    nb, nq = blocks_for(base.count(), base_rows), blocks_for(queries.count(), query_rows)

    def dealt(d: DataFrame, own: int, other: int, first: bool) -> DataFrame:
        mine = F.pmod(mixed(F.col("row"), F.lit(4)), F.lit(own)).cast("int")
        d = d.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return d.withColumnsRenamed({"_mine": "_b", "_other": "_q"} if first else {"_mine": "_q", "_other": "_b"})

    left, right = dealt(base, nb, nq, True), dealt(queries, nq, nb, False)

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        return search(c, q)

    return left.groupBy("n", "_b", "_q").cogroup(right.groupBy("n", "_b", "_q")).applyInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, query_row: the k rows of highest score per query row, ties to the smaller vec_id."""
    w = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    d = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return d.select("query_id", "rank", "vec_id", "score", "query_row")
