"""Exact top-k search by Fagin's threshold algorithm.

The candidates of a block are held as one sorted list per dimension. A query walks all lists at once, from the top where
its component is positive and from the bottom where it is negative, scores every candidate it meets for the first time,
and stops as soon as the sum over the lists of (component * value at the current depth), which bounds every candidate
not met yet, is below the k-th score. Depth grows geometrically, so a round is a few array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import importable
from pricewell.llm.vectors import best, matrix, searched


class Lists:
    """The sorted per-dimension lists of a block of integer vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, own: np.ndarray):
        self.order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)  # (dimension, rank) -> row, rising
        self.values = np.ascontiguousarray(np.take_along_axis(rows.T, self.order.astype(np.int64), 1))
        self.rows, self.ids, self.own = np.ascontiguousarray(rows), ids, own

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest inner products, ties to the smaller id, the row numbered `own` left out."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.own == own
        got_ids, got = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        depth, step = 0, 32
        while depth < n:
            step = min(step, n - depth)
            met = np.zeros(n, bool)
            met[self.order[up, n - depth - step : n - depth]] = True
            met[self.order[down, depth : depth + step]] = True
            depth += step
            if not (up.size or down.size):
                met[:], depth = True, n  # all scores are 0
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            if new.size:
                got = np.concatenate([got, self.rows[new] @ query])
                got_ids = np.concatenate([got_ids, self.ids[new]])
                top = np.lexsort((got_ids, -got))[:k] if got.size > k else np.lexsort((got_ids, -got))
                got, got_ids = got[top], got_ids[top]
            if depth < n and got.size >= k:
                bound = query[up] @ self.values[up, n - depth] + query[down] @ self.values[down, depth - 1]
                if bound < got[-1]:
                    break
            step *= 2
        return got_ids, got


def integers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """Rows of valid() with components floor(scale * x)."""
    return vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (long), query_row of the k highest integer inner products, exact.

    Both inputs are rows of valid(), queries a part of vectors, with whole-numbered vec. A query's own row is left out; other
    rows of its id are candidates. Queries that share an id have a ranking each, told apart by query_row. A vector meets
    those of its length. Sums are exact in doubles up to 2^53; beyond that, and up to the range of long, Python integers are
    used; scores outside that range raise. An empty table gives no rows. A block's lists are sorted once for 8,192 queries.
    """
    importable(vectors.sparkSession)

    def one(c: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not c.num_rows or not q.num_rows:
            return schema.empty_table()
        x, y = matrix(c.column("vec")), matrix(q.column("vec"))
        if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] >= 2.0**53:
            x, y = (np.array([[int(v) for v in row] for row in m], object) for m in (x, y))
        lists = Lists(x, c.column("vec_id").to_numpy(), c.column("row").to_numpy())
        out = [(a, b, *lists.top(row, k, b)) for a, b, row in zip(q.column("vec_id").to_pylist(), q.column("row").to_pylist(), y, strict=True)]
        flat = [(a, b, int(i), int(s)) for a, b, ids, scores in out for i, s in zip(ids, scores, strict=True)]
        return pa.Table.from_arrays([pa.array([f[j] for f in flat], pa.int64()) for j in range(4)], schema=schema)

    found = searched(vectors, queries, one, "query_id long, query_row long, vec_id long, score long", 8_192, 8_192)
    return best(found, k)
