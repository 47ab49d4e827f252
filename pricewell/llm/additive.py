"""Approximate nearest neighbours by additive quantisation.

A vector is stored as the sum of one codeword from each of `books` codebooks, every codeword of full dimension, plus the
squared norm of that sum. Codebooks start as k-means of the residuals left by those before and are then refitted
together by least squares. Encoding keeps the `beam` best partial sums after each codebook. A query makes a table of its
inner products with all codewords, scores every code by table lookups, and the best `rerank` share of each block is
scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import importable, stored
from pricewell.llm.vectors import best, matrix, searched


@dataclass
class Codebooks:
    """words: (books, size, dimension), float32."""

    words: np.ndarray
    beam: int = 4

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) and squared norms of the sums, by beam search over the residuals."""
        n, d = x.shape
        books, size, _ = self.words.shape
        codes = np.zeros((n, 1, books), np.uint8)
        rest = x.astype(np.float32)[:, None, :]
        loss = np.zeros((n, 1), np.float32)  # squared residual less that of the vector itself
        for m in range(books):
            w = self.words[m]
            b = rest.shape[1]
            gain = (loss[:, :, None] + (w * w).sum(1)[None, None, :] - 2 * (rest.reshape(-1, d) @ w.T).reshape(n, b, size)).reshape(n, -1)
            keep = min(self.beam if m < books - 1 else 1, gain.shape[1])
            top = np.argpartition(gain, keep - 1, axis=1)[:, :keep] if keep < gain.shape[1] else np.argsort(gain, axis=1)
            loss = np.take_along_axis(gain, top, 1)
            came, word = top // size, top % size
            rest = np.take_along_axis(rest, came[:, :, None], 1) - w[word]
            codes = np.take_along_axis(codes, came[:, :, None], 1)
            codes[:, :, m] = word
        final = codes[:, 0, :]
        return final, (self.sums(final) ** 2).sum(1)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for m in range(self.words.shape[0]):
            out += self.words[m][codes[:, m]]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(books, size, queries): inner products of all codewords with all queries."""
        return self.words @ q.astype(np.float32).T


def _means(x: np.ndarray, size: int, rounds: int, rng) -> np.ndarray:
    """k-means centres; with fewer rows than centres, rows are repeated."""
    c = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        at = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        count = np.bincount(at, minlength=size)
        for k in range(x.shape[1]):
            c[:, k] = np.where(count > 0, np.bincount(at, x[:, k], size) / np.maximum(count, 1), c[:, k])
    return c


def train(x: np.ndarray, books: int, size: int, beam: int = 4, rounds: int = 6, refits: int = 2, seed: int = 4) -> Codebooks:
    """Codebooks from sample rows x."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    made, rest = [], x.copy()
    for _ in range(books):
        c = _means(rest, size, rounds, rng).astype(np.float32)
        rest -= c[np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)]
        made.append(c)
    out = Codebooks(np.stack(made), beam)
    total = books * size
    for _ in range(refits):  # all codewords together: ridge regression of the rows on their codes
        at = out.encode(x)[0].astype(np.int64) + np.arange(books) * size
        gram = np.zeros(total * total)
        for a in range(books):
            for b in range(books):
                gram += np.bincount(at[:, a] * total + at[:, b], minlength=total * total)
        target = np.stack([np.bincount(at.ravel(), np.repeat(x[:, k], books), total) for k in range(x.shape[1])], 1)
        ridge = 0.1
        solved = np.linalg.solve(gram.reshape(total, total) + ridge * np.eye(total), target + ridge * out.words.reshape(total, -1))
        out = Codebooks(solved.reshape(books, size, -1).astype(np.float32), beam)
    return out


#: Lengths of fewer rows are compared exactly, without codes, where no other number is asked for: none.
LEAST_ROWS = 0


def fit(vectors: DataFrame, books: int = 16, size: int = 64, max_rows: int = 16_000, beam: int = 4, exact_under: int | None = None) -> dict[int, Codebooks]:
    """Codebooks by vector length, each from about max_rows rows of valid() at most, taken by the hash of the row.

    A length of few rows has codebooks of fewer words, an eighth of its rows but two at least. Lengths of fewer than
    exact_under rows (LEAST_ROWS by default) have no codebooks and are compared exactly; an empty table gives none.
    """
    out, least = {}, LEAST_ROWS if exact_under is None else exact_under
    for r in vectors.groupBy("n").count().filter(F.col("count") >= least).orderBy("n").collect():
        share = min(1.0, max_rows / r["count"])
        mine = vectors.filter((F.col("n") == r["n"]) & (F.pmod(F.col("row"), F.lit(1 << 30)) < int(share * (1 << 30))))
        got = mine.select("row", "vec").toArrow().sort_by("row")
        if got.num_rows:
            out[r["n"]] = train(matrix(got.column("vec")), books, min(size, max(2, r["count"] // 8)), beam)
    return out


def index(vectors: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """The rows of valid() with codes (binary, a byte per codebook) and norm; null where their length has no codebooks."""
    spark = vectors.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(books)
    rest = vectors.filter(~F.col("n").isin(list(books))) if books else vectors
    out = rest.select("vec_id", "vec", "n", "row", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"))
    for n in books:

        def run(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    codes, norms = shared.value[n].encode(matrix(part.column(1)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], [*part.schema.names, "codes", "norm"])

        mine = vectors.filter(F.col("n") == n).select("vec_id", "vec", "n", "row")
        out = out.unionByName(mine.mapInArrow(run, "vec_id long, vec array<double>, n int, row long, codes binary, norm float"))
    return out


def search(indexed: DataFrame, queries: DataFrame, books: dict[int, Codebooks], k: int = 20, metric: str = "ip", rerank: float = 0.06) -> DataFrame:
    """query_id, rank, vec_id, score, query_row of each query's k nearest found.

    queries: rows of valid(). A query's own row is left out; other rows of its id are candidates. Queries that share an id
    have a ranking each, told apart by query_row. A vector meets those of its length, as others have no inner product with
    it. metric "ip" scores by inner product, "l2" by negative squared distance (which uses the stored norms). In each block
    of candidates the best max(8 k, rerank * rows) by table lookup are scored exactly; `rerank` is the search's depth, the
    one knob between speed and recall.
    """
    spark = indexed.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(books)

    def one(c: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not c.num_rows or not q.num_rows:
            return schema.empty_table()
        x, y = matrix(c.column("vec")), matrix(q.column("vec"))
        ids, own, asked, asking = (t.column(name).to_numpy() for t, name in ((c, "vec_id"), (c, "row"), (q, "vec_id"), (q, "row")))
        b = shared.value.get(x.shape[1])
        depth = c.num_rows
        if b is not None:
            codes = np.frombuffer(b"".join(c.column("codes").to_pylist()), np.uint8).reshape(c.num_rows, -1)
            norms = c.column("norm").to_numpy()
            depth = min(c.num_rows, max(8 * k, int(np.ceil(rerank * c.num_rows))) + 1)
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(y), 128):
            some = y[i : i + 128]
            if b is not None:
                tables = b.tables(some)
                near = np.zeros((len(ids), len(some)), np.float32)
                for m in range(len(tables)):
                    near += tables[m][codes[:, m]]
                if metric == "l2":
                    near = 2 * near - norms[:, None]
                near = np.ascontiguousarray(near.T)
            for j, query in enumerate(some):
                at = np.argpartition(near[j], len(ids) - depth)[len(ids) - depth :] if depth < len(ids) else np.arange(len(ids))
                at = at[own[at] != asking[i + j]]
                exact = np.einsum("nd,d->n", x[at], query) if metric == "ip" else -((x[at] - query) ** 2).sum(1)
                top = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(top.size, asked[i + j]), np.full(top.size, asking[i + j]), ids[at][top], exact[top]))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in range(4)], schema=schema)

    found = searched(indexed, queries.select("vec_id", "vec", "n", "row"), one, "query_id long, query_row long, vec_id long, score double")
    return best(found, k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, **knobs) -> DataFrame:
    """fit(), index() and search() in one; an empty table gives no rows. Both inputs are rows of valid()."""
    books = fit(vectors, **knobs)
    return search(stored(index(vectors, books), "aq-index"), queries, books, k)
