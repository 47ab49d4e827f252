"""Sharding by a k-d tree.

The tree splits the rows at weighted medians (by bytes) along the widest metadata dimension, until every leaf holds its
share: a node of m leaves is cut where floor(m/2)/m of its bytes lie below. A level costs one aggregation for the
dimensions' extents and a few histogram aggregations, each of a fixed number of bins per node, that close in on all
nodes' medians at once. The finished tree is a chain of comparisons that any row can evaluate alone.

Each dimension is a 62-bit code: its value in the upper 31 bits, a hash of the row in the lower 31, so that a cut may fall
inside a run of equal values of any size. The hash of repeated rows takes in their number, so that it may fall there too.
The law is near-equal bytes: a group of equal texts, which can hold more than a shard's share, is cut like any other run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import copies, dropped, mixed, prefix_sums, stored

TOP = (1 << 31) - 1
BINS = 1024


@dataclass
class Split:
    """Node `node` sends rows whose code in dimension `dim` is at most `cut` to node `low`, others to `high`."""

    node: int
    dim: int
    cut: int
    low: int
    high: int


@dataclass
class Tree:
    """leaves: node number -> shard number."""

    splits: list[Split]
    leaves: dict[int, int]

    def shard(self, codes: list[Column]) -> Column:
        by = {s.node: s for s in self.splits}

        def at(n: int) -> Column:
            s = by.get(n)
            return F.lit(self.leaves[n]) if s is None else F.when(codes[s.dim] <= s.cut, at(s.low)).otherwise(at(s.high))

        return at(1)


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def codes(doc_id: Column, text: Column, source: Column, lang: Column, copy: Column | None = None) -> list[Column]:
    """Dimensions: bytes, source, language. Nulls of names count as empty. copy: the row's number among rows alike, 0 if None."""
    values = [F.least(byte_size(text), F.lit(TOP).cast("long")), *[F.shiftright(mixed(F.lit(k), F.coalesce(c.cast("string"), F.lit(""))), 31) for k, c in enumerate((source, lang))]]
    return _coded(values, row_hash(doc_id, text), copy)


def row_hash(doc_id: Column, text: Column) -> Column:
    return mixed(F.lit(10), doc_id.cast("string"), text)


def _own(row: Column, copy: Column | None) -> Column:
    """The hash of one of several rows alike; the first keeps the plain one."""
    return row if copy is None else F.when(copy == 0, row).otherwise(mixed(row, copy))


def _coded(values: list[Column], row: Column, copy: Column | None) -> list[Column]:
    return [F.shiftleft(v, 31).bitwiseOR(F.shiftright(_own(row, copy), 31)) for v in values]


def grow(rows: DataFrame, dims: list[str], size: str, shards: int) -> Tree:
    """The tree for `shards` leaves over a stored table with code columns `dims` and a positive `size`.

    The driver holds a few numbers per node and histograms of at most BINS bins for each of at most `shards` nodes; what
    is broadcast has a row per node.
    """
    spark = rows.sparkSession
    tree, leaves, fresh, extents = Tree([], {}), {1: shards}, 2, {}
    d = rows.select(*dims, size, F.lit(1).alias("_node"))
    before = None
    while any(m > 1 for m in leaves.values()):
        open_nodes = {n: m for n, m in leaves.items() if m > 1}
        got = {r["_node"]: r for r in d.groupBy("_node").agg(F.sum(size).alias("s"), *[f(c).alias(f"{n}{k}") for k, c in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        extents = extents or {k: max([1, *(r[f"hi{k}"] - r[f"lo{k}"] for r in got.values())]) for k in range(len(dims))}
        # per open node: dimension, code range that holds the median, bytes below that range, bytes wanted up to the cut
        look: dict[int, list] = {n: [0, 0, 0, 0, 0.0] for n in open_nodes}
        for n in open_nodes.keys() & got.keys():
            r, m = got[n], open_nodes[n]
            k = max(range(len(dims)), key=lambda j: ((r[f"hi{j}"] - r[f"lo{j}"]) / extents[j], -j))
            look[n] = [k, r[f"lo{k}"], r[f"hi{k}"], 0, r["s"] * (m // 2) / m]
        while todo := {n: x for n, x in look.items() if x[1] < x[2]}:
            asked = spark.createDataFrame([(n, x[0] + 1, x[1], x[2], (x[2] - x[1]) // BINS + 1) for n, x in todo.items()], "_node int, _k int, _l long, _h long, _w long")
            near = d.join(F.broadcast(asked), "_node").withColumn("_c", F.element_at(F.array(*dims), F.col("_k"))).filter(F.col("_c").between(F.col("_l"), F.col("_h")))
            bins: dict[int, list] = {}
            for r in near.groupBy("_node", F.expr("(_c - _l) div _w").alias("_b")).agg(F.sum(size).alias("s"), F.min("_c").alias("lo"), F.max("_c").alias("hi")).collect():
                bins.setdefault(r["_node"], []).append((r["_b"], r["s"], r["lo"], r["hi"]))
            for n, x in todo.items():
                below, found = x[3], sorted(bins[n])
                for b, s, lo, hi in found:
                    if below + s > x[4] or b == found[-1][0]:  # the cut lies in this bin
                        if lo == hi:  # a single code goes to the nearer side
                            cut = lo if abs(below + s - x[4]) <= abs(below - x[4]) else lo - 1
                            x[1:4] = [cut, cut, below]
                        else:
                            x[1:4] = [lo, hi, below]
                        break
                    below += s
        level = []
        for n, m in open_nodes.items():
            level.append(Split(n, look[n][0], look[n][1], fresh, fresh + 1))
            del leaves[n]
            leaves[fresh], leaves[fresh + 1] = m // 2, m - m // 2
            fresh += 2
        tree.splits += level
        cuts = spark.createDataFrame([(s.node, s.dim + 1, s.cut, s.low, s.high) for s in level], "_node int, _k int, _cut long, _low int, _high int")
        moved = d.join(F.broadcast(cuts), "_node", "left")
        d = stored(moved.select(*dims, size, F.when(F.col("_k").isNull(), F.col("_node")).when(F.element_at(F.array(*dims), F.coalesce("_k", F.lit(1))) <= F.col("_cut"), F.col("_low")).otherwise(F.col("_high")).alias("_node")), "kd-level")
        dropped(before)
        before = d
    dropped(before)
    tree.leaves = {n: k for k, n in enumerate(leaves)}
    return tree


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> tuple[DataFrame, Tree]:
    """(doc_id, size, text_crc32, shard, slot) of every row, and the tree.

    size is the text's UTF-8 bytes plus 16. Bytes per shard are near equal, whatever rows and texts repeat. Slots count from
    0 without gaps within a shard. A null text has no bytes and the crc of the empty text. Other columns of docs are left
    out, and an empty table gives no rows.
    """
    whole = codes(F.col(doc_id), F.col(text), F.col(source), F.col(lang))
    values = [F.shiftright(c, 31).alias(f"_v{k}") for k, c in enumerate(whole)]
    d = docs.select(F.col(doc_id).alias("doc_id"), byte_size(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), row_hash(F.col(doc_id), F.col(text)).alias("_row"), *values, F.spark_partition_id().alias("_part"))
    first = stored(d, "shards")
    numbered = copies(first, "_row")
    copy = F.col("_copy")
    made = numbered.select("doc_id", "size", "text_crc32", mixed(_own(F.col("_row"), copy)).alias("_key"), *[c.alias(f"_d{k}") for k, c in enumerate(_coded([F.col(f"_v{k}") for k in range(3)], F.col("_row"), copy))])
    d = stored(made, "shards")
    dropped(first)
    dims = ["_d0", "_d1", "_d2"]
    tree = grow(d, dims, "size", shards)
    placed = d.select("doc_id", "size", "text_crc32", "_key", tree.shard([F.col(c) for c in dims]).alias("shard"), F.lit(1).cast("long").alias("_one"))
    numbered = prefix_sums(placed, ["shard"], "_key", ["doc_id", "text_crc32"], "_one", "slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot")), tree
