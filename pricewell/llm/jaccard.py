"""N-gram Jaccard join with adaptive multi-match prefixes.

1. Every whole text becomes its set of 5-word shingles (64-bit hashes). Where each shingle of the corpus occurs once only,
   it cannot add to any overlap, and a document of which fewer than the threshold's share is shared by others can have no
   link: an exact count over all documents leaves the documents that may have one. Equal sets become one node.
2. Among the nodes, shingles are ordered from rare to frequent. Two sets can only reach the threshold if they share at
   least l of the first (size - least overlap + l) shingles in that order. Each document picks its own l: its estimated
   cost is the postings that such a prefix meets plus the verification of the candidates that l matches let through, so
   documents with costly prefixes get longer ones and need more matches; a pair needs the smaller l of the two.
3. Pairs are also held to the overlap that their sizes ask for, which neither side's count of shared shingles may miss.
4. In dense groups, documents are first verified against the most central document that they share prefix shingles with,
   and linked ones become components. All other pairs between different components are then counted and verified; pairs
   within a component need no check, as their documents are linked already. So components are exact, and no
   group of copies is expanded into all its pairs.

Verification counts the exact intersection. Sets are told apart by 64-bit hashes, of shingles and of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.common import dropped, importable, let_go, looked_up, scratch, stored
from pricewell.llm.shingles import U, in_chunks, set_keys, sets

#: Shingles that a task gathers before it deals them out, and documents (whose numbers fit 16 bits).
FLUSH, FLUSH_DOCS = 1_000_000, 60_000
NOBODY = 0xFFFF
BLOOM_BITS = 26
LONGEST = 8


def _deal(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Shingles dealt by their upper bits, one blob per group of documents and bucket, and a row on each group's documents.

    A shingle that two documents of the group share is known to be shared, and only its occurrence is dealt.
    """
    let_go()
    task, flush = TaskContext.get().partitionId(), 0
    names = ["bucket", "origin", "a", "b", "c", "d"]

    def row(bucket, origin, *blobs):
        return bucket, origin, *[x.tobytes() for x in blobs], *[b""] * (4 - len(blobs))

    def out(ids, tokens, counts):
        nonlocal flush
        origin = task << 24 | flush
        flush += 1
        per_doc = np.concatenate(counts)
        keys = np.concatenate([set_keys(t, c) for t, c in zip(tokens, counts, strict=True)])
        t = np.concatenate(tokens)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        order = np.argsort(t)
        t, doc = t[order], doc[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        begins = np.flatnonzero(new)
        several = np.diff(np.append(begins, len(t))) > 1
        local = np.bincount(doc[np.repeat(several, np.diff(np.append(begins, len(t))))], minlength=len(per_doc)) if len(t) else np.zeros(len(per_doc), np.int64)
        rows = [row(-1 - origin, origin, np.concatenate(ids), keys, per_doc.astype(np.int32), local.astype(np.int32))]
        one, who = t[begins], np.where(several, NOBODY, doc[begins]).astype(np.uint16)
        low = ((one << U(bits)) >> U(32)).astype(np.uint32)
        bucket = (one >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            rows.append(row(int(bucket[a]), origin, low[a:b], who[a:b]))
        for i in range(0, len(rows), 64):
            cols = list(zip(*rows[i : i + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names)

    ids, tokens, counts, n, docs = [], [], [], 0, 0
    for part in in_chunks(batches):
        t, c = sets(part.column(1))
        ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        tokens.append(t)
        counts.append(c)
        n, docs = n + len(t), docs + len(c)
        if n >= FLUSH or docs + 512 >= FLUSH_DOCS:
            yield from out(ids, tokens, counts)
            ids, tokens, counts, n, docs = [], [], [], 0, 0
    if docs:
        yield from out(ids, tokens, counts)


DEALT = "bucket long, origin long, a binary, b binary, c binary, d binary"


def _shared(t: pa.Table) -> pa.Table:
    """From one bucket, the documents of each group whose shingle occurs elsewhere too, one number per such shingle."""
    if t.num_rows and t.column("bucket")[0].as_py() < 0:
        return t
    origins = t.column("origin").to_numpy()
    blobs = [[np.frombuffer(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("a", np.uint32), ("b", np.uint16))]
    token, who = np.concatenate(blobs[0]), np.concatenate(blobs[1])
    which = np.repeat(np.arange(len(origins)), [len(x) for x in blobs[0]])
    order = np.argsort(token, kind="stable")
    token, who, which = token[order], who[order], which[order]
    same = np.zeros(len(token) + 1, bool)
    same[1:-1] = token[1:] == token[:-1]
    hit = (same[1:] | same[:-1]) & (who != NOBODY)
    who, which = who[hit], which[hit]
    order = np.argsort(which, kind="stable")
    who, ends = who[order], np.cumsum(np.bincount(which, minlength=len(origins)))
    out = [(int(o), who[a:b].tobytes()) for o, a, b in zip(origins, np.concatenate([[0], ends[:-1]]), ends, strict=True) if b > a]
    n, empty = len(out), [b""] * len(out)
    return pa.Table.from_arrays([pa.array([0] * n, pa.int64()), pa.array([o for o, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary()), *[pa.array(empty, pa.binary())] * 3], schema=t.schema)


def _counted(t: pa.Table) -> pa.Table:
    """doc_id, key, n, shared of a group's documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("shared", pa.int32())])
    head = [r for r in t.to_pylist() if r["bucket"] < 0]
    if not head:
        return schema.empty_table()
    h = head[0]
    n, shared = np.frombuffer(h["c"], np.int32), np.frombuffer(h["d"], np.int32).astype(np.int64)
    for bucket, blob in zip(t.column("bucket").to_pylist(), t.column("a").to_pylist(), strict=True):
        if bucket >= 0:
            shared = shared + np.bincount(np.frombuffer(blob, np.uint16), minlength=len(n))
    return pa.Table.from_arrays([pa.array(np.frombuffer(h["a"], np.int64)), pa.array(np.frombuffer(h["b"], np.int64)), pa.array(n), pa.array(shared.astype(np.int32))], schema=schema)


def shared_counts(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the set), n (its size), shared (how many of its shingles other documents have too).

    docs: doc_id long, text. Buckets of shingles hold about 2,000 documents' worth each, and a shingle sends a bucket one
    occurrence for each group of some thousand documents, however frequent it is. Within a bucket 32 bits tell shingles
    apart; two that meet count as shared, which leaves more candidates and loses none.
    """
    bits = max(0, (docs.count() // 2_000).bit_length())
    dealt = docs.mapInArrow(lambda it: _deal(it, bits), DEALT)
    return dealt.groupBy("bucket").applyInArrow(_shared, DEALT).groupBy("origin").applyInArrow(_counted, "doc_id long, key long, n int, shared int")


def _least(n, threshold: int):
    """Least overlap that a set of size n needs with any other: ceil(threshold % of n)."""
    return F.ceil(n * threshold / 100).cast("int")


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, shingles (array<long>) of the given nodes (column key), made again from the texts.

    A bit map of 2^BLOOM_BITS bits, 8 MB whatever the number of nodes, keeps most other documents' sets from being made
    into rows; a join with the nodes drops the rest.
    """
    spark = docs.sparkSession
    slot = F.col("key").bitwiseAND(F.lit((1 << BLOOM_BITS) - 1)) + 1
    parts = nodes.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for r in parts:
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        let_go()
        there = shared.value
        for part in in_chunks(batches):
            t, c = sets(part.column(0))
            keys = set_keys(t, c)
            at = keys & U((1 << BLOOM_BITS) - 1)
            hit = ((there[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).astype(bool) & (c > 0)
            rows = np.flatnonzero(hit)
            _, first = np.unique(keys[rows], return_index=True)
            rows = rows[np.sort(first)]
            if rows.size:
                keep = np.zeros(len(c), bool)
                keep[rows] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c[rows])]).astype(np.int32)), pa.array(t[np.repeat(keep, c)].view(np.int64)))], ["key", "shingles"])

    made = docs.select("text").mapInArrow(run, "key long, shingles array<long>")
    return made.join(nodes.select("key"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def prefixes(nodes: DataFrame, threshold: int = 75) -> DataFrame:
    """key, n, m (shingles that other nodes have too), l (matches asked for), kept (those m, rare first), prefix.

    nodes: key, shingles. Nodes that cannot reach the threshold any more are left out.
    """
    tokens = nodes.select("key", F.explode("shingles").alias("s"))
    df = tokens.groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    kept = tokens.join(df, "s").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked"))
    d = nodes.select("key", F.size("shingles").alias("n")).join(kept, "key").withColumn("m", F.size("ranked")).withColumn("t", _least(F.col("n"), threshold)).filter(F.col("m") >= F.col("t"))
    # cost of l against sets of the same size: postings met, plus a verification (about n) for each of the candidates left,
    # a quarter for each match more
    same = F.ceil(F.col("n") * 2 * threshold / (100 + threshold)).cast("int")
    met = lambda k: F.aggregate(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.col("m") - same + k)), F.lit(0.0), lambda a, x: a + x["df"] - 1)
    costs = F.array(*[F.struct((met(F.lit(k)) * (1 + F.col("n") * 0.25 ** (k - 1))).alias("cost"), F.lit(k).alias("l")) for k in (1, 2, 4, LONGEST)])
    fits = F.filter(costs, lambda c: c["l"] <= F.col("t"))
    d = d.withColumn("l", F.array_min(fits)["l"])
    return d.select("key", "n", "m", "l", F.transform("ranked", lambda x: x["s"]).alias("kept"), F.transform(F.slice("ranked", F.lit(1), F.col("m") - F.col("t") + F.col("l")), lambda x: x["s"]).alias("prefix"))


def _may_link(a: str, b: str, threshold: int):
    """The overlap that sizes na and nb need, threshold (na + nb) / (100 + threshold), is within both shared counts."""
    return (F.col(f"n{a}") + F.col(f"n{b}")) * threshold <= F.least(F.col(f"m{a}"), F.col(f"m{b}")) * (100 + threshold)


def _early(a: str, b: str, threshold: int):
    """Only places (from 0) that one of a linked pair's first l common shingles can have count: of an overlap of T or more,
    the l-th common one has T - l others after it on both sides."""
    least = F.ceil((F.col(f"n{a}") + F.col(f"n{b}")) * threshold / (100 + threshold)) - F.least(f"l{a}", f"l{b}")
    return (F.col(f"i{a}") < F.col(f"m{a}") - least) & (F.col(f"i{b}") < F.col(f"m{b}") - least)


def verified(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y) whose sets reach the threshold, with their overlap."""
    x = nodes.select(F.col("key").alias("x"), F.col("n").alias("nx"), F.col("kept").alias("sx"))
    y = nodes.select(F.col("key").alias("y"), F.col("n").alias("ny"), F.col("kept").alias("sy"))
    both = pairs.select("x", "y").join(x, "x").join(y, "y").withColumn("overlap", F.size(F.array_intersect("sx", "sy")))
    return both.filter(F.col("overlap") * 100 >= (F.col("nx") + F.col("ny") - F.col("overlap")) * threshold).select("x", "y", "overlap")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of the edges (x, y).

    Each round hooks every node to its smallest neighbour and contracts the edges, until none is left.
    """
    edges = stored(edges.select("x", "y").filter("x <> y"), "edges")
    to = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("comp")), "hooks")
        before, old = edges, to
        if to is None:
            to = stored(hook, "comps")
        else:
            h = hook.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            to = stored(to.join(h, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "comps")
        a, b = hook.select(F.col("node").alias("x"), F.col("comp").alias("cx")), hook.select(F.col("node").alias("y"), F.col("comp").alias("cy"))
        edges = stored(edges.join(a, "x").join(b, "y").filter("cx <> cy").select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).distinct(), "edges")
        dropped(before, old, hook)
    if to is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))
    dropped(edges)
    return to


def links(nodes: DataFrame, threshold: int = 75, stars: int = 2) -> DataFrame:
    """Links (x, y, overlap) that join all nodes of each component; nodes: a stored prefixes().

    Within a component not every link is listed; between components there is none.
    """
    with scratch(nodes.sparkSession) as kept:
        post = kept(nodes.select(F.col("key").alias("k"), "n", "m", "l", F.posexplode("prefix").alias("i", "s")), "postings")
        found = comps = None

        def labelled() -> DataFrame:
            if comps is None:
                return post.withColumn("c", F.col("k"))
            return post.join(comps, post["k"] == comps["node"], "left").select(*post.columns, F.coalesce("comp", "k").alias("c"))

        for _ in range(stars):
            p = kept(labelled(), "labelled")
            centre = p.groupBy("s").agg(F.min_by(F.struct("k", "n", "m", "c"), F.struct((F.col("n") - F.col("m")) / F.col("n"), "k")).alias("to"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("s", "to.*").withColumnsRenamed({"k": "k2", "n": "n2", "m": "m2", "c": "c2"})
            near = p.drop("i").withColumnsRenamed({"k": "k1", "n": "n1", "m": "m1", "c": "c1"}).join(centre, "s").filter((F.col("c1") != F.col("c2")) & _may_link("1", "2", threshold))
            votes = near.groupBy("k1", "k2").agg(F.count("*").alias("v")).groupBy("k1").agg(F.max_by("k2", F.struct("v", "k2")).alias("k2"))
            got = stored(verified(votes.select(F.col("k1").alias("x"), F.col("k2").alias("y")), nodes, threshold), "star-links")
            found = got if found is None else found.unionByName(got)
            old, comps = comps, components(found)
            dropped(p, old)
        p = kept(labelled(), "labelled")
        # the most frequent component of each shingle's documents meets the others only, not itself
        sizes = p.groupBy("s", "c").agg(F.count("*").alias("v"))
        main = sizes.groupBy("s").agg(F.max_by("c", F.struct("v", "c")).alias("main"), F.count("*").alias("cs")).filter("cs > 1")
        p = kept(p.join(main, "s").drop("cs"), "labelled")
        right = p.withColumnsRenamed({"k": "k2", "n": "n2", "m": "m2", "l": "l2", "c": "c2", "i": "i2"}).drop("main")
        left = p.filter("c <> main").withColumnsRenamed({"k": "k1", "n": "n1", "m": "m1", "l": "l1", "c": "c1", "i": "i1"})
        cross = left.join(right, "s").filter((F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("k1") < F.col("k2"))) & _may_link("1", "2", threshold) & _early("1", "2", threshold))
        pairs = cross.groupBy(F.least("k1", "k2").alias("x"), F.greatest("k1", "k2").alias("y")).agg(F.count("*").alias("v"), F.first(F.least("l1", "l2")).alias("l")).filter("v >= l")
        last = stored(verified(pairs, nodes, threshold), "cross-links")
        dropped(comps)
    return found.unionByName(last)


def members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """doc_id, key (a hash of the set, 0 of an empty one), n, comp, component_id (the smallest doc_id of comp) of every row with an id.

    comp tells components apart where ids repeat; it is null for texts without shingles, whose component_id is their own id.
    Labels are found for sets first, and reach the rows by look-ups that take sets and components of many rows by themselves.
    """
    spark = docs.sparkSession
    importable(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = stored(shared_counts(d.filter("doc_id is not null")).withColumn("key", F.nullif("key", F.lit(0).cast("long"))), "shared")
    with scratch(spark) as kept:
        nodes = kept(known.filter("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.max("shared").alias("shared"), F.count("*").alias("copies"), F.min("doc_id").alias("first")), "nodes")
        open_nodes = kept(nodes.filter(F.col("shared") >= _least(F.col("n"), threshold)).select("key"), "open-nodes")
        full = kept(node_sets(d.filter("doc_id is not null"), open_nodes), "sets")
        ready = kept(prefixes(full, threshold), "prefixes")
        dropped(full)
        found = links(ready, threshold)
        comps = components(found)
        dropped(ready)
        own = nodes.join(comps, nodes["key"] == comps["node"], "left").select("key", "copies", "first", "comp")
        linked = kept(own.filter("comp is not null"), "linked")
        firsts = kept(linked.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "firsts")
        alone = own.filter("comp is null").select("key", "copies", F.col("key").alias("comp"), F.col("first").alias("component_id"))
        named = looked_up(linked.select("key", "copies", "comp"), firsts, "comp", "size", linked.count(), ["component_id"])
        labels = stored(alone.unionByName(named), "labels")
        dropped(comps)
    out = looked_up(known.select("doc_id", "key", "n"), labels, "key", "copies", known.count(), ["comp", "component_id"])
    return out.select("doc_id", F.coalesce("key", F.lit(0).cast("long")).alias("key"), "n", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keyed(docs: DataFrame, text: str = "text", out: str = "_key") -> DataFrame:
    """docs with `out`, the key that members() gives the row's text; 0 for texts without shingles, null ones too.

    The other columns stay as they are; `out` must be none of them, as a ValueError says.
    """
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}")
    importable(docs.sparkSession)

    def run(batches):
        for part in in_chunks(batches):
            keys = set_keys(*sets(part.column(part.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys.view(np.int64))], [*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles (long), component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts have no shingles and no links. A text of fewer than 5 words has one shingle, all its words. A row
    with null id takes no part; its component_id is null. Rows that share an id each keep a row of their own.
    """
    out = members(docs, doc_id, text, threshold).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    nameless = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is null")
    return out.unionByName(nameless.select("doc_id", _n_shingles(nameless).alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _n_shingles(d: DataFrame):
    """Set size by column functions, for the rows without an id."""
    w = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(F.size(w) == 0, 0).when(F.size(w) < 5, 1).otherwise(F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, F.lit(5)), " "))))).cast("long")
