"""Mixing sources to target weights.

Every row gets a hash-random key; within each source the rows are sorted by it, distributed prefix sums of the sizes are
taken, and the source is cut where its budget ends. A budget of more than the source's size takes whole epochs first.
The cut is then closed: the rows past it with the largest size that still fits are added, a few times over. Rows alike
in id, text and source share a key, and a cut may fall between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.llm.common import copies, mixed, prefix_sums, scratch, stored, words_in

SEED = 9


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target of a table with one row per source.

    Sources by code point, null last, weigh `weights`, repeating, and share the sum of all sizes. A target stops at
    `most` times the source's size; the excess goes to the others by weight, until none is above. That fixed point is
    found at once: taking sources as capped by rising cap/weight, the level (what is left over the weights that are left)
    rises up to the last source that is above its cap and falls after it, so its maximum is the level of the rest. Runs on rows of one per source only.
    """
    s = sizes.select(F.col(source).alias("source"), F.col(size).cast("double").alias("_size"))
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("_size") * most)
    everything = W.partitionBy()
    by = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_level", (F.sum("_size").over(everything) - F.coalesce(F.sum("_cap").over(by), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by), F.lit(0.0))))
    level = F.max("_level").over(everything)
    s = s.withColumn("_at", level)
    return s.select("source", F.col("_size").cast("long").alias("source_size"), F.least(F.col("_cap"), F.col("_at") * F.col("_w")).alias("target"))


def row_key(doc_id: Column, text: Column) -> Column:
    return mixed(F.lit(SEED), doc_id.cast("string"), text)


def _with(plan: DataFrame, more: DataFrame, *columns: str) -> DataFrame:
    """plan with the columns of one row per source of `more`, null where it has none."""
    m = more.select(F.col("source").alias("_s"), *columns)
    return plan.join(m, plan["source"].eqNullSafe(m["_s"]), "left").drop("_s")


def cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), closing: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, epochs, cut, extra.

    All rows with a key up to `cut` are taken once more than `epochs` says. extra: array of (key, n, of), keys beyond the
    cut of whose `of` rows n are taken once more.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        rows = kept(docs.select(F.col(source).alias("source"), words_in(F.col(text)).alias("size"), row_key(F.col(doc_id), F.col(text)).alias("key")), "mix")
        plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights)
        plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        plan = kept(plan.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")

        grouped = kept(rows.groupBy("source", "key").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.sum("size").alias("all")), "mix-keys")
        running = kept(prefix_sums(grouped, ["source"], "key", [], "all", "upto"), "mix-sums")
        inside = _with(running, plan, "_rest").filter(F.col("upto") <= F.col("_rest"))
        plan = _with(plan, inside.groupBy("source").agg(F.max("key").alias("cut"), F.max("upto").alias("got")), "cut", "got")
        extra = F.array().cast("array<struct<key:bigint,n:bigint,of:bigint>>").alias("extra")
        plan = plan.select("source", "source_size", "target", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut"), (F.col("_rest") - F.coalesce("got", F.lit(0))).alias("gap"), extra)
        for _ in range(closing):
            plan = kept(plan, "mix-plan")
            fit = F.least(F.col("n"), F.floor(F.col("gap") / F.col("size")))
            rest = _with(running, plan, "cut", "gap", "extra").filter((F.col("key") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~F.exists("extra", lambda x: x["key"] == F.col("key")))
            best = rest.groupBy("source").agg(F.max(F.struct((fit * F.col("size")).alias("words"), "key", fit.alias("n"), F.col("n").alias("of"))).alias("_add"))
            plan = _with(plan, best, "_add")
            plan = plan.withColumn("extra", F.when(F.col("_add").isNotNull(), F.concat("extra", F.array(F.struct("_add.key", "_add.n", "_add.of")))).otherwise(F.col("extra"))).withColumn("gap", F.col("gap") - F.coalesce(F.col("_add.words"), F.lit(0))).drop("_add")
        return stored(plan, "mix-plan")


def mix(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs plus _copies (0 to 3: how often the mix takes the row), _size, _source_size and _target.

    Nulls count as empty text, as an id of their own and as a source of their own. Columns of docs of those four names are
    replaced. The plan has one row per source; Spark broadcasts it where its size on disk is under the session's threshold.
    Rows of a key of which only some are taken, at most a few keys per source, are numbered first (copies()).
    """
    ours = ["_copies", "_size", "_source_size", "_target"]
    d = docs.drop(*ours)
    p = plan.select(F.col("source").alias("_mix_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("epochs").alias("_mix_epochs"), F.col("cut").alias("_mix_cut"), F.col("extra").alias("_mix_extra"))
    joined = d.withColumn("_mix_key", row_key(d[doc_id], d[text])).withColumn("_size", words_in(d[text])).join(p, d[source].eqNullSafe(p["_mix_s"]), "left")
    mine = F.get(F.filter("_mix_extra", lambda x: x["key"] == F.col("_mix_key")), F.lit(0))
    joined = joined.withColumns({"_mix_n": mine["n"], "_mix_of": mine["of"]})
    some = F.coalesce(F.col("_mix_n") < F.col("_mix_of"), F.lit(False))

    def taken(df: DataFrame, more: Column) -> DataFrame:
        return df.select(*d.columns, (F.col("_mix_epochs") + F.when(F.col("_mix_epochs") < 3, more.cast("int")).otherwise(0)).cast("int").alias("_copies"), *ours[1:])

    whole = (F.col("_mix_key") <= F.col("_mix_cut")) | F.col("_mix_n").isNotNull()
    if plan.filter(F.exists("extra", lambda x: x["n"] < x["of"])).isEmpty():
        return taken(joined, whole)
    part = stored(joined.filter(some).withColumn("_part", F.spark_partition_id()).withColumn("_mix_group", mixed(F.col(source), F.col("_mix_key"))), "mix-parted")
    return taken(joined.filter(~some), whole).unionByName(taken(copies(part, "_mix_group", "_mix_copy"), F.col("_mix_copy") < F.col("_mix_n")))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **knobs) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns as they are, whatever these are called.

    Null ids, texts (of size 0) and sources (a source of their own) are as in mix(); an empty table gives no rows.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no column has one of the names that are used on the way
    at = {k: f"c{names.index(c)}" for k, c in (("doc_id", doc_id), ("text", text), ("source", source))}
    rows = mix(plain, cuts(plain, **at, **knobs), **at).filter("_copies > 0")
    return rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*plain.columns).toDF(*names)
