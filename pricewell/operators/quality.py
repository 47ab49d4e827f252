"""Reports on matches and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.7


def with_printing(matched: DataFrame, printings: DataFrame) -> DataFrame:
    """The matched printing's set and number, for borderless listings and those of low confidence."""
    p = printings.select(F.col("id").alias("printing_id"), F.col("set_code").alias("matched_set"), F.col("collector_number").alias("matched_number"))
    asked = F.col("printing_id").isNotNull() & (F.coalesce("is_borderless", F.lit(False)) | (F.col("confidence") < LOW_CONFIDENCE))
    return matched.withColumn("_asked", F.when(asked, F.col("printing_id"))).join(p.withColumnRenamed("printing_id", "_asked"), "_asked", "left").drop("_asked")


def borderless(matched: DataFrame, printings: DataFrame) -> DataFrame:
    return with_printing(matched.filter("is_borderless"), printings)


def low_confidence(matched: DataFrame, printings: DataFrame) -> DataFrame:
    return with_printing(matched.filter(F.col("printing_id").isNotNull() & (F.col("confidence") < LOW_CONFIDENCE) & ~F.coalesce("is_borderless", F.lit(False))), printings)


def unmatched(matched: DataFrame) -> DataFrame:
    """Distinct unmatched names and sets with their number of listings."""
    return matched.filter("match_type = 'unmatched'").groupBy("raw_name", "set_name").agg(F.count("*").alias("n"))


def summary(matched: DataFrame) -> DataFrame:
    """match_type, n, percent (1 decimal), place: most frequent first. The total is summed over the few grouped rows."""
    d = matched.groupBy("match_type").agg(F.count("*").alias("n"))
    percent = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1).cast("double")
    place = F.row_number().over(W.orderBy(F.desc("n"), "match_type"))
    return d.select("match_type", "n", percent.alias("percent"), place.alias("place")).orderBy("place")


def totals(matched: DataFrame) -> DataFrame:
    low = F.col("printing_id").isNotNull() & (F.col("confidence") < LOW_CONFIDENCE) & ~F.coalesce("is_borderless", F.lit(False))
    return matched.agg(F.count("*").alias("listings"), F.count_if(F.col("confidence") >= LOW_CONFIDENCE).alias("high_confidence"), F.count_if("is_borderless").alias("borderless"), F.count_if(low).alias("low_confidence"), F.count_if(F.col("match_type") == "unmatched").alias("unmatched"))


def feed_quality(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count("*").alias("listings"), F.count_if(F.coalesce("set_name", F.lit("")) != "").alias("with_set"), F.count_if("is_foil").alias("foil"), F.count_if("in_stock").alias("in_stock"))


def run_statistics(found: DataFrame, judged: DataFrame, matched: DataFrame, searched: DataFrame) -> DataFrame:
    """One row: fetched, duplicates, skipped, matched, unmatched, match_percent ('0' if none), searches, empty_searches.

    judged has one row for each item id of found, so that ids need not be told apart again.
    """
    parts = [
        found.agg(F.count("*").alias("fetched")),
        judged.agg(F.count("itemId").alias("_distinct"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped")),
        matched.agg(F.count_if(F.col("printing_id").isNotNull()).alias("matched"), F.count_if(F.col("printing_id").isNull()).alias("unmatched")),
        searched.agg(F.count("*").alias("searches"), F.count_if(F.col("n") == 0).alias("empty_searches")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    d = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    all_of = F.col("matched") + F.col("unmatched")
    return d.select("fetched", (F.col("fetched") - F.col("_distinct")).alias("duplicates"), "skipped", "matched", "unmatched", F.when(all_of > 0, F.format_number(F.col("matched") * 100.0 / all_of, 1)).otherwise("0").alias("match_percent"), "searches", "empty_searches")
