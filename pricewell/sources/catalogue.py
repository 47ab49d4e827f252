"""Catalogue cards to card and printing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.functions.rules import SKIPPED_LAYOUTS
from pricewell.sources.schemas import CATALOGUE_CARD


def read_catalogue(spark: SparkSession, path: str, lines: bool = False, pos: str | None = None) -> DataFrame:
    """Card objects of a JSON array, or of JSON lines, which many tasks can read.

    `pos` orders them by arrival: a field of that name where the landed objects carry one, else their place in the files.
    """
    reader = spark.read.schema(CATALOGUE_CARD + (f", {pos} BIGINT" if pos else "")).option("multiLine", not lines)
    return reader.json(path).withColumnRenamed(pos, "pos") if pos else reader.json(path).withColumn("pos", F.monotonically_increasing_id())


def read_array(spark: SparkSession, path: str, pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards, broken lines) of a JSON array that has its objects on lines of their own, or several to a line.

    Many tasks read one file, as its lines are split anywhere; the array's brackets and commas are taken off each line. A line
    that holds something else than whole objects, such as a piece of an object written over several lines, is in the second
    table: its text and file. An array written like that is for read_catalogue(), by one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_line"))
    bare = F.regexp_replace(F.regexp_replace("value", r"^[\s﻿]*\[?[\s,]*", ""), r"[\s,]*\]?\s*$", "")
    whole = f"array<struct<{CATALOGUE_CARD}" + (f", {pos} BIGINT>>" if pos else ">>")
    d = lines.withColumn("_bare", bare).filter("_bare <> ''").withColumn("_cards", F.from_json(F.concat(F.lit("["), "_bare", F.lit("]")), whole))
    sound = F.col("_bare").startswith("{") & F.col("_cards").isNotNull() & ~F.exists("_cards", lambda c: c.isNull())
    each = d.filter(F.coalesce(sound, F.lit(False))).select("_line", F.posexplode("_cards").alias("_place", "c"))
    cards = each.select("c.*").withColumnRenamed(pos, "pos") if pos else each.select("c.*", F.struct("_line", "_place").alias("pos"))
    return cards, d.filter(~F.coalesce(sound, F.lit(False))).select("file", F.col("value").alias("line"))


def needs_import(cards: DataFrame) -> bool:
    """Whether the stored catalogue is empty, as on a first run."""
    return cards.isEmpty()


def importable_card() -> Column:
    """Paper cards in English of a playable layout with an oracle id; null digital counts as paper."""
    return ~F.coalesce("digital", F.lit(False)) & (F.col("lang") == "en") & ~F.coalesce(F.col("layout").isin(SKIPPED_LAYOUTS), F.lit(False)) & (F.coalesce("oracle_id", F.lit("")) != "")


def image() -> Column:
    """The card's image, else its first face's; empty strings count as absent."""
    face = F.get("card_faces", F.lit(0))
    return F.coalesce(F.nullif(F.col("image_uris.normal"), F.lit("")), F.nullif(face["image_uris"]["normal"], F.lit("")))


def card_rows(catalogue: DataFrame) -> DataFrame:
    """One row per oracle id, of the first card with it."""
    first = F.row_number().over(W.partitionBy("oracle_id").orderBy("pos"))
    kept = catalogue.filter(importable_card()).withColumn("_n", first).filter("_n = 1")
    none = F.array().cast("array<string>")
    return kept.select(
        F.col("oracle_id").alias("id"), "name", "mana_cost", F.coalesce("type_line", F.lit("Unknown")).alias("type_line"), "oracle_text",
        F.coalesce("colors", none).alias("colors"), F.coalesce("color_identity", none).alias("color_identity"),
        F.coalesce("legalities", F.expr("cast(map() as map<string,string>)")).alias("legalities"),
    )


def printing_rows(catalogue: DataFrame) -> DataFrame:
    """One row per printing id, of the last finish with it (foil and etched share one)."""
    each = catalogue.filter(importable_card()).select("*", F.posexplode("finishes").alias("finish_pos", "finish"))
    foil = F.coalesce(F.col("finish").isin("foil", "etched"), F.lit(False))
    rows = each.select(
        F.when(foil, F.concat("id", F.lit("_foil"))).otherwise(F.col("id")).alias("id"), F.col("oracle_id").alias("card_id"), F.col("set").alias("set_code"), "set_name",
        F.coalesce(F.col("released_at").try_cast("date"), F.lit("1993-01-01").cast("date")).alias("released_at"), "collector_number", "rarity", foil.alias("is_foil"),
        image().alias("image_uri"), "scryfall_uri", F.when(foil, F.col("prices.usd_foil")).otherwise(F.col("prices.usd")).try_cast("decimal(12,2)").alias("usd_price"), "pos", "finish_pos",
    )
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("pos"), F.desc("finish_pos")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "pos", "finish_pos")
