"""Changes of stored tables as new snapshots, and their integrity report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replace_store(existing: DataFrame, new: DataFrame, stores: DataFrame) -> DataFrame:
    """Without the rows of `stores` (column store_id), plus the new rows; an empty batch still clears its store."""
    return existing.join(stores.select("store_id").distinct(), "store_id", "left_anti").select(*existing.columns).unionByName(new, allowMissingColumns=True)


HISTORY_KEY = ["printing_id", "store_id", "price_type", "recorded_at"]


def of_days(history: DataFrame, days: tuple[str, str] | None) -> DataFrame:
    """The rows of the days from the first to the last; with recorded_month in the layout, only their months' folders are read."""
    if days is None:
        return history
    first, last = (F.lit(d).cast("date") for d in days)
    h = history.filter(F.col("recorded_at").between(first, last))
    return h.filter(F.col("recorded_month").between(days[0][:7], days[1][:7])) if "recorded_month" in history.columns else h


def new_history(existing: DataFrame, batch: DataFrame, days: tuple[str, str] | None = None) -> DataFrame:
    """The batch's rows to append: the first by listing_seq of each key that the history doesn't have.

    days: the first and last day that the batch may hold; the history is read for those only. None: all of it.
    """
    n = F.row_number().over(W.partitionBy(*HISTORY_KEY).orderBy("listing_seq", "price_aud"))
    first = of_days(batch, days).withColumn("_n", n).filter("_n = 1").select(*HISTORY_KEY, "price_aud")
    return first.join(of_days(existing, days).select(*HISTORY_KEY), HISTORY_KEY, "left_anti")


def append_history(existing: DataFrame, batch: DataFrame, days: tuple[str, str] | None = None) -> DataFrame:
    return existing.unionByName(new_history(existing, batch, days).select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], refresh: list[str] | None = None) -> DataFrame:
    """existing with the rows of new; on a shared key only the `refresh` columns (all by default) take new values."""
    refresh = [c for c in new.columns if c not in key] if refresh is None else refresh
    o = existing.withColumn("_old", F.lit(True)).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    d = o.join(n, key, "full_outer")

    def value(c: str):
        if c not in new.columns:
            return F.col(f"o.{c}")
        first, second = (f"n.{c}", f"o.{c}") if c in refresh else (f"o.{c}", f"n.{c}")
        mark = "n._new" if c in refresh else "o._old"
        return F.when(F.col(mark), F.col(first)).otherwise(F.col(second))

    return d.select(*[F.col(c) if c in key else value(c).alias(c) for c in existing.columns])


#: Columns that a known printing takes from the catalogue; the others stay as first seen.
PRINTING_REFRESH = ["released_at", "usd_price", "updated_at"]
STORE_REFRESH = ["name", "base_url", "scraper_enabled"]
LOG_REFRESH = ["last_searched_at", "last_result_count"]


def clear_cards(prices: DataFrame, printings: DataFrame, cards: DataFrame, searched: DataFrame, store_id: str) -> DataFrame:
    """prices without the store's rows for printings of the searched card names (column card_name)."""
    gone = cards.join(searched.select(F.col("card_name").alias("name")).distinct(), "name", "left_semi").select(F.col("id").alias("card_id"))
    gone = printings.join(gone, "card_id", "left_semi").select(F.col("id").alias("printing_id"), F.lit(store_id).alias("store_id"))
    return prices.join(gone, ["printing_id", "store_id"], "left_anti").select(*prices.columns)


def by_month(history: DataFrame) -> DataFrame:
    return history.withColumn("recorded_month", F.date_format("recorded_at", "yyyy-MM"))


def retained(history: DataFrame, as_of: str, years: int = 2) -> DataFrame:
    """History of the last years; with recorded_month in the layout, whole months are pruned."""
    first = F.add_months(F.lit(as_of).cast("date"), -12 * years)
    d = by_month(history) if "recorded_month" not in history.columns else history
    return d.filter((F.col("recorded_month") >= F.date_format(first, "yyyy-MM")) & (F.col("recorded_at") >= first))


def write_history(history: DataFrame, path: str, mode: str = "append", spread: bool = True) -> None:
    """By month; a month of many rows is written by several tasks, small ones share a task (Spark splits by size at run time).

    spread: False for rows of one month that are dealt evenly; they are written where they are, without another shuffle.
    """
    d = by_month(history)
    (d.hint("rebalance", "recorded_month") if spread else d).write.mode(mode).partitionBy("recorded_month").parquet(path)


def publish(df: DataFrame, root: str, name: str, compression: str = "snappy") -> DataFrame:
    """The table written to a snapshot folder of its own and read back; readers move to it once it is whole."""
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The stored tables' rules: key, columns that may not be null, references (column to table).
RULES = {
    "cards": (["id"], ["id", "name", "type_line"], {}),
    "printings": (["id"], ["id", "card_id", "set_code", "released_at"], {"card_id": "cards"}),
    "stores": (["id"], [], {}),
    "store_prices": ([], ["printing_id", "store_id", "price_aud", "price_type"], {"printing_id": "printings", "store_id": "stores"}),
    "price_history": (HISTORY_KEY, [], {"printing_id": "printings", "store_id": "stores"}),
}


def flagged(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per key of the table (per references, where it has no key) with the rows that break each rule: `duplicate key`, ...

    One pass. Where the key has the references, rows are counted by key first and what is left of them meets the ids that it
    refers to; else each row does before it is counted.
    """
    key, required, references = RULES[name]
    by = key or list(references)
    first = set(references) <= set(by)
    d = tables[name]
    missing = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in required]
    lost = [f"orphan {c}" for c in references]
    if first:
        d = d.groupBy(*by).agg(F.count("*").alias("_rows"), *missing)
    for column, parent in references.items():
        ids = tables[parent].select(F.col("id").alias(column)).filter(F.col(column).isNotNull()).distinct().withColumn("_there", F.lit(True))
        d = d.join(ids, column, "left").withColumn(f"orphan {column}", F.when(F.col(column).isNotNull() & F.col("_there").isNull(), F.col("_rows") if first else F.lit(1)).otherwise(0)).drop("_there")
    if not first:
        d = d.groupBy(*by).agg(F.count("*").alias("_rows"), *missing, *[F.sum(f"`{c}`").alias(c) for c in lost])
    return d.withColumn("duplicate key", (F.col("_rows") > 1).cast("long")) if key else d


def rules(name: str) -> list[str]:
    key, required, references = RULES[name]
    return ["duplicate key"] * bool(key) + [f"orphan {c}" for c in references] + [f"null {c}" for c in required]


def broken(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule, key (as JSON), n of what breaks a rule: a key that is there twice, or n rows with a null or lost reference."""
    d = flagged(name, tables)
    key, _, references = RULES[name]
    by = key or list(references)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").cast("long").alias("n")) for r in rules(name)])).alias("x")
    as_json = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    return d.select(as_json.alias("key"), each).filter("x.n > 0").select(F.lit(name).alias("table"), "x.rule", "key", "x.n")


def quarantine(tables: dict[str, DataFrame]) -> DataFrame:
    """broken() of all tables that are given and whose references are there."""
    out = None
    for name in RULES:
        if name in tables and all(p in tables for p in RULES[name][2].values()):
            out = broken(name, tables) if out is None else out.unionByName(broken(name, tables))
    return out


def integrity(cards: DataFrame, printings: DataFrame, stores: DataFrame, prices: DataFrame, history: DataFrame) -> DataFrame:
    """table, rule, n: broken keys, references and nulls of the stored tables, 0 where all is well.

    Each table is read once for its own rules, and its ids once for each table that refers to it. What is broken is counted
    by one aggregation over all tables.
    """
    tables = {"cards": cards, "printings": printings, "stores": stores, "store_prices": prices, "price_history": history}
    kept = [(name, rule) for name in RULES for rule in rules(name)]
    all_rules = cards.sparkSession.createDataFrame(kept, "`table` string, rule string")
    found = quarantine(tables).select("table", "rule", "n").unionByName(all_rules.withColumn("n", F.lit(0).cast("long")))
    return found.groupBy("table", "rule").agg(F.sum("n").alias("n"))
