"""Tables that are read together, stored by one shared key: joins and groups on it need no shuffle.

All tables of a store lie in buckets of the same key and number, sorted within a bucket, with Bloom filters on ids. A join on
the key and further columns, and a group by these, takes a bucket of each table in one task; a filter on the key opens one
bucket, and one on an id with a Bloom filter the row groups that may hold it.

A bucket is one task's, so keys of too many rows don't go there: a key that holds more than a bucket's even share in any of
the tables, and over `least` rows, is hot in all of them. Its rows, and rows without a key, lie in files of even size beside
the buckets, and each_part() works on them by the usual shuffles. No row is in both parts, and no key, so what is worked out
key by key is the union of the two. There are at most as many hot keys as buckets for each table.

A store is a copy of other tables for reading: store() writes a whole new generation, and a numbered manifest, put there by
renaming, moves readers to it. Who reads the one before goes on until clean().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell import storage
from pricewell.operators.published import Conflict


@dataclass(frozen=True)
class Layout:
    """Columns by which rows are sorted behind the key, columns with a Bloom filter, further options of the Parquet writer.

    lent: the table got the key for its place only, so each_part() gives its hot rows without; those of no known key keep
    their partners by their own ids.
    """

    sort: tuple[str, ...] = ()
    blooms: tuple[str, ...] = ()
    lent: bool = False
    options: tuple[tuple[str, str], ...] = ()

    def written(self) -> dict[str, str]:
        return dict(self.options) | {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.blooms}


def _quoted(names: list[str] | tuple[str, ...]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


@dataclass(frozen=True)
class Clustered:
    """buckets: about the largest table's bytes over 256 MB; least: rows below which no key is hot, as a task takes them anyway."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    least: int = 100_000

    @cached_property
    def session(self) -> SparkSession:
        """Where the tables are read: a session with the caller's settings but one, so that a join on the key and more columns uses the buckets."""
        made = self.spark.newSession()
        for name, value in self.spark.conf.getAll.items():
            if self.spark.conf.isModifiable(name):
                made.conf.set(name, value)
        made.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return made

    def _hot(self, tables: dict[str, tuple[DataFrame, Layout]]) -> DataFrame:
        """The key of hot groups, once each."""
        found = []
        for name, (df, _) in tables.items():
            path = storage.fresh_path(self.spark, f"{name}-sizes")
            df.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.count("*").alias("_n")).write.parquet(path)
            sizes = self.spark.read.parquet(path)
            rows = sizes.agg(F.sum("_n")).first()[0] or 0
            found.append(sizes.filter(F.col("_n") > max(rows / self.buckets, self.least)).select(self.key))
        path = storage.fresh_path(self.spark, "hot")
        reduce(DataFrame.union, found).distinct().write.parquet(path)
        return self.spark.read.parquet(path)

    def store(self, tables: dict[str, tuple[DataFrame, Layout]]) -> int:
        """Writes a generation of all tables, each with a column of the key's name and type; gives its number. Its rows are those given, whole."""
        base, name = self._last(), uuid.uuid4().hex
        hot = self._hot(tables)
        made = {"name": name, "key": self.key, "buckets": self.buckets, "tables": {}, "hot": []}
        for table, (df, layout) in tables.items():
            made["tables"][table] = {
                "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields], "sort": [self.key, *layout.sort], "options": layout.written(), "lent": layout.lent,
            }
        for table, (df, _) in tables.items():
            flag, columns = "_hot", [F.col(_quoted([c])) for c in df.columns]
            while flag in df.columns:
                flag += "_"
            # at most `buckets` keys for each table
            marked = df.join(F.broadcast(hot.withColumn(flag, F.lit(True))), self.key, "left").withColumn(flag, F.coalesce(flag, F.col(self.key).isNull()))
            even = marked.filter(~F.col(flag)).select(*columns)
            even.repartition(self.buckets, self.key).write.insertInto(self._attached(self.spark, made, table))
            aside = f"{self.path}/data/{name}/hot/{table}"
            marked.filter(flag).select(*columns).hint("rebalance").write.options(**made["tables"][table]["options"]).parquet(aside)
            if not self.spark.read.parquet(aside).isEmpty():
                made["hot"].append(table)
        if not storage.put_once(self.spark, f"{self.path}/manifest/{base + 1:010d}.json", json.dumps(made, sort_keys=True)):
            raise Conflict(f"generation {base + 1} of {self.path} is there already")
        return base + 1

    def _manifests(self) -> list[str]:
        return sorted(n for n, _, _ in storage.listed(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def _last(self) -> int:
        return int((self._manifests() or ["0.json"])[-1][:-5])

    def generation(self, number: int | None = None) -> dict:
        return json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{number or self._last():010d}.json"))

    def _attached(self, session: SparkSession, generation: dict, table: str) -> str:
        """The name in the session's catalogue of a table's buckets; the files are what counts, a new driver attaches them again."""
        of, name = generation["tables"][table], f"clustered_{generation['name']}_{table}"
        columns = ", ".join(f"{_quoted([c])} {t}" for c, t in of["columns"])
        options = ", ".join(f"'{k}' '{v}'" for k, v in of["options"].items())
        session.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {f'OPTIONS ({options})' if options else ''} CLUSTERED BY ({_quoted([generation['key']])}) "
            f"SORTED BY ({_quoted(of['sort'])}) INTO {generation['buckets']} BUCKETS LOCATION '{self.path}/data/{generation['name']}/even/{table}'"
        )
        return name

    def even(self, table: str, number: int | None = None) -> DataFrame:
        """A table's rows in buckets."""
        return self.session.table(self._attached(self.session, self.generation(number), table))

    def hot(self, table: str, number: int | None = None) -> DataFrame:
        """A table's rows of hot keys and those without a key."""
        made = self.generation(number)
        schema = ", ".join(f"{_quoted([c])} {t}" for c, t in made["tables"][table]["columns"])
        return self.session.read.schema(schema).parquet(f"{self.path}/data/{made['name']}/hot/{table}")

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """All rows of a table."""
        return self.even(table, number).unionByName(self.hot(table, number))

    def each_part(self, f: Callable[[Callable[[str], DataFrame]], DataFrame], number: int | None = None) -> DataFrame:
        """f of the buckets and f of the rest, where there are such rows; f gets a function that reads a table by name and works key by key."""
        number = number or self._last()
        made = self.generation(number)
        even = f(lambda table: self.even(table, number))
        hot = lambda table: self.hot(table, number).drop(*([self.key] if made["tables"][table]["lent"] else []))
        return even.unionByName(f(hot)) if made["hot"] else even

    def clean(self) -> list[str]:
        """Deletes all generations but the last; gives their names. Call it when no reader is left on them."""
        gone = []
        for n in self._manifests()[:-1]:
            made = self.generation(int(n[:-5]))
            for table in made["tables"]:
                self.spark.sql(f"DROP TABLE IF EXISTS clustered_{made['name']}_{table}")
            storage.removed(self.spark, f"{self.path}/data/{made['name']}")
            storage.removed(self.spark, f"{self.path}/manifest/{n}")
            gone.append(made["name"])
        return gone


def store_prices_by_card(store: Clustered, printings: DataFrame, store_prices: DataFrame, history: DataFrame) -> int:
    """Stores printings, prices and history by card_id; prices and history get that column, null where no printing has their id.

    priced_printings() and daily_prices() and what is built on them take such tables as they take others.
    """
    of = printings.select(F.col("id").alias("printing_id"), "card_id")
    return store.store({
        "printings": (printings, Layout(("id",), ("id",))),
        "store_prices": (store_prices.join(of, "printing_id", "left"), Layout(("printing_id",), ("printing_id",), lent=True)),
        "price_history": (history.join(of, "printing_id", "left"), Layout(("printing_id", "recorded_at"), ("printing_id",), lent=True)),
    })
