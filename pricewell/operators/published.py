"""Stored tables in parts. A change writes the parts that it touches, and a manifest moves readers to all of it at once.

A table's folder has `data`, one folder for each write with one for each part below, and `manifest`, a small numbered file for each
version that lists the folders of every part. The latest number is the table. A version is put there whole, by renaming, and only
if no one else has put one of its number: a reader sees the old table or the new one, and of two changes that meet the
second fails and can be run again. Files of failed or old versions stay until clean().

Parts are hash buckets of key columns, or months of a date. A part may hold any share of the rows: it is written by several
tasks, by size. What goes through the driver is a list of folders and of the part names that a change touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell import storage
from pricewell.operators import snapshots


class Conflict(RuntimeError):
    """Another change was published since the one at hand has read the table."""


@dataclass(frozen=True)
class Buckets:
    """Parts by the hash of key columns, each with its number of buckets: `03-1` for two columns.

    Rows that have only the first of the columns touch all parts with their first number.
    """

    columns: dict[str, int]

    def part(self, have: list[str]) -> Column:
        used = []
        for c, n in self.columns.items():
            if c not in have:
                break
            used.append(F.lpad(F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("string"), len(str(n - 1)), "0"))
        if not used:
            raise ValueError(f"none of {list(self.columns)} is there")
        return F.concat_ws("-", *used)


@dataclass(frozen=True)
class Months:
    """Parts by the month of a date column: `2001-11`; rows without a date in `none`."""

    column: str

    def part(self, have: list[str]) -> Column:
        return F.coalesce(F.date_format(self.column, "yyyy-MM"), F.lit("none"))


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, list[str]] = field(default_factory=dict)
    #: The last number that each named source has added: what makes its additions idempotent.
    marks: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    path: str
    schema: str
    layout: Buckets | Months

    def version(self) -> Version:
        numbers = [n[:-5] for n, _, _ in storage.listed(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not numbers:
            return Version(0)
        last = max(numbers)
        return Version(int(last), **json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{last}.json")))

    def folders(self, version: Version, parts: set[str] | None = None) -> list[str]:
        return [f"{self.path}/data/{f}" for p, fs in sorted(version.parts.items()) if parts is None or p in parts for f in fs]

    def read(self, parts: set[str] | None = None, version: Version | None = None) -> DataFrame:
        """The table, or some of its parts; it stays as it is for those who have it, whatever is published then."""
        folders = self.folders(version or self.version(), parts)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame, version: Version) -> set[str]:
        """The stored parts that rows with these keys may be in."""
        found = {r[0] for r in rows.select(self.layout.part(rows.columns).alias("p")).distinct().collect()}  # as many as parts
        return {p for p in version.parts if any(p == f or p.startswith(f + "-") for f in found)}

    def _written(self, df: DataFrame, columns: list[str], spread: bool = True) -> dict[str, list[str]]:
        name = uuid.uuid4().hex
        d = df.select(*columns).withColumn("_part", self.layout.part(df.columns))
        (d.hint("rebalance", "_part") if spread else d).write.partitionBy("_part").parquet(f"{self.path}/data/{name}")
        return {n.removeprefix("_part="): [f"{name}/{n}"] for n, _, folder in storage.listed(self.spark, f"{self.path}/data/{name}") if folder and n.startswith("_part=")}

    def _publish(self, base: Version, parts: dict[str, list[str]], marks: dict[str, int]) -> Version:
        made = Version(base.number + 1, {p: f for p, f in parts.items() if f}, marks)
        text = json.dumps({"parts": made.parts, "marks": made.marks}, sort_keys=True)
        if not storage.put_once(self.spark, f"{self.path}/manifest/{made.number:010d}.json", text):
            raise Conflict(f"version {made.number} of {self.path} is there already")
        return made

    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def append(self, rows: DataFrame, source: str | None = None, number: int = 0, spread: bool = True) -> Version:
        """Adds rows. What a source has added under a number, and under any before, is not added again.

        spread: False for rows of one part that are dealt evenly; they are written where they are, without a shuffle.
        """
        base = self.version()
        if source is not None and base.marks.get(source, -1) >= number:
            return base
        new = self._written(rows, self.columns(), spread)
        parts = {p: base.parts.get(p, []) + new.get(p, []) for p in {*base.parts, *new}}
        return self._publish(base, parts, base.marks | ({source: number} if source is not None else {}))

    def change(self, keys: DataFrame, f: Callable[[DataFrame], DataFrame]) -> Version:
        """The parts that `keys` touch become f(their rows); no other part is read or written. f may give rows of new parts.

        Rows that f gives belong to touched or to new parts, as keys stay what they are.
        """
        base = self.version()
        touched = self.touched(keys, base)
        new = self._written(f(self.read(touched, base)), self.columns())
        if astray := set(new) & set(base.parts) - touched:
            raise ValueError(f"rows of untouched parts: {sorted(astray)[:5]}")
        return self._publish(base, {p: fs for p, fs in base.parts.items() if p not in touched} | new, base.marks)

    def upsert(self, new: DataFrame, key: list[str], refresh: list[str] | None = None) -> Version:
        return self.change(new, lambda old: snapshots.upsert(old, new, key, refresh))

    def replace_store(self, new: DataFrame, stores: DataFrame) -> Version:
        """stores: store_id of the stores whose rows are replaced by those of new."""
        return self.change(stores.select("store_id").union(new.select("store_id")), lambda old: snapshots.replace_store(old, new, stores))

    def clear_cards(self, printings: DataFrame, cards: DataFrame, searched: DataFrame, store_id: str) -> Version:
        """Takes out a store's prices of the searched cards: only that store's parts are read."""
        store = self.spark.range(1).select(F.lit(store_id).alias("store_id"))
        return self.change(store, lambda old: snapshots.clear_cards(old, printings, cards, searched, store_id))

    def expire(self, keep: Callable[[str], bool]) -> Version:
        """Drops the parts whose name is not to be kept; no row is read."""
        base = self.version()
        return self._publish(base, {p: fs for p, fs in base.parts.items() if keep(p)}, base.marks)

    def sizes(self, version: Version) -> dict[str, list[int]]:
        """Bytes of the files of each part."""
        return {p: [n for f in fs for name, n, _ in storage.listed(self.spark, f"{self.path}/data/{f}") if name.startswith("part-")] for p, fs in version.parts.items()}

    def compact(self, target: int = 128 << 20) -> Version:
        """Rewrites the parts whose files could be fewer of about `target` bytes; the others stay."""
        base = self.version()
        small = {p for p, sizes in self.sizes(base).items() if len(sizes) > max(1, -(-sum(sizes) // target))}
        if not small:
            return base
        before = self.spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        self.spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target))
        try:
            new = self._written(self.read(small, base), self.columns())
        finally:
            self.spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        return self._publish(base, {p: fs for p, fs in base.parts.items() if p not in small} | new, base.marks)

    def clean(self, versions: int = 1) -> list[str]:
        """Deletes all versions but the last ones, and the folders that none of these lists; gives the folders deleted.

        Call it when no change is under way and no reader is left on an older version.
        """
        names = sorted(n for n, _, _ in storage.listed(self.spark, f"{self.path}/manifest") if n.endswith(".json"))
        kept = [json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{n}")) for n in names[-versions:]]
        used = {f for v in kept for fs in v["parts"].values() for f in fs}
        gone = []
        for n in names[:-versions]:
            storage.removed(self.spark, f"{self.path}/manifest/{n}")
        for write, _, _ in storage.listed(self.spark, f"{self.path}/data"):
            if not any(f.startswith(write + "/") for f in used):
                gone.append(write)
            else:
                gone += [f"{write}/{p}" for p, _, folder in storage.listed(self.spark, f"{self.path}/data/{write}") if folder and f"{write}/{p}" not in used]
        for g in gone:
            storage.removed(self.spark, f"{self.path}/data/{g}")
        return gone


def retain(table: Table, as_of: str, years: int = 2) -> Version:
    """Drops the months before the one that lies `years` before as_of; readers cut within that month by snapshots.retained()."""
    first = f"{int(as_of[:4]) - years:04d}{as_of[4:7]}"
    return table.expire(lambda month: month == "none" or month >= first)
