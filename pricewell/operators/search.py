"""Many searches of names at once: an index of grams, the rarest gram of each search, then the search itself.

The index has a row for each name and each of its distinct grams of up to three characters, in lower case. Text between the
wildcards of a search must be in the names that it finds, and so must that text's grams: the names that have its rarest
gram are looked at by the search's own pattern, all others are not. The index is made once and can be stored; a search of
one or two characters goes by grams of its length, one of wildcards only by the empty gram, which every name has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 3


def grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of `size` characters of a text of at least that length; none of a shorter one."""
    n = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def gram_index(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """gram, key: the names' grams of 0 to 3 characters. Null names have none, as no search finds them."""
    low = F.lower(F.col(name))
    every = F.concat(F.array(F.lit("")), *[grams(low, n) for n in range(1, WIDEST + 1)])
    return names.filter(F.col(name).isNotNull()).select(F.explode(every).alias("gram"), key)


def gram_sizes(index: DataFrame) -> DataFrame:
    """gram, df: how many names have it; small enough to be stored beside the index."""
    return index.groupBy("gram").agg(F.count("*").alias("df"))


def asked_grams(query: Column, literal: Column) -> Column:
    """The grams that a name must have: those of the texts between %, _ and escaped characters, or of the whole of a literal search."""
    low = F.lower(query)
    runs = F.when(literal, F.array(low)).otherwise(F.split(low, r"\\.|[%_\\]"))
    found = F.flatten(F.transform(runs, lambda r: grams(r, F.least(F.length(r), F.lit(WIDEST)))))
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit("")))


def pattern(query: Column, literal: Column) -> Column:
    """What ILIKE takes: %, _ and the backslash are themselves in a literal search."""
    return F.concat(F.lit("%"), F.when(literal, F.regexp_replace(query, r"([\\%_])", r"\\$1")).otherwise(query), F.lit("%"))


def search_all(names: DataFrame, searches: DataFrame, index: DataFrame | None = None, sizes: DataFrame | None = None, key: str = "id", name: str = "name") -> DataFrame:
    """query, literal and key of every name that a search finds, whatever the case; blank searches find none.

    searches: query, literal. index and sizes: gram_index() and gram_sizes() where they are stored, else made here.
    """
    index = gram_index(names, key, name) if index is None else index
    sizes = gram_sizes(index) if sizes is None else sizes
    q = searches.select("query", "literal").distinct().filter(F.trim("query") != "")
    each = q.withColumn("gram", F.explode(asked_grams(F.col("query"), F.col("literal")))).join(sizes, "gram", "left")
    rarest = each.groupBy("query", "literal").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).filter("g.df > 0")
    near = rarest.select("query", "literal", F.col("g.gram").alias("gram")).join(index, "gram").drop("gram")
    named = names.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    d = near.join(named, near[key] == named["_key"]).withColumn("_like", pattern(F.col("query"), F.col("literal")))
    return d.filter(F.ilike("_name", F.col("_like"))).select("query", "literal", key)
