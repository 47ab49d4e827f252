"""Listings to catalogue printings: a cascade of equi-joins, then a blocked edit-distance join for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.rules import SET_ALIASES
from pricewell.functions.text import name_key, number_prefix, set_key, strip_variant


def index_source(printings: DataFrame, cards: DataFrame) -> DataFrame:
    """Every printing with its card's name key and its number."""
    c = cards.select(F.col("id").alias("card_id"), name_key(F.col("name")).alias("key"))
    return printings.join(c, "card_id").select(F.col("id").alias("printing_id"), "key", "set_code", "set_name", "collector_number", "is_foil", number_prefix(F.col("collector_number")).alias("num"))


def first_printing(only: Column | None = None) -> Column:
    """Lowest number first, non-numeric last; of the printings that `only` admits."""
    return _chosen(F.struct(F.col("num").isNull(), "num", "printing_id"), only)


def last_printing(only: Column | None = None) -> Column:
    """Non-numeric first, then the highest number: for borderless listings."""
    return _chosen(F.struct(F.col("num").isNotNull(), -F.col("num"), "printing_id"), only)


def _chosen(order: Column, only: Column | None) -> Column:
    return F.min_by("printing_id", order if only is None else F.when(only, order))


def grouped(index: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row per key: the default and the borderless choice and the number of candidates."""
    return index.groupBy(*keys).agg(first_printing().alias(f"{prefix}_first"), last_printing().alias(f"{prefix}_last"), F.count("*").alias(f"{prefix}_n"))


#: What by_key() has for each name: the foil, the other and all printings.
KINDS = ("foil", "plain", "all")


def by_key(index: DataFrame) -> DataFrame:
    """One row per name key with the choices among its foil, its other and all its printings."""
    aggs = []
    for kind, only in zip(KINDS, (F.col("is_foil"), ~F.col("is_foil"), F.lit(True)), strict=True):
        aggs += [first_printing(only).alias(f"{kind}_first"), last_printing(only).alias(f"{kind}_last"), F.count_if(only).alias(f"{kind}_n")]
    return index.groupBy(F.col("key").alias("_key")).agg(*aggs)


def set_names(printings: DataFrame, aliases: bool = False) -> DataFrame:
    """set_key -> set code, the smallest where several share a name; optionally the alias table for names not there."""
    out = printings.groupBy(set_key(F.col("set_name")).alias("set_key")).agg(F.min("set_code").alias("named_code"))
    if aliases:
        more = printings.sparkSession.createDataFrame(list(SET_ALIASES.items()), "set_key STRING, named_code STRING")
        out = out.unionByName(more.join(out, "set_key", "left_anti"))
    return out


def segments(key: Column, length: Column, shift: Column | None = None) -> list[Column]:
    """The three even parts of a key of the given length, as start, size."""
    base = (length / 3).cast("int")
    sizes = [base, base + F.when(length % 3 == 2, 1).otherwise(0), base + F.when(length % 3 >= 1, 1).otherwise(0)]
    starts = [F.lit(1), 1 + sizes[0], 1 + sizes[0] + sizes[1]]
    return [F.struct(a.alias("start"), b.alias("size")) for a, b in zip(starts, sizes, strict=True)]


def _parts(key: Column, length: Column) -> Column:
    """The three parts of a key as if it had the given length; of lengths under 3, where a part could be empty, one empty part."""
    return F.when(length >= 3, F.array(*segments(key, length))).otherwise(F.array(F.struct(F.lit(1).alias("start"), F.lit(0).alias("size"))))


#: Keys up to this length are found by forms that near texts share, longer ones by their parts.
SHORT = 8
#: A block of keys with more than this share of all is met in several parts; at most 1 / HOT blocks are.
HOT = 0.001


def removed(text: Column, count: int) -> Column:
    """The distinct texts that are left when `count` of at least as many characters are removed."""
    out = F.array(text)
    one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    for _ in range(count):
        out = F.array_distinct(F.flatten(F.transform(out, one)))
    return out


def covered(text: Column) -> Column:
    """The texts with two characters covered, for each pair of places; none of texts under two characters."""
    n, cover = F.length(text), F.lit("\0")
    at = lambda i, j: F.concat(F.substring(text, F.lit(1), i - 1), cover, F.substring(text, i + 1, j - i - 1), cover, F.substring(text, j + 1, n))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: at(i, j)))
    return F.when(n >= 2, F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def forms(text: Column) -> Column:
    """(longer, form): forms that two texts within edit distance 2 share, one being `longer` by -2 to 2 characters than the other.

    Of the same length, they are alike but for one character of each removed or two places covered; of lengths that differ by
    one, but for two of the longer and one of the shorter; by two, but for two of the longer.
    """
    n, none = F.length(text), F.array().cast("array<string>")
    at_most = lambda k: F.when(n >= k, removed(text, k)).otherwise(removed(text, k - 1) if k > 1 else F.array(text))
    of = {-2: F.array(text), -1: at_most(1), 0: F.concat(at_most(1), covered(text)), 1: F.when(n >= 1, at_most(2)).otherwise(none), 2: F.when(n >= 2, removed(text, 2)).otherwise(none)}
    named = lambda d: lambda x: F.struct(F.lit(d).alias("longer"), x.alias("form"))
    return F.flatten(F.array(*[F.transform(f, named(d)) for d, f in of.items()]))


def met(asked: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """probe, key of asked and blocks rows that share `keys`, once each.

    A block with more than HOT of all rows is dealt over slots by its keys' hash, and each probe that asks for it goes to all
    of them: no task holds more of it. The few such blocks are broadcast.
    """
    sizes = blocks.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = blocks.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))
    large = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").filter(F.col("_n") > F.greatest(F.lit(100), F.col("_total") * HOT))
    large = F.broadcast(large.select(*keys, F.ceil(F.col("_n") / F.greatest(F.lit(100), F.col("_total") * HOT)).cast("int").alias("_slots")))
    slots = F.coalesce("_slots", F.lit(1))
    held = blocks.join(large, keys, "left").withColumn("_slot", F.pmod(F.xxhash64("key"), slots).cast("int")).drop("_slots")
    want = asked.join(large, keys, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("_slots")
    return want.join(held, [*keys, "_slot"]).select("probe", "key").distinct()


def near_candidates(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """(probe, key) of all pairs that may be within edit distance 2, and few others.

    A longer key within the distance keeps one of its three segments unchanged, shifted by 2 at most. A short one shares a
    form with the probe, so short keys have no blocks of one or two characters that much of an alphabet shares.
    """
    most = 2
    k = keys.select("key", F.length("key").alias("len"))
    cut = k.filter(F.col("len") > SHORT).select("key", "len", F.posexplode(_parts(F.col("key"), F.col("len"))).alias("seg", "at"))
    blocks = cut.select("key", "len", "seg", F.expr("substring(key, at.start, at.size)").alias("part"))
    p = probes.select("probe", F.length("probe").alias("plen"))
    long = p.filter(F.col("plen") + most > SHORT)
    asked = long.select("probe", F.explode(F.sequence(F.greatest(F.lit(SHORT + 1), F.col("plen") - most), F.col("plen") + most)).alias("len"))
    asked = asked.select("probe", "len", F.posexplode(_parts(F.col("probe"), F.col("len"))).alias("seg", "at"))
    asked = asked.select("probe", "len", "seg", "at", F.explode(F.expr(f"sequence(greatest(1, at.start - {most}), at.start + {most})")).alias("from"))
    asked = asked.select("probe", "len", "seg", F.expr("substring(probe, `from`, at.size)").alias("part")).distinct()
    by_parts = met(asked, blocks, ["len", "seg", "part"])
    short = k.filter(F.col("len") <= SHORT).select("key", "len", F.explode(forms(F.col("key"))).alias("f"))
    short = short.select("key", "len", (F.col("len") - F.col("f.longer")).alias("plen"), "f.form")
    rest = p.filter(F.col("plen") <= SHORT + most).select("probe", "plen", F.explode(forms(F.col("probe"))).alias("f"))
    rest = rest.select("probe", (F.col("plen") - F.col("f.longer")).alias("len"), "plen", "f.form")
    return by_parts.unionByName(met(rest, short, ["len", "plen", "form"]))


def near_keys(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """(probe, key, dist) of all pairs within edit distance 2."""
    return near_candidates(probes, keys).withColumn("dist", F.levenshtein("probe", "key", 2)).filter("dist >= 0")


def nearest_keys(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """probe, near, dist: the nearest key of each probe within distance 2, ties to the smaller key."""
    best = near_keys(probes, keys).groupBy("probe").agg(F.min(F.struct("dist", "key")).alias("b"))
    return best.select("probe", F.col("b.key").alias("near"), F.col("b.dist").alias("dist"))


def _or_nothing(key: Column, spread: Column) -> Column:
    """The key; where it is null, one of a thousand values that no index holds, so that such rows don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.xxhash64(spread), F.lit(1_000)).cast("string")))


def match_listings(listings: DataFrame, printings: DataFrame, cards: DataFrame, min_confidence: float = 0.0, aliases: bool = False, publish: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The listings plus printing_id, match_type and confidence.

    Levels in order: set_collector, exact, name_foil, name_only, fuzzy, unmatched; the first that hits decides. Matches
    under min_confidence count as unmatched. Names and set names are worked out once for each distinct text, and names that
    the catalogue lacks once each, to the nearest key that it has, so that a listing meets all levels of its name in one
    join. publish (table, name) -> table, where given, writes the small tables that listings meet once, as several levels
    use them and their size then decides the joins.
    """
    put = publish or (lambda d, _: d)
    index = put(index_source(printings, cards), "index")
    have = set(listings.columns)
    d = listings if "set_code" in have else listings.withColumn("set_code", F.lit(None).cast("string"))
    told = [c for c in ("listing_seq", "item_id", "price", "store_id") if c in have]  # tell rows without a name apart
    spread = F.xxhash64(*told) if told else F.monotonically_increasing_id()
    heard = put(d.select("raw_name", "set_name").distinct(), "heard")

    names = put(by_key(index), "names")
    # without repeated keys here: a distinct over another one is merged with it, and then each listing's name is worked out
    own = heard.filter("raw_name is not null").select("raw_name").distinct().withColumn("_key", name_key(strip_variant(F.col("raw_name"))))
    own = put(own.join(names, "_key", "left"), "own")
    unknown = put(own.filter("all_n is null").select(F.col("_key").alias("probe")).distinct(), "unknown")
    near = nearest_keys(unknown, names.select(F.col("_key").alias("key")))
    guessed = near.join(names.withColumnRenamed("_key", "near"), "near").withColumnRenamed("probe", "_key").drop("near")
    lacking = own.filter("all_n is null").select("raw_name", "_key").join(guessed, "_key", "left")
    known = put(own.filter("all_n is not null").withColumn("dist", F.lit(None).cast("int")).unionByName(lacking).withColumnRenamed("raw_name", "_raw"), "known")

    named = heard.filter("set_name <> ''").select("set_name").distinct().withColumn("set_key", set_key(F.col("set_name")))
    sets = put(named.join(set_names(printings, aliases), "set_key").select(F.col("set_name").alias("_named"), "named_code"), "sets")
    by_number = put(index.groupBy(F.col("set_code").alias("_set"), F.col("collector_number").alias("_number"), F.col("is_foil").alias("_foil")).agg(F.max("printing_id").alias("l0")), "numbers")
    exact = put(grouped(index.withColumnsRenamed({"set_code": "_set", "is_foil": "_foil", "key": "_key"}), ["_key", "_set", "_foil"], "l1"), "exact")
    d = d.withColumns({"_foil": F.col("is_foil"), "_raw": _or_nothing(F.col("raw_name"), spread), "_named": _or_nothing(F.nullif("set_name", F.lit("")), F.col("raw_name"))})
    d = d.join(known, "_raw", "left").join(sets, "_named", "left")
    d = d.withColumns({"_key": _or_nothing(F.col("_key"), spread), "_set": _or_nothing(F.coalesce(F.nullif("set_code", F.lit("")), "named_code"), F.col("raw_name")), "_number": _or_nothing(F.nullif("collector_number", F.lit("")), F.col("raw_name"))})
    d = d.join(by_number, ["_set", "_number", "_foil"], "left").join(exact, ["_key", "_set", "_foil"], "left")

    wide = F.coalesce("is_borderless", F.lit(False)) if "is_borderless" in have else F.lit(False)
    of_kind = lambda what: F.when(F.col("_foil"), F.col(f"foil_{what}")).when(~F.col("_foil"), F.col(f"plain_{what}"))
    pick = lambda get: F.when(wide, get("last")).otherwise(get("first"))
    several = lambda n, one, more: F.when(n == 1, one).otherwise(more)
    own, any_kind, exactly = F.col("dist").isNull(), lambda what: F.col(f"all_{what}"), lambda what: F.col(f"l1_{what}")
    levels = [
        (F.col("l0").isNotNull(), F.col("l0"), "set_collector", F.lit(1.0)),
        (F.col("l1_n").isNotNull(), pick(exactly), "exact", several(F.col("l1_n"), 1.0, 0.8)),
        (own & (of_kind("n") > 0), pick(of_kind), "name_foil", several(of_kind("n"), 0.85, 0.7)),
        (own & (F.col("all_n") > 0), pick(any_kind), "name_only", several(F.col("all_n"), 0.7, 0.6)),
        (F.col("dist").isNotNull(), F.coalesce(of_kind("first"), "all_first"), "fuzzy", F.greatest(F.lit(0.5), F.round(1 - F.col("dist") * 0.2, 2))),
    ]
    chain = lambda k: F.coalesce(*[F.when(level[0], F.lit(level[k]) if k == 2 else level[k]) for level in levels])
    d = d.withColumn("_c", F.coalesce(chain(3), F.lit(0.0))).withColumn("_t", chain(2)).withColumn("_p", chain(1))
    sure = F.col("_c") >= min_confidence
    return d.select(*listings.columns, F.when(sure, F.col("_p")).alias("printing_id"), F.when(sure, F.coalesce("_t", F.lit("unmatched"))).otherwise("unmatched").alias("match_type"), F.when(sure, F.col("_c")).otherwise(0.0).alias("confidence"))


def split_matches(matched: DataFrame, day: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current price rows, history rows, unmatched rows) of matched listings with a store_id."""
    hit, miss = matched.filter("printing_id is not null"), matched.filter("printing_id is null")
    prices = hit.select("printing_id", "store_id", F.col("price").alias("price_aud"), "price_type", "condition", "in_stock", F.col("source_url").alias("url"))
    unmatched = miss.select("store_id", "raw_name", F.col("set_name").alias("raw_set_name"), F.col("price").alias("raw_price"), "source_url")
    return prices, history_rows(matched, day), unmatched


def history_rows(matched: DataFrame, day: str) -> DataFrame:
    hit = matched.filter("printing_id is not null")
    return hit.select("printing_id", "store_id", F.col("price").alias("price_aud"), "price_type", F.lit(day).cast("date").alias("recorded_at"), "listing_seq")
