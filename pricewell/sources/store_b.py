"""Shop B: product pages with variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.rules import CONDITION_AXES, CONDITIONS_B, FOIL_AXES, FOIL_WORDS, NON_FOIL_WORDS, SKIPPED_VARIANTS, ascii_words
from pricewell.functions.text import by_name, money, plain_spaces
from pricewell.sources.schemas import STORE_B_PAGE
from pricewell.sources.tables import adapter, arrival, as_listing, landed_page

BASE_URL = "https://tcg.goodgames.com.au"
BORDERLESS = ascii_words(r"\bborderless\b")
NUMBER = r"\((\d{4})\)"


def products(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per product of each page (a JSON string), with its page and position; pages without products give none."""
    each = F.posexplode(F.from_json(F.col(body), STORE_B_PAGE)["products"]).alias("position", "p")
    return pages.select(landed_page(pages, body).alias("page"), each).select("page", "position", "p.*")


def skipped_variant(title: Column) -> Column:
    low = F.lower(title)
    out = F.lit(False)
    for phrase in SKIPPED_VARIANTS:
        out = out | low.contains(phrase)
    return out


def token_or_emblem(title: Column, product_type: Column) -> Column:
    return title.rlike(ascii_words(r"\b(?:token|emblem)\b")) | title.contains("//") | (F.lower(F.coalesce(product_type, F.lit(""))) == "token")


def title_parts(title: Column) -> tuple[Column, Column]:
    """(name, set): "Name - Set" by the first spaced dash, else "Name (Set)" or "Name [Set]", else the whole title and null."""
    dash, bracket = r"^(.+?)\s+[-–—]\s+(.+)$", r"^(.+?)\s+[\[(]([^\])]*)[\])]$"
    part = lambda p, k: F.trim(F.regexp_extract(title, p, k))
    name = F.when(title.rlike(dash), part(dash, 1)).when(title.rlike(bracket), part(bracket, 1)).otherwise(F.trim(title))
    return name, F.when(title.rlike(dash), part(dash, 2)).when(title.rlike(bracket), part(bracket, 2))


def tag_set(tags: Column) -> Column:
    """What follows "set:" or "set " in the first tag that starts so."""
    p = r"(?i)^set[:\s]+(.+)$"
    return F.trim(F.regexp_extract(F.get(F.filter(tags, lambda t: t.rlike(p)), F.lit(0)), p, 1))


def real_name(name: Column, set_name: Column) -> tuple[Column, Column]:
    """Where the set reads "Real Name [Set", the real name and the set; "Real Name" has over 2 characters and starts A-Z."""
    at = F.locate(" [", set_name)
    prefix = F.trim(F.substring(set_name, F.lit(1), at - 1))
    rest = F.substring(set_name, at + 2, F.length(set_name))
    inner = F.trim(F.regexp_extract(rest, r"^(.*)\]", 1))
    inner = F.when(rest.contains("]"), inner).otherwise(F.trim(F.substring(rest, F.lit(1), F.length(rest) - 1)))
    swap = F.coalesce((at > 0) & (F.length(prefix) > 2) & prefix.rlike("^[A-Z]"), F.lit(False))
    return F.when(swap, prefix).otherwise(name), F.when(swap, F.nullif(inner, F.lit(""))).otherwise(set_name)


def variant(title: Column, slots: list[Column], options: Column) -> tuple[Column, Column]:
    """(condition, is_foil) of a variant: by named axes, else by its title split at "/"; "Near Mint Foil" is foil."""
    axes = F.filter(F.arrays_zip(F.slice(F.transform(options, lambda o: F.lower(o["name"])), 1, 3).alias("axis"), F.array(*slots).alias("value")), lambda z: z["axis"].isNotNull() & (F.coalesce(z["value"], F.lit("")) != ""))

    def last_value(name: str) -> Column:
        values = F.transform(F.filter(axes, lambda z: z["axis"] == name), lambda z: z["value"])
        return F.try_element_at(values, F.lit(-1))

    def on(names: list[str]) -> Column:
        return F.coalesce(*[last_value(n) for n in names])

    condition, finish = F.coalesce(on(CONDITION_AXES), F.lit("")), F.lower(F.coalesce(on(FOIL_AXES), F.lit("")))
    parts = F.split(title, r"\s*/\s*")
    by_title = (condition == "") & (finish == "") & (title != "Default Title")
    condition = F.when(by_title, F.get(parts, F.lit(0))).otherwise(condition)
    finish = F.when(by_title, F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise(finish)
    suffix = r"(?i)\s+foil$"
    with_foil = condition.rlike(suffix)
    bare = F.when(with_foil, F.trim(F.regexp_replace(condition, suffix, ""))).otherwise(condition)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(finish, w))
    return F.when(bare == "", "NM").otherwise(by_name(F.trim(F.lower(bare)), CONDITIONS_B, F.trim(bare))), with_foil | (has(FOIL_WORDS) & ~has(NON_FOIL_WORDS))


def listing(p: DataFrame) -> DataFrame:
    """One row per near-mint variant with a price."""
    title = plain_spaces(F.col("title"))
    kept = p.filter(~skipped_variant(title) & ~token_or_emblem(title, F.col("product_type")))
    number = F.regexp_extract(title, NUMBER, 1)
    clean = F.regexp_replace(title, r"^(.*?)\(\d{4}\)", "$1")
    clean = F.regexp_replace(clean, f"(?i)^(.*?){BORDERLESS.removeprefix('(?i)')}", "$1")  # the first one only
    clean = F.trim(F.regexp_replace(clean, r"\s{2,}", " "))
    named = kept.withColumn("_clean", clean).withColumn("_number", F.nullif(number, F.lit("")).cast("int").cast("string")).withColumn("_borderless", title.rlike(BORDERLESS))
    name, title_set = title_parts(F.col("_clean"))
    named = named.withColumn("_name", name).withColumn("_set", F.coalesce(tag_set(F.col("tags")), title_set))
    name, set_name = real_name(F.col("_name"), F.col("_set"))
    each = named.select(name.alias("raw_name"), set_name.alias("set_name"), F.col("_number").alias("collector_number"), F.col("_borderless").alias("is_borderless"), "options", F.concat(F.lit(f"{BASE_URL}/products/"), "handle").alias("source_url"), "page", "position", F.posexplode("variants").alias("variant_position", "v"))
    condition, foil = variant(F.col("v.title"), [F.col("v.option1"), F.col("v.option2"), F.col("v.option3")], F.col("options"))
    priced = each.withColumn("price", money(F.col("v.price"))).withColumn("condition", condition).withColumn("is_foil", foil).filter("price > 0 and condition = 'NM'")
    return priced.select("raw_name", F.lit(None).cast("string").alias("set_code"), "set_name", "collector_number", "price", F.lit("sell").alias("price_type"), "condition", "is_foil", "is_borderless", F.coalesce(F.col("v.available"), F.col("v.inventory_quantity") > 0, F.lit(False)).alias("in_stock"), "source_url", arrival(F.col("page"), F.col("position") * 1_000 + F.col("variant_position")).alias("listing_seq"))


@adapter("good_games")
def listings(pages: DataFrame) -> DataFrame:
    return as_listing(listing(products(pages)))
