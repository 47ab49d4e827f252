"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.rules import ascii_words

MARKS = r"[̀-ͯ]"
#: Unicode spaces besides the ASCII ones, which Java's \s leaves out.
OTHER_SPACES = "                 　﻿"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """All characters that decompose into one ASCII character and combining marks, and those ASCII characters."""
    pairs = []
    for code in range(128, 0x30000):
        whole = unicodedata.normalize("NFD", chr(code))
        if whole != chr(code) and whole[0] < "\x80" and all("̀" <= m <= "ͯ" for m in whole[1:]):
            pairs.append((chr(code), whole[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def name_key(name: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces between; accents are dropped."""
    accented, plain = accent_table()
    bare = F.translate(F.regexp_replace(name, MARKS, ""), accented, plain)
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


set_key = name_key


def strip_variant(name: Column, rounds: int = 8) -> Column:
    """Without the trailing (...) and [...], taken off in turns; eight turns settle what listings hold."""
    plain = plain_spaces(name)
    out = plain
    for _ in range(rounds):
        out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*\([^)]*\)\s*$", ""), r"\s*\[[^\]]*\]\s*$", ""))
    return F.when(plain.rlike(r"[)\]]\s*$"), out).otherwise(F.trim(plain))


def plain_spaces(text: Column) -> Column:
    return F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))


def number_prefix(text: Column) -> Column:
    """The integer that a text starts with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def stem(pattern: str) -> str | None:
    """The longest run of letters and digits that every match of a pattern holds, in lower case; None if there is none."""
    p = pattern
    while "(" in p:
        p, before = re.sub(r"\([^()]*\)[?*+]?", "\0", p), p
        if p == before:
            return None
    p = re.sub(r"\[[^\]]*\][?*+]?|\\\W|\\\w[?*+]?|.[?*]", "\0", p)
    runs = [] if "|" in p else re.findall("[a-z0-9]{2,}", p)
    return max(runs, key=len, default=None)


def found(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the pattern is found; low, the lower-cased text, is searched for the pattern's stem first."""
    hit, part = text.rlike(ascii_words(pattern)), stem(pattern)
    return hit if low is None or part is None else low.contains(part) & hit


def first_match(text: Column, rules: list[tuple[str, str]], low: Column | None = None) -> Column:
    """The value of the first pattern found in the text, or null."""
    return F.coalesce(*[F.when(found(text, p, low), F.lit(v)) for p, v in rules])


def found_any(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | found(text, p, low)
    return out


def by_name(name: Column, names: dict[str, str], otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), otherwise)


def money(text: Column) -> Column:
    """The number that a text starts with as decimal(12,2), or null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("decimal(20,6)").try_cast("decimal(12,2)")
