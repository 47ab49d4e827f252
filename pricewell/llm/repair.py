"""Repair of the turn order of conversations by weighted interval parsing (CYK).

The grammar, in Chomsky normal form, derives conversations of the role initials `(s?(ua)+)?` from damaged ones. Its
nonterminals are pairs [p>q] of what was said last before and after a span of rows (nothing, system, user, assistant), its
binary rules [p>q] -> [p>r] [r>q], its terminal rules the edits of one row: keep it (K), give it the role user or assistant
(R), delete it (D). Empty-text user or assistant turns may be inserted anywhere (I): the closure of these insertions, the
cheapest way from p to q without a row, is joined to the terminal rules, so that every span has cells of rows only.

A cell holds the least (cost, audit), audit being the edits' initials in order; ties go to the least in ASCII order. Two audits of one
cell have an edit for each of its rows, so none is a prefix of another of the same cost, and the least of two spans is made
of the least of each. Cells are combined bottom-up by span length. As [p>q] goes over every r, derivations can be bracketed
at will, and one split point for each span finds the least cell of all; so only spans of doubling lengths are filled, about
as many as there are rows. A conversation of a million turns is parsed like one of eight.

Texts stay in the JVM: Python gets one letter for each row. A conversation is ordered, with spill, by one task, and its
letters are parsed by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.llm.common import importable, stored

SPACES = " \t\n\x0b\x0c\r"
#: What an edit costs; an undeleted truncated row adds CUT.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
CUT = 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What was said last, and who may speak next.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NOTHING, ASSISTANT)

Cell = dict[tuple[int, int], tuple[int, str]]


def least(cell: Cell, key: tuple[int, int], found: tuple[int, str]) -> bool:
    """Puts found into the cell if it is less than what is there."""
    if key in cell and cell[key] <= found:
        return False
    cell[key] = found
    return True


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans, one after the other: [p>q] -> [p>r] [r>q]."""
    after: dict[int, list[tuple[int, int, str]]] = {}
    for (r, q), (cost, audit) in right.items():
        after.setdefault(r, []).append((q, cost, audit))
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q, more, rest in after.get(r, ()):
            old = out.get((p, q))
            if old is None or cost + more < old[0] or (cost + more == old[0] and audit + rest < old[1]):
                out[p, q] = cost + more, audit + rest
    return out


def insertions() -> Cell:
    """The closure of inserted turns: the least cell of an empty span."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    grown = True
    while grown:
        grown = False
        for (p, q), (cost, audit) in list(cell.items()):
            for by in "ua":
                if (q, by) in NEXT:
                    grown |= least(cell, (p, NEXT[q, by]), (cost + COSTS["I"], audit + "I"))
    return cell


EMPTY = insertions()


@lru_cache(None)
def of_row(letter: str) -> Cell:
    """The cell of one row: x must go; s, u, a, o (any other role) may stay, in capitals if the text is cut off."""
    cell: Cell = {(p, p): (COSTS["D"], "D") for p in range(4)}
    cut = CUT if letter.isupper() else 0
    for (p, by), q in NEXT.items():
        if letter != "x":
            if by == letter.lower():
                least(cell, (p, q), (COSTS["K"] + cut, "K"))
            if by != "s":
                least(cell, (p, q), (COSTS["R"] + cut, "R"))
    return joined(joined(EMPTY, cell), EMPTY)


def parse(letters: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation."""
    if not letters:
        return 0, ""
    spans = [of_row(x) for x in letters]
    while len(spans) > 1:
        pairs = [joined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return min(spans[0][NOTHING, q] for q in ENDS if (NOTHING, q) in spans[0])


def replay(letters: str, audit: str) -> list[tuple[str, int | None, str | None]]:
    """(edit, row from 1 on, initial of the turn that comes of it) of each edit."""
    out, said, row = [], NOTHING, 0
    for edit in audit:
        row += edit != "I"
        by = None if edit == "D" else letters[row - 1].lower() if edit == "K" else "a" if said == USER else "u"
        said = NEXT[said, by] if by else said
        out.append((edit, None if edit == "I" else row, by))
    return out


@lru_cache(20_000)
def _short(letters: str) -> list[dict]:
    return [{"edit": e, "pos": r, "by": b} for e, r, b in replay(letters, parse(letters)[1])]


def _edits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([_short(x) if len(x) <= 32 else _short.__wrapped__(x) for x in part], dtype=object)


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text in their order within a conversation: pos, fault, illegal, letter.

    Order: turn (nulls first), role, text. fault: blank, duplicate (role and text seen earlier in the conversation) or
    truncated (the last character but white space is none of .!?), else null. illegal: the role cannot follow the row before.
    """
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    d = rows.withColumns({"pos": F.row_number().over(order), "_by": F.substring("role", 1, 1)})
    d = d.withColumn("_before", F.lag("_by").over(W.partitionBy("conv_id").orderBy("pos")))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "_said").orderBy("pos")) > 1
    d = d.withColumn("_said", F.sha2("text", 256)).withColumn("_again", again)
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("_again"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    d = d.withColumn("fault", fault)
    who = F.when(F.col("_by").isin("s", "u", "a"), F.col("_by")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(who)).otherwise(who)
    illegal = F.col("_before").isNotNull() & ~F.concat("_before", "_by").isin("su", "ua", "au")
    return d.select("conv_id", "turn", "role", "text", "pos", "fault", illegal.alias("illegal"), letter.alias("letter"))


def edits(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit, cost, turn, old_role, role, text, fault, illegal: every edit of every conversation in order.

    conversations: conv_id, turn, role, text; further columns are left out. Null roles and texts count as one blank, a
    null conv_id is a conversation of its own, rows of one turn are ordered by role and text, repeated rows are duplicates.
    Kept rows stay as they are, inserted turns have no text and no turn number; deleted rows have a null role. A conversation
    whose rows all go has its D rows; an empty table gives none.
    """
    importable(conversations.sparkSession)
    blank = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = stored(judged(rows), "repair-rows")
    pairs = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    letters = rows.groupBy("conv_id").agg(F.array_join(F.transform(pairs, lambda x: x["letter"]), "").alias("letters"))
    repair = F.pandas_udf(_edits, "array<struct<edit:string,pos:int,by:string>>")
    made = letters.select("conv_id", F.posexplode(repair("letters")).alias("place", "e")).select("conv_id", (F.col("place") + 1).alias("place"), "e.*")
    m, r = made.alias("m"), rows.alias("r")
    d = m.join(r, F.col("m.conv_id").eqNullSafe(F.col("r.conv_id")) & F.col("m.pos").eqNullSafe(F.col("r.pos")), "left")
    new = F.when(F.col("edit") == "K", F.col("r.role")).when(F.col("by") == "u", "user").when(F.col("by") == "a", "assistant")
    cut = F.when((F.col("fault") == "truncated") & (F.col("edit") != "D"), CUT).otherwise(0)
    cost = sum((F.when(F.col("edit") == k, v).otherwise(0) for k, v in COSTS.items()), start=cut)
    return d.select("m.conv_id", "place", "edit", cost.cast("long").alias("cost"), "turn", F.col("role").alias("old_role"), new.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "fault", F.coalesce("illegal", F.lit(False)).alias("illegal"))


def report(made: DataFrame) -> DataFrame:
    """One row per conversation of edits(): gaps in its turn numbers, faults, cost, audit and the repaired turns in order."""
    listed = F.array_sort(F.collect_list(F.struct("place", "edit", "role", "text")))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    d = made.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"), listed.alias("_all"),
    )
    turns = F.transform(F.filter("_all", lambda x: x["role"].isNotNull()), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return d.withColumns({"audit": F.array_join(F.transform("_all", lambda x: x["edit"]), ""), "turns": turns}).drop("_all")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the hash of a row's place; nulls are one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumns({"text": said, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")), "_times": F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return d.select("conv_id", "turn", "role", "text")

