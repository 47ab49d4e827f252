"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the text is the whole conversation up to and with that turn, and only
the reply's characters are trainable (loss_start, loss_end). A conversation whose last turn isn't the assistant's gives
one more example without a trainable part, so that no turn is lost.

A turn is written as "### role: text</turn>" and a line feed. Inside roles and texts a backslash goes before every
backslash, "</turn>", "### " and (in roles) ":" and line feed, so parsing gives back exactly what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
#: A written turn: its role and its text, both still escaped.
TURN = r"(?s)### ((?:\\.|[^\\:])*+): ((?:\\.|[^\\<]|<(?!/turn>))*+)</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"(?=[\\:\n])|(?=</turn>)|(?=### )" if role else r"(?=\\)|(?=</turn>)|(?=### )", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, text, loss_start, loss_end (code points; null if none).

    Turns are ordered by turn number, then role and text; equal rows all stay. A null text or role counts as empty; a
    null turn number comes first; null conversation ids make one conversation. Other columns of df are left out. An
    empty table gives no rows. A conversation is one group, as an example holds all its turns in one string.
    """
    t = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    written = t.select("conv_id", F.struct("turn", "role", "text").alias("key"), F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("trained"))
    convs = written.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("key", "head", "body", "trained"))).alias("turns"))
    convs = convs.select("conv_id", "turns", F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))).alias("parts"), F.size("turns").alias("n"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: F.element_at("turns", k)["trained"] | (k == F.col("n")))
    shown = convs.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "k"))
    last = F.element_at("turns", F.col("k"))
    return shown.select("conv_id", "example", F.col("k").alias("n_turns"), F.array_join(F.slice("parts", F.lit(1), F.col("k")), "").alias("text"), F.length(last["body"]).alias("_body"), last["trained"].alias("_trained")).select(
        "conv_id", "example", "n_turns", "text", F.when(F.col("_trained"), F.length("text") - len(END) - F.col("_body")).alias("loss_start"), F.when(F.col("_trained"), F.length("text") - len(END)).alias("loss_end")
    )


def parse(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    roles, texts = F.regexp_extract_all(text, F.lit(TURN), F.lit(1)), F.regexp_extract_all(text, F.lit(TURN), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))


def trained_text(text: Column, start: Column, end: Column) -> Column:
    """What the loss mask of an example covers, unescaped; null without a mask."""
    return unescape(F.substring(text, start + 1, end - start))
