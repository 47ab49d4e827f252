"""The corpus pipeline: toxicity, language ID, near duplicates, mixing to target weights, token ids.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps; the last gives their token ids. Nulls in any
column, empty and very long texts, repeated rows and ids are handled by every stage as its docstring says. Further columns of
any name and type, maps too, go through the stages as they are: on the way they have names of their own that nothing else
has. An empty table gives an empty one. Decisions are made on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import bpe, jaccard, langid, mixing, queries, toxicity
from pricewell.llm.common import env_path, in_order, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeps_columns(stage: Stage) -> Stage:
    """The stage over columns doc_id, text, lang, source and `other_0` and so on for the others, which get their names back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c if c in ("doc_id", "text", "lang", "source") else f"other_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*own), sf_dir).select(*own).toDF(*docs.columns)

    return run


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. A null text is scored as an empty one; rows alike go or stay together."""
    return toxicity.clean(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")), queries.TOXIC_FROM)


@keeps_columns
def drop_unrecognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too), and those of no clear language, go; rows alike go or stay together."""
    return langid.recognised(docs, queries.lang_model(docs))


@keeps_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, one with the smallest doc_id stays; rows without an id stay.

    Texts that share an id without a link are judged apart. Of rows of one id and one set, the first by its columns, in
    order, stays, one of those alike (columns that Spark cannot compare, such as maps, are ordered by their JSON). A text without words (null too) is linked with nothing but its own id's.
    """
    known = jaccard.members(docs)
    others = known.filter("component_id <> doc_id").select("doc_id").distinct()
    repeated = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(repeated, "doc_id", "left_anti").join(others, "doc_id", "left_anti").select(*docs.columns)
    chosen = known.join(repeated, "doc_id", "left_semi").filter("component_id = doc_id").groupBy("doc_id", "comp").agg(F.min("key").alias("_key"))
    again = jaccard.keyed(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns)).join(chosen, ["doc_id", "_key"], "left_semi")
    # within tasks first: no hot id meets in one
    one = again.groupBy("doc_id", "_key").agg(F.min_by(F.struct(*docs.columns), in_order(docs)).alias("_row"))
    return single.unionByName(one.select("_row.*"))


@keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times; null sources are a source, null texts have no words.

    Rows alike are taken one by one, so that a source of copies of one row meets its target too.
    """
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens of every row; a null text has no ids."""
    made = bpe.encode(docs, env_path("byte_bpe_50k.json"), keep=["doc_id", "source"])
    return made.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unrecognised),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: Neither the classifiers nor the encoder can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
