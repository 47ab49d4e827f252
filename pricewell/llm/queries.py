"""The registered queries of the training-data operators: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import additive, bpe, chat, collocations, exact_dedup, jaccard, langid, mixing, repair, sharding, threshold, toxicity, warc
from pricewell.llm.common import env_path, fold, same, stored, table
from pricewell.llm.vectors import valid

TOXIC_FROM = 0.7


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed))
    digests = made.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max_by("text", "n_turns").alias("_all"),
        F.array_sort(F.collect_list(F.struct("example", chat.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("t")))).alias("_loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("_loss", lambda x: F.coalesce(x["t"], F.lit(""))), "")
    turns = F.array_join(F.transform(chat.parse(F.col("_all")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return digests.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def lang_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.filter(fold(F.col("doc_id")) != 1))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    return langid.identify(d, lang_model(docs))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = valid(table(spark, sf_dir, "embeddings"), zero=False)
    return additive.nearest(v, v.filter(F.col("vec_id") % 20 == 0), 20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), env_path("byte_bpe_50k.json"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages' WARC layout with what the audit of a damaged replica finds of it.

    In the replica every 53rd page from 7 on has a changed byte, and every 59th from 11 on is lost; pages without id are whole.
    """
    whole = warc.record(F.col("page_id"), F.col("url"), F.col("html"))
    damaged = F.when(F.col("page_id") % 53 == 7, F.sha2(F.overlay(whole, F.lit("#"), F.lit(1)), 256))
    kept = stored(warc.layout(table(spark, sf_dir, "pages"), also={"_damaged": damaged}), "warc")
    there = ~F.coalesce(F.col("page_id") % 59 == 11, F.lit(False))
    replica = kept.filter(there).select("file", "offset", F.coalesce("_damaged", "sha256").alias("sha256"))
    found = warc.audit(kept, replica)
    d = kept.join(found, ["file", "offset"], "left")
    return d.select("page_id", "file", "offset", "length", "sha256", F.coalesce("status", F.lit("ok")).alias("status"), "found_sha256")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labelled rows outside the held-out fold; repeated labels of a document count once, the largest."""
    marks = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.fit(docs.select("doc_id", "text").join(marks, "doc_id"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    scored = toxicity.score(d, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = threshold.integers(valid(table(spark, sf_dir, "embeddings")))
    return threshold.top_k(v, v.filter(F.col("vec_id") % 50 == 0), 5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.cuts(docs))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    ids = rows.select("conv_id").distinct()
    made = repair.report(repair.edits(repair.damaged(rows)))
    d = ids.join(made, same(ids, made, ["conv_id"]), "left").drop(made["conv_id"])  # conversations without a row left too
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(said, F.lit("")), 256).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = collocations.collocations(table(spark, sf_dir, "documents"))
    return d.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    d = exact_dedup.deduplicated(spark, f"{sf_dir}/documents.parque[t]", schema)  # a stream's path is a folder or a pattern
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


RECORD = "'WARC/1.1' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || id || '>' || crlf || 'WARC-Target-URI: ' || url || crlf || 'Content-Length: ' || strlen(html) || crlf || crlf || html || crlf || crlf"
OP6_SQL = f"""WITH r AS (SELECT page_id, id, url, {RECORD} AS rec FROM (SELECT page_id, coalesce(page_id::VARCHAR, '') AS id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS crlf FROM pages) p),
 m AS (SELECT page_id, rec, CAST(('0x' || substr(md5(id || '|' || url), 1, 8))::UBIGINT % (SELECT greatest(1, ceil(count(*) / 1000.0))::UBIGINT FROM pages) AS INT) AS file, strlen(rec) AS length, sha256(rec) AS sha256 FROM r)
 SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, sha256,
 CASE WHEN page_id % 59 = 11 THEN 'missing' WHEN page_id % 53 = 7 THEN 'changed' ELSE 'ok' END AS status, CASE WHEN page_id % 59 <> 11 AND page_id % 53 = 7 THEN sha256('#' || substr(rec, 2)) END AS found_sha256 FROM m"""


OP12_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) x),
 totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
 grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k) y),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
 parts AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
 cut AS (SELECT c.lang, c.phrase, c.k, c.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM parts) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cut) z WHERE o = 1),
 held AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM parts WHERE k = 3) h GROUP BY 1, 2),
 kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.part = b.phrase WHERE h.a IS NULL OR 100 * h.a < 50 * b.a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
 SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
OP13_SQL = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
 SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_fixity": OP6_SQL, "op12_collocations": OP12_SQL, "op13_exact_dedup": OP13_SQL}
