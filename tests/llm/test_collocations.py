"""Phrase mining against a count of all n-grams in Python and against SQL; fingerprints that clash; long and odd texts."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewell.llm import collocations, queries, shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def mined(rows, most=3, least=10, inside=50, top=2_000):
    """The contract's rows from (lang, text) rows."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            totals[lang] += len(p)
            for k in range(1, most + 1):
                for i in range(len(p) - k + 1):
                    counts[lang, tuple(p[i : i + k])] += 1
    good = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in good.items():
        score, k = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = [b for (other, v), b in good.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if all(100 * b < inside * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    out.sort()
    ranks = Counter()
    rows = []
    for lang, score, a, phrase, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def given(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def odd_rows():
    r = random.Random(6)
    words = ["the", "The", "of", "é", "É", "a", "b", "ring", "x" * 40]
    rows = [(r.choice([None, "und", "en", "fr", "a\tb", ""]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", ";", "\r"]) for _ in range(r.randrange(60)))) for _ in range(120)]
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " \t"), ("en", "a a a a a a a a a a a a a a"), ("en", "only the one")] * 3


def frame(spark, rows):
    d = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, lang string, text string")
    return d.withColumns({"chunk": F.lit("mine"), "bucket": F.lit(1), "data": F.lit(None).cast("string")}).repartition(5)


def test_registered_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()["op12_collocations"])
    names = [c[0] for c in cur.description]
    wanted = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall())
    got = given(queries.op12_collocations(spark, SF))
    assert got == wanted
    assert got == mined([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()])


@pytest.mark.parametrize(("most", "inside", "top", "chunk"), [(3, 50, 2_000, 300), (4, 30, 7, 1 << 20), (2, 50, 3, 2_000)])
def test_odd_rows(spark, monkeypatch, most, inside, top, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "BUCKET", 500)
    rows = odd_rows()
    got = collocations.collocations(frame(spark, rows), max_words=most, inside=inside, top=top)
    assert given(got) == mined(rows, most, inside=inside, top=top)
    again = collocations.collocations(frame(spark, rows).orderBy(F.desc("doc_id")).coalesce(2), max_words=most, inside=inside, top=top)
    assert given(again) == given(got)


def test_fingerprints_that_clash(spark):
    """With fingerprints of a few values every phrase is frequent at first; the words decide."""
    rows = odd_rows()
    texts = [t for _, t in rows]
    data = "".join(t or "" for t in texts).encode()
    table = pa.table({"chunk": [0], "lang": ["en"], "text": [data.decode()]})
    chunk = collocations.Chunk(table)
    weak = lambda size, width: (chunk.prints(size, width)[0], chunk.prints(size, width)[1] % np.uint64(3))
    kept, collocations.Chunk = collocations.Chunk, lambda _: type("Weak", (), {**vars(chunk), "prints": staticmethod(weak), "texts": chunk.texts})
    try:
        right = pa.table({"prints": [collocations.pack(np.arange(3, dtype=np.uint64), 8)]})
        written = collocations._written(table, right, 3, 0, 8)
        found = {(r["phrase"], r["words"]): r["a"] for r in collocations._added(written, 1).to_pylist()}
    finally:
        collocations.Chunk = kept
    counts = Counter()
    for p in pieces(data.decode()):
        counts[""] += len(p)
        for k in (1, 2, 3):
            counts.update(" ".join(p[i : i + k]) for i in range(len(p) - k + 1))
    assert {p: a for (p, _), a in found.items()} == counts


def test_blocks_do_not_change_fingerprints(monkeypatch):
    """Words and phrases that cross blocks, unbroken ones of many blocks too, have the fingerprints of whole ones."""
    r = random.Random(1)
    text = "".join(r.choice(["ab", "abcdefgh" * 30, "c", "é"]) + r.choice([" ", ", ", "\n"]) for _ in range(900))
    data = np.frombuffer(text.encode() * 2, np.uint8)
    ends = np.array([len(data) // 2, len(data)])
    found = []
    for block in (64, 1 << 20):
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(shingles, "BLOCK", block)
        first, last, doc, piece = collocations.spans(data, ends)
        words = shingles.word_hashes(data, first, last)
        assert len(first) == 1_800 and (doc == np.repeat([0, 1], 900)).all() and (words[:900] == words[900:]).all()
        assert len(set(words.tolist())) == len(set(bytes(data[a:b]) for a, b in zip(first, last)))
        phrases = [collocations.phrase_prints(words, piece, np.zeros(len(words), np.uint64), k) for k in (1, 2, 3)]
        found.append([words.tolist(), *[x.tolist() for p in phrases for x in p]])
    assert found[0] == found[1]


def test_unbroken_text_of_many_blocks(spark):
    rows = [("en", "z" * 3_000_000 + " end")] * 3 + [("en", "so it is")] * 12
    found = {(r["phrase"]): r["a"] for r in collocations.frequent_phrases(frame(spark, rows), least=3).filter("words > 1").collect()}
    assert found["so it is"] == 12 and found["z" * 3_000_000 + " end"] == 3


def test_exact_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    d = spark.createDataFrame([("en", 0, "", 3 * big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], collocations.FOUND)
    [r] = collocations.scored(d).collect()
    assert r["score"] == 1_000_000 * (big - 7) ** 2 // (big * (big - 1))


def test_nothing_to_count(spark):
    assert collocations.collocations(frame(spark, odd_rows()).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [("en", None), (None, "  ")])).count() == 0
