"""Language ID and toxicity by held-out accuracy and on edge cases."""

import math
import random

from pyspark.sql import functions as F

from pricewell.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right >= 0.97 * n > 0
    assert got.filter("score < 0 or score > 1").isEmpty()


def letter_words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def plain_scores(rows, texts, backoff=0.5, add=0.5):
    """The same method with dictionaries: word counts and n-gram counts by language, longest known n-gram first."""
    langs, counts = sorted({x for _, x in rows}), ({}, {})
    for text, lang in rows:
        for w in letter_words(text):
            x = f"^{w}$"
            for kind, entries in enumerate(([w], [x[i : i + k] for k in (1, 2, 3, 4) for i in range(len(x) - k + 1)])):
                for e in entries:
                    counts[kind].setdefault(e, dict.fromkeys(langs, 0))[lang] += 1
    tables = []
    for c in counts:
        total = {x: sum(v[x] for v in c.values()) for x in langs}
        logs = {e: [math.log((v[x] + add) / (total[x] + add * len(c))) for x in langs] for e, v in c.items()}
        tables.append({e: [y - sum(v) / len(v) for y in v] for e, v in logs.items()})
    out = []
    for text in texts:
        words, sums = letter_words(text), [0.0] * len(langs)
        for w in words:
            got = tables[0].get(w)
            if got is None:
                x, parts = f"^{w}$", []
                for i in range(len(x) - 1):
                    parts += [tables[1][x[i : i + k]] for k in (4, 3, 2, 1) if len(x[i : i + k]) == k and x[i : i + k] in tables[1]][:1]
                got = [backoff * sum(p[j] for p in parts) / max(1, len(parts)) for j in range(len(langs))]
            sums = [a + b for a, b in zip(sums, got)]
        z = [s / max(1, len(words)) * min(len(words), 40) for s in sums]
        best = max(range(len(langs)), key=lambda j: (z[j], -j))
        out.append((langs[best], 1 / sum(math.exp(v - z[best]) for v in z)) if words else ("und", 0.0))
    return out


def test_language_is_the_plain_scorer(spark, monkeypatch):
    r = random.Random(8)
    word = {x: ["".join(r.choice(a) for _ in range(r.randint(1, 9))) for _ in range(120)] for x, a in (("de", "abcdeßü"), ("en", "abcdefg"), ("ja", "日本語abc"))}
    say = lambda x, n: " ".join(r.choice([*word[x], "".join(r.choice("abcdefü語") for _ in range(5)), "12", "_x", "Éa"]) for _ in range(n))
    rows = [(say(x, r.randint(0, 40)), x) for x in word for _ in range(40)]
    texts = [None, "", "12 !?", "_", "ΑΣ İx", *(say(x, r.randint(0, 60)) for x in word for _ in range(30)), "abc " * 5_000]
    d = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    asked = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    want = plain_scores(rows, texts)
    for piece in (langid.words_of.__globals__["PIECE"], 50):
        monkeypatch.setitem(langid.words_of.__globals__, "PIECE", piece)
        m = langid.fit(d)
        got = [(x["lang_pred"], x["score"]) for x in langid.identify(asked, m).orderBy("k").collect()]
        assert [a for a, _ in got] == [a for a, _ in want] == m.predictions(texts)[0]
        assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(got, want, strict=True))


def test_language_backs_off_and_edges(spark):
    rows = [(k, t, x, "s") for k, (t, x) in enumerate([("the house of the king", "en"), ("das haus von dem könig", "de")] * 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    m = langid.fit(d)
    assert m.predict("the king")[0] == "en"
    assert m.predict("hauses")[0] == "de"  # unseen: by its n-grams
    assert m.predict(None) == m.predict("") == m.predict("12 !?") == ("und", 0.0)
    assert m.predict("the " * 50_000)[0] == "en"
    d = spark.createDataFrame([(1, None, "a", "b"), (2, "the king", "a", "b"), (2, "the king", "a", "b")], "doc_id long, text string, lang_pred string, score string")
    got = langid.identify(d, m)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got.collect()) == [(1, "und"), (2, "en"), (2, "en")]
    assert [tuple(r) for r in langid.recognised(d, m).collect()] == [(2, "the king", "a", "b")] * 2
    assert langid.identify(d.limit(0), m).count() == langid.recognised(d.limit(0), m).count() == 0
    none = langid.fit(d.withColumn("lang", F.lit(None).cast("string")))
    assert none.predict("the king") == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.identify(d, none).collect()} == {"und"}


def test_rare_language_keeps_its_rows_and_words(spark):
    r = random.Random(1)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    big, small = [word("abcdefgh") for _ in range(800)], [word("opqrstuv") for _ in range(60)]
    rows = [(k, " ".join(r.choice(big) for _ in range(40)), "big") for k in range(3_000)] + [(9_000 + k, " ".join(small[12 * k : 12 * k + 12]), "rare") for k in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m, again = langid.fit(d.repartition(4), max_docs=300), langid.fit(d.repartition(2), max_docs=300)
    assert m.langs == ["big", "rare"] and len(m.word_keys) > 700
    assert (m.word_keys == again.word_keys).all() and (m.gram_scores == again.gram_scores).all()
    assert all(m.predict(w)[0] == "rare" for w in small) and m.predict(" ".join(big[:30]))[0] == "big"
    assert len(langid.fit(d, max_chars=3_000).word_keys) < 500


def test_share():
    assert langid._share({"a": 5, "b": 100, "c": 100}, 65) == 30
    assert langid._share({"a": 5, "b": 7}, 100) == 7
    assert langid._share({}, 9) == 0


def toxic_rows():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for k in range(400):
        w, label = [r.choice(vocab) for _ in range(30)], int(r.random() < 0.3)
        if label:
            w[3] = r.choice(["idiot", "scum"])
        if r.random() < (0.6 if label else 0.1):  # the group is named more often in insults
            w[9] = "muslims"
        rows.append((k, " ".join(w), label))
    return rows


def test_toxicity_learns_and_spares_groups(spark):
    d = spark.createDataFrame(toxic_rows(), "doc_id long, text string, label int")
    m = toxicity.fit(d)
    free = toxicity.fit(d, swap_weight=0.0)
    assert m.score("you idiot of a person") >= 0.7
    assert m.score("muslims celebrate a holiday") < 0.5
    gap = lambda x: abs(x.score("muslims abcde") - x.score("christians abcde"))
    assert gap(m) < 0.9 * gap(free)
    assert m.swap_gap < 0.5 * free.swap_gap and m.pairs == free.pairs > 0
    assert 0 <= m.score(None) == m.score("") <= 1


def test_toxicity_held_out(spark):
    """On the given rows: counterfactual pairs there are, and held-out marks are found."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = queries.toxicity_model(docs, labels)
    assert m.pairs >= m.built > 0
    held = docs.join(labels.filter("toxic is not null"), "doc_id").filter(queries.fold(F.col("doc_id")) == 1)
    rows = toxicity.score(held, m).groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= queries.TOXIC_FROM).alias("hit")).collect()
    hit = {r["toxic"]: (r["hit"], r["n"]) for r in rows}
    assert hit[1][0] >= 0.85 * hit[1][1] and hit[0][0] <= 0.015 * hit[0][1], hit


def test_toxicity_does_not_depend_on_dealing_and_counts_rows_once(spark):
    d = spark.createDataFrame(toxic_rows(), "doc_id long, text string, label int")
    a, b = toxicity.fit(d.repartition(5)), toxicity.fit(d.unionByName(d).repartition(2))
    assert (a.ids == b.ids).all() and abs(a.score("you idiot") - b.score("you idiot")) < 1e-9
    few = toxicity.fit(d, max_docs=100)
    assert few.pairs <= 100 and few.score("you idiot scum") > 0.5


def test_toxicity_features_are_words_and_starts(monkeypatch):
    texts = ["Idiotic idiot", None, "", "idiot", "x" * 30]
    ids, n = toxicity.cells(texts)
    rows = [set(ids[a:b].tolist()) for a, b in zip(n.cumsum() - n, n.cumsum(), strict=True)]
    assert [len(x) for x in rows] == [5, 0, 0, 2, 4] and rows[3] < rows[0]  # "idio-" twice, "idiot-", "idioti-", two words
    monkeypatch.setitem(toxicity.words_of.__globals__, "PIECE", 7)
    again, m = toxicity.cells(texts)
    assert (again == ids).all() and (m == n).all()


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "x", None)], "doc_id long, text string, label int")
    one = toxicity.fit(d)
    assert 0 <= one.score("any") <= 1
    assert 0 <= toxicity.fit(d.limit(0)).score("any") <= 1
    assert toxicity.score(d.limit(0), one).count() == 0
    assert sorted(r["doc_id"] for r in toxicity.score(d.withColumn("score", F.lit("clash")), one).collect()) == [1, 2]
    assert toxicity.clean(d, toxicity.Model(bias=-3.0)).count() == 2
    assert toxicity.clean(d, toxicity.Model(bias=3.0)).count() == 0
