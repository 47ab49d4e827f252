"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pricewell.llm import additive, queries, threshold, vectors

SF = "/root/testdata/sf0.01"


def brute(ids, x, query, k):
    at = np.flatnonzero(ids == query)[0]
    s = x @ x[at]
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != query][:k]
    return [(int(ids[j]), s[j]) for j in order]


def table(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet").toArrow()
    return d.column("vec_id").to_numpy(), np.array(d.column("embedding").to_pylist(), np.float64)


def test_nearest_recall(spark):
    ids, x = table(spark)
    found = {}
    for r in queries.op4_nearest(spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, got in found.items():
        want = brute(ids, x, q, 20)
        assert sorted(r for r, *_ in got) == list(range(1, 21))
        at = np.flatnonzero(ids == q)[0]
        assert all(abs(s - x[ids == v][0] @ x[at]) < 1e-9 for _, v, s in got)
        hit += len({v for _, v, _ in got} & {v for v, _ in want})
    assert hit >= 0.9 * 20 * len(found)


def test_top_k_exact(spark):
    ids, x = table(spark)
    x = np.floor(256 * x)
    found = {}
    for r in queries.op8_exact_top_k(spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, got in found.items():
        assert [(v, s) for _, v, s in sorted(got)] == [(v, int(s)) for v, s in brute(ids, x, q, 5)]


def test_threshold_lists_stop_early_and_break_ties():
    rng = np.random.default_rng(1)
    rows = rng.integers(-3, 4, (500, 4)).astype(float)
    ids = rng.permutation(500)
    lists = threshold.Lists(rows, ids, ids)
    for q in (rows[0], np.zeros(4), np.array([5.0, 0, 0, 0]), -rows[3]):
        s = rows @ q
        want = [j for j in np.lexsort((ids, -s)) if ids[j] != 7][:6]
        got_ids, got = lists.top(q, 6, 7)
        assert list(got_ids) == [ids[j] for j in want]
        assert list(got) == [s[j] for j in want]


def test_invalid_rows_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0]), (20, [1.0, 1.0])]
    d = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    v = vectors.valid(d, zero=False)
    assert sorted(r["vec_id"] for r in v.collect()) == [1, 2, 9, 20]
    assert 7 in [r["vec_id"] for r in vectors.valid(d).collect()]
    got = additive.nearest(v, v.filter("vec_id = 20"), 20).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert additive.nearest(v.limit(0), v.limit(0)).count() == 0
    whole = threshold.integers(vectors.valid(d))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in threshold.top_k(whole, whole.filter("vec_id = 20"), 2).orderBy("rank").collect()] == [(1, 1, 65536), (2, 2, 65536)]
    assert threshold.top_k(whole.limit(0), whole.limit(0)).count() == 0


def repeated_table(spark):
    """Ids that repeat with other vectors and with the same, queries among them, and three lengths."""
    r = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=n) * 16) / 16]) for n, count in ((6, 700), (3, 40), (1, 1)) for i in r.integers(0, 60, count)]
    rows += [rows[0]] * 5 + [(20, rows[1][1])] * 4
    return rows, spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, query_id string").repartition(5)


def every_ranking(rows, k, every):
    out = []
    for a, (qid, q) in enumerate(rows):
        if qid % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(rows) if b != a and len(v) == len(q))[:k]
            out.append((qid, tuple((i, -s) for s, i in found)))
    return sorted(x for x in out if x[1])


def rankings(found):
    out = {}
    for r in found.collect():
        out.setdefault((r["query_id"], r["query_row"]), []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return sorted((k[0], tuple((i, s) for _, i, s in sorted(v))) for k, v in out.items())


def test_repeated_ids_rows_and_lengths(spark, monkeypatch):
    rows, d = repeated_table(spark)
    v = vectors.valid(d)
    assert v.count() == v.select("row").distinct().count() == len(rows)
    assert {r["row"] for r in v.collect()} == {r["row"] for r in vectors.valid(d.repartition(3)).collect()}
    assert rankings(additive.nearest(v, v.filter("vec_id % 20 = 0"), 20)) == every_ranking(rows, 20, 20)  # none has codes, or all are reranked
    whole = threshold.integers(v)
    exact = [(i, [float(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert rankings(threshold.top_k(whole, whole.filter("vec_id % 10 = 0"), 5)) == every_ranking(exact, 5, 10)
    monkeypatch.setattr(additive, "LEAST_ROWS", 30)
    books = additive.fit(v, books=4, size=8)
    assert sorted(books) == [3, 6]
    found = additive.search(additive.index(v, books), v.filter("vec_id % 20 = 0"), books, 3, rerank=0.2)
    assert [q for q, _ in rankings(found)] == [q for q, _ in every_ranking(rows, 3, 20)]


def test_l2_uses_norms():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    books = additive.train(x, 4, 16, rounds=3, refits=1)
    codes, norms = books.encode(x)
    assert np.allclose(norms, (books.sums(codes) ** 2).sum(1), rtol=1e-5)
    assert ((books.sums(codes) - x) ** 2).mean() < 0.6 * (x**2).mean()
    table = books.tables(x[:3])
    looked = sum(table[m][codes[:, m]] for m in range(4))
    assert np.allclose(looked, books.sums(codes) @ x[:3].T.astype(np.float32), atol=1e-4)
