"""Shingles and the Jaccard join against brute force."""

import random

import pyarrow as pa
import pytest

from pricewell.llm import jaccard, shingles


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_sets(monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    r = random.Random(2)
    texts = [None if r.random() < 0.05 else "".join(r.choice(["a", "B", "b", " ", "\n", "\x1c", "é", "\xa0", "  ", " c "]) for _ in range(r.choice([0, 1, 5, 20, 300]))) for _ in range(600)]
    h, c = shingles.sets(pa.array(texts).slice(3))
    seen, at = {}, 0
    for t, n in zip(texts[3:], c, strict=True):
        got = frozenset(h[at : at + n].tolist())
        at += n
        assert len(got) == n
        assert seen.setdefault(shingle_set(t), got) == got
    assert len(set(seen.values())) == len(seen)
    assert len(set(shingles.set_keys(h, c).tolist())) == len(seen)


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    while True:
        before = dict(label)
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i: (len(s), label[i]) for i, s in sets}


def corpus():
    r = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = [" ".join(say(r.choice([3, 8, 40, 90]))) for _ in range(25)]
    base, line = say(60), say(60)
    for k in range(30):  # near copies of all degrees
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(60)] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(line + say(r.choice([4, 10, 40]))) for _ in range(15)]  # a passage that many share
    texts += [texts[0]] * 3 + ["One two three four", "one TWO three four", "one two three", "", None, " \n ", "a", "A", "x y z u v", "x y z u v w"]
    chain = say(40)
    for k in range(8):  # each like the next, the ends unlike
        texts.append(" ".join(chain[2 * k :] + say(0) + [f"c{j}" for j in range(2 * k)]))
    return list(enumerate(texts, 10))


def test_join_is_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + [(None, "a b c d e f", "x", "y")], "doc_id long, text string, key string, n string").repartition(3)
    got = jaccard.join(d).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(2, None)]
    assert len({v[1] for v in want.values()}) < len(want) - 20


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in jaccard.join(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()] == [(4, 0, 4)]
