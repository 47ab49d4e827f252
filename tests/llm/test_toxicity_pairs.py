"""The counterfactual pairs behind a toxicity model, and neutral mentions of groups."""

import random

from pricewell.llm import toxicity


def fixture():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for k in range(400):
        w, label = [r.choice(vocab) for _ in range(30)], int(r.random() < 0.3)
        if label:
            w[3] = r.choice(["idiot", "scum"])
        if r.random() < (0.6 if label else 0.1):
            w[9] = r.choice(["muslims", "women", "refugees"])
        rows.append((k, " ".join(w), label))
    neutral = [" ".join([r.choice(vocab) for _ in range(20)] + [g]) for g in ("muslims", "women", "refugees") for _ in range(20)]
    return rows, neutral


def test_pairs_are_counted_and_neutral_mentions_fare_no_worse(spark):
    rows, neutral = fixture()
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    named = sum(toxicity.swapped(t) is not None for _, t, _ in rows)
    assert m.pairs == len(rows) and m.built == len(rows) - named > 0  # fewer than least_pairs name a group
    free = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), swap_weight=0.0)
    wrong, wrong_free, bare = (sum(x.score(t) >= 0.7 for t in texts) for x, texts in ((m, neutral), (free, neutral), (m, [t.rsplit(" ", 1)[0] for t in neutral])))
    print("false positives on neutral mentions", wrong, "without swaps", wrong_free, "without the group's word", bare, "of", len(neutral), "pairs", m.pairs)
    assert wrong <= wrong_free
    assert m.swap_gap < free.swap_gap
    few = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), least_pairs=0)
    assert few.pairs == named and few.built == 0


def test_swaps():
    assert toxicity.swapped("The Women, muslims!") == "the men, christians!"
    assert toxicity.swapped("womenfolk and mankind") is None
