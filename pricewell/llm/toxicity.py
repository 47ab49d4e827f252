"""Toxicity: a counterfactual-regularised logistic classifier.

Features are the distinct words of a text and the distinct word starts of 4 to 6 letters, hashed, each present or not.
For each training text that names an identity group, copies are made with the group's terms swapped for other groups' and
with no group in their place, and the loss adds weight * (logit - logit of the copy)^2 for each, which keeps scores alike
when only the group named changes and keeps a mere mention from counting.
Where few labelled texts name a group, a mention is put into others, whatever their label, so that the penalty has pairs
to work on. An L1 term sets the weights of uninformative features to zero, so that long texts don't add up noise. Scores
are calibrated on logits of rows that the scoring model has not seen (Platt's method over two folds).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import importable, let_go, scratch
from pricewell.llm.letters import words_of
from pricewell.llm.shingles import U

#: Identity terms by kind; a term is swapped for the next of its row. Fixed values of this module, open to extension.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["female", "male"], ["girls", "boys"], ["girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "natives"], ["immigrant", "refugee", "foreigner", "native"],
    ["mexican", "chinese", "american", "russian", "indian", "german", "french", "spanish"], ["disabled", "deaf", "blind", "elderly", "young"],
    ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden"], ["ausländer", "flüchtlinge", "deutsche"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulmans", "chrétiens", "juifs"], ["étrangers", "réfugiés", "français"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "refugiados", "españoles"],
]
SWAP = {w: row[(k + 1) % len(row)] for row in IDENTITY_TERMS for k, w in enumerate(row)}
TERMS = list(SWAP)
NAMED = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")(?![^\W\d_])")
BITS = 22


def swapped(text: str) -> str | None:
    """The text with every identity term swapped; None if it has none."""
    out, n = NAMED.subn(lambda m: SWAP[m[0]], text.lower())
    return out if n else None


def cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature ids, distinct and rising within each text; how many each text has)."""
    made = []
    for w in words_of(texts):
        parts = [(w.doc, w.hashes())]
        for k in (4, 5, 6):
            h, at = w.starts(k)
            parts.append((w.doc[at], h))
        made += [np.unique(doc.astype(np.int64) << BITS | (h >> U(64 - BITS)).astype(np.int64)) for doc, h in parts]
    both = np.unique(np.concatenate(made)) if made else np.zeros(0, np.int64)
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.bincount(both >> BITS, minlength=len(texts))


@dataclass
class Model:
    """Feature ids (rising) with their weights, the bias, and the calibration: score = 1 / (1 + exp(-(slope * logit + shift))).

    pairs is the number of training texts that had a counterfactual, built of them those whose mention was put in;
    swap_gap is the mean change of the logit between the two. Without pairs it is 0 and says nothing about bias.
    """

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    swap_gap: float = 0.0
    pairs: int = 0
    built: int = 0

    def table(self) -> np.ndarray:
        """Weights by feature id."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out

    def scores(self, texts: list[str | None], table: np.ndarray | None = None) -> np.ndarray:
        """Scores of whole texts, null counting as empty; texts are taken some hundred at a time."""
        table, out = self.table() if table is None else table, np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            ids, n = cells(texts[at : at + 256])
            out[at : at + 256] = np.bincount(np.repeat(np.arange(len(n)), n), table[ids], len(n))
        z = self.slope * (out + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_docs: int = 20_000, epochs: int = 150, l1: float = 0.0005, swap_weight: float = 0.5, sample_cells: int = 3_000_000, least_pairs: int = 1_000) -> Model:
    """A model from labelled rows, labels 0 or 1: at most max_docs rows, sample_cells feature ids and about 8 characters for each.

    Rows with null label don't count; a null text counts as empty; rows alike in key and text count once. Beyond the
    bounds the rows with the smallest hashes are taken: tasks make the feature ids, a count by hash range finds where the
    bounds are met, and only rows below that reach the driver. Rows that name an identity group have a counterfactual; if
    they are fewer than least_pairs, a mention is put into other rows, which take part with it. Without rows of both
    labels, the model is the constant share of label 1 (0.5 without rows).
    """
    spark = labelled.sparkSession
    importable(spark)
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 40))
    rows = labelled.filter(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("double").alias("y"), h.alias("h"))
    n = rows.count()
    # the mean length, from some 2,000 rows by the same hash: before a join that made the rows, only their texts travel
    mean = rows.filter(F.col("h") < int((1 << 40) * min(1.0, 2_000 / max(n, 1)))).agg(F.avg(F.length("t"))).first()[0] or 0.0
    share = min(1.0, 1.2 * max_docs / max(n, 1), 8 * sample_cells / max(n * mean, 1))
    if share < 1:
        rows = rows.filter(F.col("h") < int((1 << 40) * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, y, h = (part.column(k).to_pylist() for k in range(3))
                swaps = [swapped(x) for x in texts]
                terms = [TERMS[v % len(TERMS)] for v in h]
                own = _keys(*cells(texts))
                with_term = _keys(*cells([x if s is not None else t for x, s, t in zip(texts, swaps, terms, strict=True)]))
                other = _keys(*cells([s if s is not None else SWAP[t] for s, t in zip(swaps, terms, strict=True)]))
                named = np.array([s is not None for s in swaps])
                without = np.concatenate([_keys(*cells([None if s is None else NAMED.sub(" ", x.lower()) for x, s in zip(texts, swaps, strict=True)])), own[~named[own >> BITS]]])
                kept = lambda a, b: np.setdiff1d(a, np.concatenate([b, own[~named[own >> BITS]]]))
                lists = [_lists(x, len(texts)) for x in (own, kept(with_term, other), kept(other, with_term), np.setdiff1d(with_term, without))]
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(h), pa.array(named), *lists], ["y", "h", "named", "ids", "plus", "minus", "mention"])

    with scratch(spark) as kept:
        made = kept(rows.mapInArrow(run, "y double, h long, named boolean, ids array<int>, plus array<int>, minus array<int>, mention array<int>").dropDuplicates(["h"]), "toxicity-cells")
        bucket = F.expr(f"h div {max(1, int((1 << 40) * share) >> 12)}")
        sizes = made.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("c"), F.count_if("named").alias("m")).orderBy("b").collect()
        fits = sum(a <= max_docs and b <= sample_cells for a, b in zip(accumulate(r["n"] for r in sizes), accumulate(r["c"] for r in sizes), strict=True))
        used = sizes[: max(1, fits)]
        if not used:
            return Model()
        lack, up_to = least_pairs - sum(r["m"] for r in used), -1
        for r in used:  # the hash ranges whose rows get a mention
            if lack > 0:
                lack, up_to = lack - (r["n"] - r["m"]), r["b"]
        built = ~F.col("named") & (bucket <= up_to)
        none = F.array().cast("array<int>")
        in_pair = lambda c: F.when(built | F.col("named"), F.col(c)).otherwise(none)
        near = made.filter(bucket <= used[-1]["b"])
        got = near.select("y", "h", built.alias("built"), F.when(built, F.concat("ids", "mention")).otherwise(F.col("ids")).alias("ids"), *[in_pair(c).alias(c) for c in ("plus", "minus", "mention")]).toArrow().sort_by("h")
    y, n_built = got.column("y").to_numpy(), got.column("built").to_pylist().count(True)
    mine, *pairs = (_rows(got.column(c).combine_chunks()) for c in ("ids", "plus", "minus", "mention"))
    del got
    return trained(mine, y, pairs, epochs, l1, swap_weight, n_built)


def _keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Row and feature id in one number, rising."""
    return np.repeat(np.arange(counts.size, dtype=np.int64), counts) << BITS | ids


def _lists(keys: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(rows + 1) << BITS).astype(np.int32)), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)))


Rows = tuple[np.ndarray, np.ndarray]


def _rows(lists: pa.Array) -> Rows:
    """(cells, cells per row) of an Arrow list array."""
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _some(rows: Rows, take: np.ndarray) -> Rows:
    return rows[0][np.repeat(take, rows[1])], rows[1][take]


def trained(rows: Rows, y: np.ndarray, pairs: list[Rows], epochs: int, l1: float, swap_weight: float, built: int = 0) -> Model:
    """A calibrated model: the calibration comes from two models, each scoring the half of the rows it has not seen."""
    if y.min() == y.max():
        share = float(y.mean())
        return Model(bias=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    model = train(rows, y, pairs, epochs, l1, swap_weight)
    model.built = built
    order = np.argsort(y, kind="stable")  # both halves get half of each label
    half = np.zeros(y.size, bool)
    half[order[::2]] = True
    seen, z = np.zeros(y.size, bool), np.zeros(y.size)
    for take in (half, ~half):
        if take.any() and y[take].min() < y[take].max():
            part = train(_some(rows, take), y[take], [_some(p, take) for p in pairs], epochs, l1, swap_weight)
            ids, n = _some(rows, ~take)
            z[~take] = part.bias + np.bincount(np.repeat(np.arange(n.size), n), part.table()[ids], n.size)
            seen |= ~take
    if seen.any() and y[seen].min() < y[seen].max():
        model.slope, model.shift = platt(z[seen], y[seen])
    return model


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, shift) of the logistic fit of y on z with Platt's targets, by damped Newton steps; the slope is 0 at least."""
    up, down = y.sum(), y.size - y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([0.0, np.log((up + 1) / (down + 1))])
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - t @ (x @ w))
    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - t))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step
        new = loss(w)
        if at - new < 1e-9 * max(1.0, abs(at)):
            break
        at = new
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((up + 1) / (down + 1))))


def train(rows: Rows, y: np.ndarray, pairs: list[Rows], epochs: int, l1: float, swap_weight: float) -> Model:
    """Accelerated proximal gradient on mean log loss + l1 |w| + swap_weight * mean squared change of the logit.

    pairs: per row, the feature ids that only it has and that only its swapped copy has, and those that only it has beside
    its copy without a group; none where it has no counterfactual. Features of fewer than 3 rows don't count.
    """
    df = np.bincount(rows[0], minlength=1 << BITS)
    known = np.flatnonzero(df >= 3).astype(np.int32)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)

    def compact(r: Rows) -> tuple[np.ndarray, np.ndarray]:
        at, row = place[r[0]], np.repeat(np.arange(r[1].size, dtype=np.int32), r[1])
        keep = at >= 0
        return at[keep], row[keep]

    at, row_of = compact(rows)
    df, dims, n = df[known], len(known), y.size
    plus, minus, mention = pairs
    swap_rows, mention_rows = np.flatnonzero((plus[1] > 0) | (minus[1] > 0)), np.flatnonzero(mention[1] > 0)
    k, n_pairs = swap_rows.size, swap_rows.size + mention_rows.size
    sides = [compact(p) for p in pairs]
    d_at = np.concatenate([x for x, _ in sides])
    d_row = np.concatenate([np.searchsorted(swap_rows, sides[0][1]), np.searchsorted(swap_rows, sides[1][1]), k + np.searchsorted(mention_rows, sides[2][1])]).astype(np.int32)
    d_sign = np.repeat(np.array([1, -1, 1], np.int8), [len(x) for x, _ in sides])
    # the bias stays at the log odds of label 1: a text without known features gets the base rate, however short it is
    w, bias, v, t = np.zeros(dims), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(dims), 1.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    pull = 2 * swap_weight / n

    def summed(values: np.ndarray, cols: np.ndarray, rows_: np.ndarray, size: int, sign: np.ndarray | None = None, block: int = 1 << 20) -> np.ndarray:
        """Per row, the sum of values[col] * sign; a block of cells at a time, so that temporaries stay small."""
        out = np.zeros(size)
        for i in range(0, len(cols), block):
            x = values[cols[i : i + block]]
            out += np.bincount(rows_[i : i + block], x if sign is None else x * sign[i : i + block], size)
        return out

    # a step per feature that bounds the curvature: by Cauchy's inequality with shares 1/sqrt(df), largest for rare ones
    share = 1 / np.sqrt(df + 1.0)
    bend = summed(weight / 4 * (summed(share, at, row_of, n) + 1), row_of, at, dims)
    if n_pairs:
        bend += pull * summed(summed(share, d_at, d_row, n_pairs), d_row, d_at, dims)
    rate = share / np.maximum(bend, 1e-12)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(summed(v, at, row_of, n) + bias, -40, 40)))
        g = summed(weight * (p - y), row_of, at, dims)
        if n_pairs:
            g += pull * summed(summed(v, d_at, d_row, n_pairs, d_sign), d_row, d_at, dims, d_sign)
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - w) @ (v - new) > 0:  # restart the momentum where it points uphill
            t_new = 1.0
        v = new + (t - 1) / t_new * (new - w)
        moved = np.abs(new - w).max(initial=0.0)
        w, t = new, t_new
        if moved < 1e-4:
            break
    gap = float(np.abs(summed(w, d_at, d_row, n_pairs, d_sign)[:k]).mean()) if k else 0.0
    keep = np.abs(w) > 1e-6
    return Model(known[keep], w[keep], bias, swap_gap=gap, pairs=int(k))


def scorer(docs: DataFrame, model: Model, text: Column) -> Column:
    """Column expression of the score: only texts go to Python, and only scores come back."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        m = shared.value
        table = m.table()
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(m.scores(batch.slice(i, 512).to_pylist(), table) for i in range(0, len(batch), 512))]), pa.float64())

    return scored(text)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns `keep` (all but the text) plus `out`: double from 0 to 1 of every whole text.

    A null text counts as empty. Repeated rows each keep a row. A column of docs that is named like `out` is replaced. An
    empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in (text, out)] if keep is None else [c for c in keep if c != out]
    return docs.select(*keep, scorer(docs, model, docs[text]).alias(out))


def clean(docs: DataFrame, model: Model, reject_from: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose whole text scores below reject_from; handles rows as score() does."""
    return docs.filter(scorer(docs, model, docs[text]) < reject_from)
