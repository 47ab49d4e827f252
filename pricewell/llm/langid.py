"""Language identification by word-first backoff.

A word of the training vocabulary is scored by its log frequency per language. An unseen word is scored by its
character n-grams: at each position the longest known n-gram that starts there (4 down to 1 characters, the word in
"^...$") gives the log frequencies, and the mean over the positions, weighed down as a guess, is the word's score.
A text's score is the sum over its words; the posterior is taken from the mean per word times min(words, 40), so that it
says how clear a text is and not only how long.

Words and n-grams are held as 64-bit hashes in rising arrays, with a row of scores each: every word and n-gram of the
training sample is there, at some 24 bytes, and a worker keeps nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import importable, let_go, scratch
from pricewell.llm.letters import Words, find, gram_hash, words_of
from pricewell.llm.shingles import U

#: Words that count towards a posterior.
WORDS_FOR_POSTERIOR = 40
LONGEST = 4
UNKNOWN = "und"


def grams_of(words: Words, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams of k characters, the place each starts at, the word of each) of the padded words `at`."""
    codes, size = words.padded(at)
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(codes))
    place = place[place + k <= ends[word]]
    return gram_hash(codes, place, k), place, word[place]


@dataclass
class Model:
    """Rising hashes of words and of n-grams, each with a row of log frequencies by language, less their mean."""

    langs: list[str]
    word_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    gram_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    gram_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    backoff: float = 0.5

    def guessed(self, words: Words, at: np.ndarray) -> np.ndarray:
        """A row of scores for each unseen word."""
        codes, size = words.padded(at)
        begin, ends = np.cumsum(size) - size, np.cumsum(size)
        word = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(codes))
        open_ = place != ends[word] - 1  # no n-gram starts at the "$"
        got = np.full(len(codes), -1)
        for k in range(LONGEST, 0, -1):
            asked = np.flatnonzero(open_ & (place + k <= ends[word]))
            got[asked] = find(self.gram_keys, gram_hash(codes, asked, k))
            open_ &= got < 0
        known = np.flatnonzero(got >= 0)
        n = np.add.reduceat((got >= 0).astype(np.int64), begin)
        out = np.zeros((len(at), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(word[known], self.gram_scores[got[known], j].astype(np.float64), len(at))
        return self.backoff * out / np.maximum(n, 1)[:, None]

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the words' scores by language, number of words) of each text."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for w in words_of(texts):
            if not len(w.first):
                continue
            keys, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            place = find(self.word_keys, keys)
            rows = np.zeros((len(keys), len(self.langs)))
            seen = place >= 0
            rows[seen] = self.word_scores[place[seen]]
            if not seen.all():
                rows[~seen] = self.guessed(w, first[~seen])
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(w.doc, rows[back, j], len(texts))
            n += np.bincount(w.doc, minlength=len(texts))
        return total, n

    def predictions(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, posterior) of each text; UNKNOWN with 0.0 for null and for texts without a letter."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, n = self.sums(texts)
        logits = total / np.maximum(n, 1)[:, None] * np.minimum(n, WORDS_FOR_POSTERIOR)[:, None]
        best = np.argmax(logits, axis=1)  # ties: the first by name
        top = logits[np.arange(len(n)), best]
        score = 1.0 / np.exp(logits - top[:, None]).sum(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score = self.predictions([text])
        return lang[0], float(score[0])


def _share(sizes: dict[str, int], most: int) -> int:
    """The largest q for which the languages' sizes, each cut at q, sum to `most` at most, and 1 at least."""
    left, rest = most, sorted(sizes.values())
    while rest and rest[0] * len(rest) <= left:
        left -= rest.pop(0)
    return max(1, left // len(rest)) if rest else max(sizes.values(), default=0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 20_000, max_chars: int = 16_000_000) -> Model:
    """A model from about max_docs rows and max_chars characters at most of the rows with text and language.

    Both bounds are shared out evenly over the languages, and what one doesn't use goes to the others; of a language with
    more, each row is taken by a hash of its key and text, with the chance that meets its share. Every word and n-gram of
    the rows taken is learned. Tasks count them, Spark adds the counts up, and the driver receives one row per entry and
    language, fewer than the characters. Null texts and languages don't count. Without rows, the model has no language and
    predicts UNKNOWN. The result doesn't depend on how rows are dealt.
    """
    spark = docs.sparkSession
    importable(spark)
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 40))
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), h.alias("h"))
    sizes = {r["l"]: r for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([])
    docs_each, chars_each = _share({x: r["n"] for x, r in sizes.items()}, max_docs), _share({x: r["c"] for x, r in sizes.items()}, max_chars)
    cuts = [(x, k, int((1 << 40) * min(1.0, docs_each / r["n"], chars_each / max(1, r["c"])))) for k, (x, r) in enumerate(sorted(sizes.items()))]
    known = F.broadcast(spark.createDataFrame(cuts, "l string, k int, cut long"))  # a row per language
    taken = rows.join(known, "l").filter(F.col("h") < F.col("cut")).select("t", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lang_of = part.column(1).to_numpy()
                for w in words_of(part.column(0).to_pylist()):
                    of = lang_of[w.doc]
                    for k in np.unique(of):
                        keys, first, back = np.unique(w.hashes()[of == k], return_index=True, return_inverse=True)
                        at, n = np.flatnonzero(of == k)[first], np.bincount(back)
                        yield _counted(0, k, keys, n)
                        for size in range(1, LONGEST + 1):
                            hashes, _, word = grams_of(w, at, size)
                            found, inverse = np.unique(hashes, return_inverse=True)
                            yield _counted(1, k, found, np.bincount(inverse, n[word]).astype(np.int64))

    with scratch(spark) as kept:
        counts = kept(taken.mapInArrow(run, "gram int, k int, h long, n long").groupBy("gram", "h", "k").agg(F.sum("n").alias("n")), "lang-counts")
        got = counts.toArrow()
    gram, hashes, k, n = (got.column(c).to_numpy() for c in ("gram", "h", "k", "n"))
    tables = []
    for kind in (0, 1):
        mine = gram == kind
        keys, row = np.unique(hashes[mine].view(U), return_inverse=True)
        count = np.zeros((len(keys), len(langs)))
        count[row, k[mine]] = n[mine]
        tables += [keys, _log_table(count)]
    return Model(langs, *tables)


def _counted(gram: int, k: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, gram, np.int32)), pa.array(np.full(size, k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "k", "h", "n"])


def _log_table(counts: np.ndarray, add: float = 0.5) -> np.ndarray:
    """Per language log((count + add) / (total + add * entries)), less the mean over the languages."""
    v = np.log((counts + add) / (counts.sum(axis=0) + add * max(1, len(counts))))
    return (v - v.mean(axis=1, keepdims=True)).astype(np.float32)


def predictor(docs: DataFrame, model: Model, text: Column) -> Column:
    """Column expression of a struct (lang_pred, score): only texts go to Python, and only predictions come back."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        m = shared.value
        for batch in batches:
            made = [m.predictions(batch.slice(i, 512).to_pylist()) for i in range(0, len(batch), 512)]
            lang, score = [x for a, _ in made for x in a], np.concatenate([np.zeros(0), *(b for _, b in made)])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text) plus lang_pred and score of every whole text.

    A null text and one without a letter give UNKNOWN and 0. Repeated rows each keep a row. Columns of docs that are named
    lang_pred or score are replaced. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "lang_pred", "score")]
    made = docs.select(*keep, predictor(docs, model, docs[text]).alias("_made"))
    return made.select(*keep, "_made.lang_pred", "_made.score")


def recognised(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is predicted (not UNKNOWN) with a score of `least` or more."""
    made = predictor(docs, model, docs[text])
    return docs.filter((made["lang_pred"] != UNKNOWN) & (made["score"] >= least))
