"""Phrases whose words go together, mined by Rabin-Karp fingerprints of all n-grams.

1. Rows are dealt to chunks of about CHUNK bytes, stored once. Words end at blanks and tabs, pieces at .,;:!? and line ends;
   a phrase never leaves its piece. A prefix polynomial over the bytes gives each word's fingerprint, one over the words that
   of each phrase of up to max_words words, both within blocks of fixed size, so that a text without blanks takes no more memory.
2. Each chunk sends its fingerprints, once each, with their number and a pointer to the chunk to buckets of the fingerprint range. A
   bucket adds up and sends those of `least` occurrences or more back to the chunks that hold them: no list of all of them
   goes anywhere as a whole.
3. A chunk writes out the words of its frequent fingerprints only, told apart by the words themselves, and buckets add up equal
   phrases: fingerprints that clash cost time and change no count.
4. Scores, contained phrases and ranks are joins and aggregations of the frequent phrases.

A fingerprint has as many bytes as tell the phrases of a corpus of its size apart mostly. However frequent a phrase is, a
chunk sends it once. Null texts are empty, null languages are `und`; repeated rows count as often as they are there;
further columns are left alone; an empty table gives no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.llm import shingles
from pricewell.llm.common import importable, scratch, stored
from pricewell.llm.shingles import LOWER, mix

U = np.uint64
#: Bytes of text of a chunk, phrases of a bucket, bytes or words hashed at once.
CHUNK, BUCKET, BLOCK = 4 << 20, 4 << 20, 1 << 20
#: Phrases of a language that are ranked together are the best of so many parts.
PARTS = 32
MOST_WORDS = 16
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[32, 9]] = True


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, document, piece) of each word of the bytes of documents that end at `ends`."""
    inside = ~GAP[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = ends > starts
    before[starts[full]] = False
    after[ends[full] - 1] = False
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(ends, first, "right")
    return first, last, doc, np.searchsorted(np.flatnonzero(BREAK[data]), first) + doc


def phrase_prints(words: np.ndarray, piece: np.ndarray, salt: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of each phrase of `size` words within a piece; salt tells the languages of words apart."""
    up, down = shingles.powers(BLOCK + MOST_WORDS)
    n = max(0, len(words) - size + 1)
    begin = np.flatnonzero(piece[:n] == piece[size - 1 :]) if n else np.zeros(0, np.int64)
    out = np.zeros(len(begin), U)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + size]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        a, b = np.searchsorted(begin, [at, at + BLOCK])
        i = begin[a:b] - at
        out[a:b] = (sums[i + size] - sums[i]) * down[i]
    return begin, mix(out + salt[begin] + U(size))


def pack(prints: np.ndarray, width: int) -> bytes:
    """Rising fingerprints as the gaps between them, all first bytes first: those are mostly 0, which Spark's compression saves."""
    gaps = np.diff(prints, prepend=U(0)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return np.ascontiguousarray(gaps.T).tobytes()


def unpack(blobs: list[bytes], width: int) -> np.ndarray:
    """The fingerprints of packed lists, one list after the other."""
    out = [np.zeros(0, U)]
    for blob in blobs:
        full = np.zeros((len(blob) // width, 8), np.uint8)
        full[:, 8 - width :] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
        out.append(np.cumsum(full.view(">u8").ravel().astype(U)))
    return np.concatenate(out)


CHUNKS = "chunk long, lang string, text string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of the chunk that each begins in."""
    base, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = size + np.cumsum(lengths)
        yield pa.RecordBatch.from_arrays([pa.array(base + (ends - lengths) // CHUNK), batch.column(0), batch.column(1)], ["chunk", "lang", "text"])
        size = int(ends[-1]) if len(ends) else size


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each chunk, which follow each other; a chunk that two tasks read is given by both."""
    now, parts = None, []
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
        for i, j in zip(cut, [*cut[1:], len(numbers)]):
            if numbers[i] != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                now, parts = int(numbers[i]), []
            parts.append(batch.slice(i, j - i))
    if parts:
        yield now, pa.Table.from_batches(parts)


class Chunk:
    """The words of some rows: places, pieces, languages, fingerprints."""

    def __init__(self, rows: pa.Table):
        langs = rows.column("lang").combine_chunks().fill_null("und").dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        texts = pa.concat_arrays([x.cast(pa.large_string()) for x in rows.column("text").chunks] or [pa.array([], pa.large_string())]).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.langs = langs.dictionary.to_pylist()
        self.first, self.last, doc, self.piece = spans(self.data, offsets[1:] - offsets[0])
        self.lang = langs.indices.to_numpy()[doc]
        self.words = shingles.word_hashes(self.data, self.first, self.last)
        salts = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.salt = np.array(salts, U)[self.lang]

    def prints(self, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        begin, found = phrase_prints(self.words, self.piece, self.salt, size)
        return begin, found >> U(64 - 8 * width)

    def texts(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, the words by number): equal words have equal numbers, exactly."""
        inside = ~GAP[self.data]
        offsets = np.concatenate([[0], np.cumsum(self.last - self.first)]).astype(np.int64)
        raw = LOWER[self.data[inside]]
        words = pa.LargeStringArray.from_buffers(len(self.first), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary


def edges(prints: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where each of 2^bits buckets begins and ends among rising fingerprints."""
    bounds = (np.arange(1 << bits, dtype=np.uint64)) << U(8 * width - bits)
    return np.append(np.searchsorted(prints, bounds), len(prints))


DEALT = "bucket int, chunk long, prints binary, counts binary"


def _deal(batches: Iterator[pa.RecordBatch], max_words: int, bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of each chunk, once each, with their number, by bucket."""
    for number, rows in _by_chunk(batches):
        chunk = Chunk(rows)
        found = np.sort(np.concatenate([chunk.prints(k, width)[1] for k in range(1, max_words + 1)]))
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        counts = np.minimum(np.diff(np.append(starts, len(found))), 65_535).astype(np.uint16)
        found = found[starts]
        cut = edges(found, bits, width)
        full = np.flatnonzero(np.diff(cut))
        if len(full):
            columns = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number)), pa.array([pack(found[cut[b] : cut[b + 1]], width) for b in full], pa.binary()), pa.array([counts[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "prints", "counts"])


def _frequent(t: pa.Table, least: int, width: int) -> pa.Table:
    """chunk, prints: of one bucket, the frequent fingerprints of each chunk that holds some."""
    chunks, blobs = t.column("chunk").to_numpy(), t.column("prints").to_pylist()
    prints = unpack(blobs, width)
    counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint16).astype(np.int64)
    order = np.argsort(prints, kind="stable")
    rising = prints[order]
    starts = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]]))
    good = np.add.reduceat(counts[order], starts) >= min(least, 65_535)
    keep = np.zeros(len(prints), bool)
    keep[order] = np.repeat(good, np.diff(np.append(starts, len(rising))))
    ends = np.cumsum([len(b) // width for b in blobs])
    out = [(int(c), pack(prints[a:b][keep[a:b]], width)) for c, a, b in zip(chunks, np.append(0, ends[:-1]), ends, strict=True) if keep[a:b].any()]
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "prints": pa.array([p for _, p in out], pa.binary())})


WRITTEN = "bucket int, texts binary, lengths binary, counts binary"


def _written(left: pa.Table, right: pa.Table, max_words: int, bits: int, width: int) -> pa.Table:
    """By bucket, the frequent phrases of a chunk as `language TAB words`, once each, with their number; and its words in all."""
    out = []
    if left.num_rows:
        chunk = Chunk(left)
        wanted = np.sort(unpack(right.column("prints").to_pylist(), width))
        numbers, names = chunk.texts()
        langs = pa.array(chunk.langs, pa.large_string())
        totals = np.bincount(chunk.lang, minlength=len(langs)) if len(numbers) else np.zeros(len(langs), np.int64)
        out.append((np.zeros(len(langs), U), glued(langs, pa.scalar("", pa.large_string()), by="\t"), totals))
        for size in range(1, max_words + 1):
            begin, prints = chunk.prints(size, width)
            at = np.minimum(np.searchsorted(wanted, prints), max(0, len(wanted) - 1))
            hit = wanted[at] == prints if len(wanted) else np.zeros(len(prints), bool)
            begin, prints = begin[hit], prints[hit]
            if not len(begin):
                continue
            order = np.argsort(prints, kind="stable")
            begin, prints = begin[order], prints[order]
            new = prints[1:] != prints[:-1]
            for k in range(size):  # the words decide, and the language, so that fingerprints that clash don't matter
                new |= numbers[begin[1:] + k] != numbers[begin[:-1] + k]
            new |= chunk.lang[begin[1:]] != chunk.lang[begin[:-1]]
            starts = np.flatnonzero(np.append(True, new))
            counts = np.diff(np.append(starts, len(begin)))
            one = begin[starts]
            phrase = glued(*[names.take(pa.array(numbers[one + k])) for k in range(size)], by=" ")
            out.append((prints[starts], glued(langs.take(pa.array(chunk.lang[one])), phrase, by="\t"), counts))
    rows = []
    for prints, texts, counts in out:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw, cut = memoryview(texts.buffers()[2] or b""), edges(prints, bits, width)
        lengths, counts = np.diff(offsets).astype(np.uint32), counts.astype(np.int64)
        for b in np.flatnonzero(np.diff(cut)):
            i, j = int(cut[b]), int(cut[b + 1])
            rows.append((int(b), bytes(raw[offsets[i] : offsets[j]]), lengths[i:j].tobytes(), counts[i:j].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "texts", "lengths", "counts"])


def glued(*parts, by: str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(by, pa.large_string()))


FOUND = "lang string, words int, phrase string, a long"


def _added(t: pa.Table, least: int) -> pa.Table:
    """Of one bucket, the phrases of `least` occurrences or more, and the number of words of each language (words 0)."""
    joined = lambda c: b"".join(t.column(c).to_pylist())
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(joined("lengths"), np.uint32), dtype=np.int64)])
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(joined("texts")))
    sums = pa.table({"text": texts, "a": np.frombuffer(joined("counts"), np.int64)}).group_by("text").aggregate([("a", "sum")])
    whole = pc.ends_with(sums.column("text"), "\t")
    sums = sums.filter(pc.or_(whole, pc.greater_equal(sums.column("a_sum"), least)))
    parts = pc.split_pattern(sums.column("text"), "\t", max_splits=1, reverse=True)
    phrase = pc.list_element(parts, 1).cast(pa.string())
    words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
    return pa.table({"lang": pc.list_element(parts, 0).cast(pa.string()), "words": words, "phrase": phrase, "a": sums.column("a_sum")})


def frequent_phrases(docs: DataFrame, max_words: int = 3, least: int = 10) -> DataFrame:
    """lang, words, phrase, a: phrases of 1 to max_words words that occur `least` times or more in a language.

    Rows of 0 words have the number of all words of a language. docs: lang, text.
    """
    if not 2 <= max_words < MOST_WORDS or not 1 <= least <= 65_535:
        raise ValueError("max_words from 2 to 15, least from 1 to 65535")
    spark = docs.sparkSession
    importable(spark)
    with scratch(spark) as put:
        chunks = put(docs.select("lang", "text").mapInArrow(_chunks, CHUNKS), "phrases-chunks")
        size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        most = max_words * size // 4  # about so many phrases, as a word and its gap have four bytes or more mostly
        bits = (most // BUCKET).bit_length()
        width = min(8, max(4, -(-(most.bit_length() + 8) // 8)))
        dealt = chunks.mapInArrow(lambda it: _deal(it, max_words, bits, width), DEALT)
        lists = dealt.groupBy("bucket").applyInArrow(lambda t: _frequent(t, least, width), "chunk long, prints binary")
        written = chunks.groupBy("chunk").cogroup(lists.groupBy("chunk")).applyInArrow(lambda a, b: _written(a, b, max_words, bits, width), WRITTEN)
        return stored(written.groupBy("bucket").applyInArrow(lambda t: _added(t, least), FOUND), "phrases")


def cuts(phrase: str = "phrase"):
    """(k, left, right) of each way to cut a phrase in two after k words."""
    w = F.split(phrase, " ")
    text = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    return F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.struct(k.alias("k"), text(F.lit(1), k).alias("left"), text(k + 1, F.size(w) - k).alias("right")))


def inner_phrases(phrase: str = "phrase"):
    """The shorter phrases of two words or more within a phrase, once each."""
    w = F.split(phrase, " ")
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) > 2, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), of))))


def scored(found: DataFrame, inside: int = 50) -> DataFrame:
    """lang, phrase, words, a, k, l, r, n, score of the frequent phrases of two words or more that no longer one holds.

    The score, floor(1000000 a a / (l r)), is that of the worst cut in two parts, l and r times found, after k words, ties to the
    smaller k. A phrase goes if a longer frequent one with `inside` percent of its occurrences or more holds its words in a row.
    """
    d = found.filter("words >= 2").select("lang", "phrase", "words", "a")
    parts = found.filter("words >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias("_f"))
    cut = d.withColumn("c", F.explode(cuts())).select("lang", "phrase", "words", "a", "c.*")
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).withColumnRenamed("_f", name).drop("_lang", "_part")
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    over, under = F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a"), whole("l") * whole("r")
    cut = cut.withColumns({"_over": over, "_under": under}).withColumn("score", F.expr("_over div _under"))
    best = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "words", "a", "b.*")
    held = d.filter("words > 2").select("lang", "a", F.explode(inner_phrases()).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    best = best.join(held, ["lang", "phrase"], "left").filter(F.col("_around").isNull() | (100 * F.col("_around") < inside * F.col("a"))).drop("_around")
    totals = found.filter("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return best.join(totals, "lang")


def ranked(d: DataFrame, top: int) -> DataFrame:
    """d with `rank`: the `top` best of each language by score, a and phrase; first those of PARTS parts of each, then among them."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = d.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "_part")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2_000) -> DataFrame:
    """lang, rank, phrase, words, a, k, l, r, n, score: the best phrases of each language."""
    return ranked(scored(frequent_phrases(docs, max_words, least), inside), top)
