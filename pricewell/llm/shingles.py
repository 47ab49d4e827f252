"""Word shingles of whole texts as 64-bit hashes, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier and its inverse modulo 2^64, for rolling hashes of the bytes of words.
STEP = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(STEP, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once.
BLOCK = 1 << 20

#: Tables up to this many powers are kept in a worker.
KEPT = 1 << 21

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP^i and STEP^-i modulo 2^64 for i < n."""
    size = 1 << max(20, int(n).bit_length())
    if size in _powers:
        return _powers[size]
    made = []
    for base in (STEP, INVERSE):
        a = np.full(size, base, U)
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    if size <= KEPT:
        _powers.clear()
        _powers[size] = made[0], made[1]
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, document of each word); ends: where each document ends in the bytes `data`."""
    word = ~SPACE[data]
    before = np.empty(len(word), bool)
    before[:1], before[1:] = False, word[:-1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = ends > starts
    before[starts[full]] = False
    first = np.flatnonzero(word & ~before)
    after = np.empty(len(word), bool)
    after[-1:], after[:-1] = False, word[1:]
    after[ends[full] - 1] = False
    last = np.flatnonzero(word & ~after) + 1
    return word_hashes(data, first, last), np.searchsorted(ends, first, "right")


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each lower-cased word, from byte `first` to `last`: the difference of two prefix sums, moved to place 0.

    Sums are taken a block of bytes at a time, so that a text without white space takes no more memory than another.
    """
    up, down = powers(BLOCK)
    out, total = np.zeros(len(first), U), 0
    for at in range(0, len(data), BLOCK):
        part = LOWER[data[at : at + BLOCK]].astype(U) + U(1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        sums = sums * U(pow(STEP, at, 1 << 64)) + U(total)
        a, b = np.searchsorted(first, [at, at + BLOCK])
        out[a:b] -= sums[first[a:b] - at]
        c, d = np.searchsorted(last, [at, at + BLOCK], "right")
        out[c:d] += sums[last[c:d] - at]
        total = int(sums[-1])
    for at in range(0, len(data), BLOCK):
        a, b = np.searchsorted(first, [at, at + BLOCK])
        out[a:b] *= down[first[a:b] - at] * U(pow(INVERSE, at, 1 << 64))
    return mix(out + (last - first).astype(U))


def sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, distinct and rising within each document; how many each document has)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    hashes, docs, i, n = [], [], 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        at, end = int(offsets[i]), int(offsets[j])
        h, d = words(data[at:end], offsets[i + 1 : j + 1] - at)
        hashes.append(h)
        docs.append(d + i)
        i = j
    w = np.concatenate(hashes) if hashes else np.zeros(0, U)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    per_doc = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    place = np.arange(len(w)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    many = per_doc >= width
    out, whose = [], []
    if len(w) >= width:
        total = np.zeros(len(w) - width + 1, U)
        for k in range(width):
            total += mix(w[k : k + len(total)] + U(k + 1)) * U(2 * k + 3)
        ok = doc[: len(total)] == doc[width - 1 :]
        out.append(mix(total[ok]))
        whose.append(doc[: len(total)][ok])
    few = (per_doc > 0) & ~many
    if few.any():
        mine = few[doc]
        part = mix(w[mine] + U(101) + place[mine].astype(U)) * (2 * place[mine] + 7).astype(U)
        begins = np.cumsum(per_doc[few]) - per_doc[few]
        out.append(mix(np.add.reduceat(part, begins) + per_doc[few].astype(U)))
        whose.append(np.flatnonzero(few))
    if not out:
        return np.zeros(0, U), np.zeros(n, np.int64)
    h, whose = np.concatenate(out), np.concatenate(whose)
    if len(out) > 1:
        order = np.argsort(whose, kind="stable")
        h, whose = h[order], whose[order]
    counts = np.bincount(whose, minlength=n)
    stops = np.cumsum(counts)
    for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (whose[1:] == whose[:-1])
    return h[~same], np.bincount(whose[~same], minlength=n)


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each document's set; 0 of an empty one."""
    out = np.zeros(len(counts), U)
    full = counts > 0
    if full.any():
        begins = (np.cumsum(counts) - counts)[full]
        out[full] = mix(np.add.reduceat(mix(hashes ^ U(0xD6E8FEB86659FD93)), begins) + counts[full].astype(U)) | U(1)
    return out


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
