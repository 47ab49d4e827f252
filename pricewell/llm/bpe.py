"""Byte-level BPE encoding and decoding.

Each piece is encoded by a priority queue of merge ranks over a doubly linked symbol list: the lowest (rank, position)
is popped, entries whose pair has changed since they were pushed are skipped as stale, and a merge pushes the two pairs
it creates. Decoding concatenates the vocabulary strings. Texts are cut first at special tokens, then at the places
where no piece can span (a non-space before " x"), and chunks between those are looked up in a bounded cache.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.common import KEEPERS, importable

#: Fixed value: the pre-tokenization pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of Unicode's White_Space property; Python's own \s holds four more.
SPACE = "\t-\r \x85\xa0  -     　"
#: Chunks whose ids one Python worker keeps; when full, the cache starts anew.
CACHE = 800_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary strings: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A vocabulary file of the `tokenizers` library (byte-level BPE), read once per Python worker."""

    def __init__(self, path: str):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        #: (left id << 20 | right id) -> rank << 20 | id of the merged symbol
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.decimals = {i: str(i) for i in self.strings}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.at_words = re.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])")
        self.pieces = regex.compile(PIECES.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.space_runs = [c + " " for c in map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
        #: Ids of " " + key, packed as int32: small, and nothing that Python's garbage collector must walk.
        self.spaced: dict[str, bytes] = {}
        self.most = CACHE

    def merge(self, ids: list[int]) -> list[int]:
        """Ids of one piece given its bytes' ids."""
        get, n = self.merges.get, len(ids)
        queue = [(v >> 20) << 40 | i for i in range(n - 1) if (v := get(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            v = get(ids[i] << 20 | ids[j])
            if v is None or v >> 20 != entry >> 40:
                continue  # stale
            merged = ids[i] = v & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := get(merged << 20 | ids[k])) is not None:
                    heappush(queue, (v >> 20) << 40 | i)
            h = before[i]
            if h >= 0 and (v := get(ids[h] << 20 | merged)) is not None:
                heappush(queue, (v >> 20) << 40 | h)
        return [x for x in ids if x >= 0]

    def pack(self, piece: str) -> bytes:
        ids = self.byte_ids
        return array("i", self.merge([ids[b] for b in piece.encode()])).tobytes()

    def cut(self, text: str) -> bytes:
        """Packed ids of a chunk that the cache doesn't have."""
        pieces = self.pieces.findall(text)
        if len(pieces) == 1:
            return self.pack(text)
        out = []
        for piece in pieces:
            if piece[0] == " " and len(piece) < 64:
                ids = self.spaced.get(piece[1:])
                out.append(self.keep(piece[1:], self.pack(piece)) if ids is None else ids)
            else:
                out.append(self.pack(piece))
        return b"".join(out)

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(text) < 64:
            if len(self.spaced) >= min(self.most, CACHE):
                self.spaced.clear()
            self.spaced[text] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        got = self.spaced.get
        if any(p in text for p in self.space_runs):
            first, *rest = self.at_words.split(text)
            rest = [p[1:] for p in rest]
        else:  # no run of white space spans a space: each space starts a chunk
            first, *rest = text.split(" ")
        return self.cut(first) + b"".join([ids if (ids := got(p)) is not None else self.keep(p, self.cut(" " + p)) for p in rest])

    def encode(self, text: str) -> array:
        out = array("i")
        if self.at_special and any(s in text for s in self.special):
            for part in self.at_special.split(text):
                out.frombytes(array("i", [self.special[part]]).tobytes() if part in self.special else self.plain(part))
        else:
            out.frombytes(self.plain(text))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    made = Codec(path)
    gc.freeze()  # the tables stay; collections needn't walk them
    return made


KEEPERS.append(codec.cache_clear)


def _over(batches: Iterator[pa.RecordBatch], text: str, row, columns: dict) -> Iterator[pa.RecordBatch]:
    """Each batch plus columns made by row() from the text column, in slices of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [row(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(columns.values())]
            keep = [(n, a) for n, a in zip(part.schema.names, part.columns, strict=True) if n != text]
            yield pa.RecordBatch.from_arrays([a for _, a in keep] + arrays, [n for n, _ in keep] + list(columns))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, cache: int = 200_000) -> DataFrame:
    """The columns `keep` (all but the text) plus `out`: array<int> of the text's token ids.

    A null text counts as empty and gives an empty array. `path` must be readable by the executors. cache: chunks whose ids a
    worker keeps, about 200 bytes each; workers hold them until other operators' tasks start there.
    """
    importable(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, out)]
    d = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([f for f in d.schema.fields if f.name != "_text"] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(path)
        c.most = cache
        yield from _over(batches, "_text", lambda t: (np.asarray(c.encode(t or "")),), {out: pa.list_(pa.int32())})

    return d.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The other columns plus `out`: the text of the token ids. Null ids count as none."""
    importable(df.sparkSession)
    keep = [c for c in df.columns if c not in (ids, out)]
    d = df.select(*keep, F.col(ids).alias("_ids"))
    schema = T.StructType([f for f in d.schema.fields if f.name != "_ids"] + [T.StructField(out, T.StringType())])

    def run(batches):
        c = codec(path)
        yield from _over(batches, "_ids", lambda x: (c.decode(x or ()),), {out: pa.string()})

    return d.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` plus n_tokens, ids_sha256 and decoded_sha256: digests of encode() and of decode() of its ids.

    One pass, so that neither ids nor decoded texts travel between the JVM and Python. A null text counts as empty; a long
    one is encoded whole, by one task, in memory of some 30 times its size. Columns of df of those three names are replaced.
    """
    importable(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    d = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([f for f in d.schema.fields if f.name != "_text"] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(path)
        c.most = CACHE

        def row(t):
            ids = c.encode(t or "")
            return len(ids), hashlib.sha256(",".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

        yield from _over(batches, "_text", row, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})

    return d.mapInArrow(run, schema)
