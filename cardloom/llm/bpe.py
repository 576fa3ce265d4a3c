"""Byte-level BPE: ranked merges over distinct words, and decoding by concatenating pieces."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, parts, small_batches
from .pieces import PieceEncoder


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a .tiktoken file: byte pieces to ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for one long word, with a heap, as its square would be large."""
    parts = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, a in zip(parts, alive, strict=True) if a]


#: Widths of the byte arrays that are folded together; longer words one by one.
WIDTHS = (4, 8, 12, 16, 24, 40, 64)
_NONE = np.int32(2**31 - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


class Merges:
    """Folds ranked merges over the byte arrays of many distinct words at once.

    The rank map by pairs of ids: each piece of the vocabulary under every cut into two pieces of it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        slots = (keys * _MUL) >> np.uint64(64 - _BITS)
        order = np.argsort(slots, kind="stable")
        self.keys, self.merged = np.append(keys[order], np.uint64(2**64 - 1)), np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], _NONE)
        self.starts = np.searchsorted(slots[order], np.arange((1 << _BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max(initial=1))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that pairs of ids merge to (their ranks), or ``_NONE``; -1 stands for no id."""
        out = np.full(left.shape, _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slots = ((keys * _MUL) >> np.uint64(64 - _BITS)).astype(np.int64)
        place, end, flat = self.starts[slots], self.starts[slots + 1], out.ravel()
        for _ in range(self.longest):
            hit = (self.keys[place] == keys) & (place < end)
            flat[at[hit]] = self.merged[place[hit]]
            more = ~hit & (place + 1 < end)
            if not more.any():
                break
            at, keys, place, end = at[more], keys[more], place[more] + 1, end[more]
        return out

    def _fold(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``width`` bytes at most, a row each, and their numbers."""
        sizes = np.array([len(w) for w in words])
        ids = self.bytes[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)]
        ids[np.arange(width) >= sizes[:, None]] = -1
        pairs, rows, columns = self.rank(ids[:, :-1], ids[:, 1:]), np.arange(len(words)), np.arange(width)
        out = np.empty_like(ids)
        while len(rows):
            j = pairs.argmin(axis=1)  # of equal ranks the leftmost
            low = pairs[np.arange(len(rows)), j]
            live = low < _NONE
            if not live.all():
                out[rows[~live]] = ids[~live]
                ids, pairs, rows, j, low = ids[live], pairs[live], rows[live], j[live], low[live]
                if not len(rows):
                    break
            every, after = np.arange(len(rows)), columns > j[:, None]
            ids = np.hstack([np.where(after[:, :-1], ids[:, 1:], ids[:, :-1]), np.where(after[:, -1:], -1, ids[:, -1:])])
            ids[every, j] = low
            pairs = np.hstack([np.where(after[:, :-2], pairs[:, 1:], pairs[:, :-1]), np.where(after[:, -2:-1], _NONE, pairs[:, -1:])])
            right = np.minimum(j + 1, width - 1)
            pairs[every, np.minimum(j, width - 2)] = self.rank(low, np.where(j + 1 < width, ids[every, right], -1))
            inner = np.flatnonzero(j > 0)
            pairs[inner, j[inner] - 1] = self.rank(ids[inner, j[inner] - 1], low[inner])
        return out, (out >= 0).sum(axis=1)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers: a word of the vocabulary is one
        piece, in others the pair of least rank merges until none is left, leftmost first."""
        out: list[bytes | None] = [struct.pack("<I", r) if (r := self.ranks.get(w)) is not None else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        sizes = np.array([len(words[i]) for i in rest], np.int64)
        kinds = np.searchsorted(WIDTHS, sizes)
        for k, width in enumerate(WIDTHS):
            some = [rest[i] for i in np.flatnonzero(kinds == k)]
            for at in range(0, len(some), (1 << 18) // width):
                part = some[at : at + (1 << 18) // width]
                ids, counts = self._fold([words[i] for i in part], width)
                data, ends = ids[ids >= 0].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, a, b in zip(part, [0, *ends], ends, strict=False):
                    out[i] = data[a:b]
        for i in np.flatnonzero(kinds == len(WIDTHS)):
            ids = _long(words[rest[i]], self.ranks)
            out[rest[i]] = struct.pack(f"<{len(ids)}I", *ids)
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> PieceEncoder:
    """One encoder per worker, kept between tasks; a rank map is told by its size and last piece."""
    key = (len(ranks), max(ranks, key=ranks.get), pattern)
    if key not in _ENCODERS:
        words, merges = regex.compile(pattern), Merges(ranks)

        def ids_of(text: str) -> np.ndarray:
            found = words.findall(text)
            distinct = [*set(found)]
            folded = dict(zip(distinct, merges.fold([w.encode() for w in distinct]), strict=True))
            return np.frombuffer(b"".join(map(folded.__getitem__, found)), "<u4")

        _ENCODERS[key] = PieceEncoder(ids_of, 10_000)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>): the byte-level BPE ids of the whole text, as tiktoken's
    ``encode_ordinary`` gives them for the rank file ``path`` and the pre-token ``pattern``.

    Null and empty text give an empty array. A column ``ids`` of ``docs`` is replaced. An empty table
    gives an empty table. The rank map (its size is that of the vocabulary file) is broadcast; a
    worker folds the merges over the byte arrays of the distinct words that it does not remember (a
    bounded table), many at once, and texts are joined from their words' ids. There is no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    rest = [c for c in docs.columns if c != "ids"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for part in parts(batch, batch.column(text), 2 << 20):
                made = encoder.encode([x or "" for x in part.column(text).to_pylist()])
                ends = np.concatenate(([0], np.cumsum([len(m) // 4 for m in made]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), ids], [*rest, "ids"])
        give_back()

    return docs.select(*rest).mapInArrow(run, f"{fields}, ids array<int>")


def piece_table(path: str) -> Column:
    """The vocabulary's byte pieces by id as a literal array; each byte is the character of its code."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece.decode("latin-1")
    return F.split(F.lit("Ā".join(pieces)), "Ā", -1)


def decode(ids: Column, path: str) -> Column:
    """Concatenate the byte pieces of ids: a binary column. Null gives null, an empty array no bytes."""
    table = piece_table(path)
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text, decode the ids, and give the digests of both."""
    coded = encode(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
