"""Packing token pieces into sequences by vector best fit: tokens, documents and attention cost are capacities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, parts, small_batches, written
from .pieces import ranges
from .token_store import _encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, pieces of documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None

    @property
    def limits(self) -> np.ndarray:
        """All three; where one is not set, what the tokens imply, as a piece has a token at least."""
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], np.int64)


@dataclass
class Bins:
    """``bins`` sequences filled alike, and what each has left. A run (length, first rank, pieces in each bin, offset)
    says which pieces of a length they hold: those of the first rank on, so many for the first bin, as many for the next."""

    bins: int
    left: np.ndarray
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)

    def first(self, n: int) -> tuple["Bins", "Bins"]:
        """The first ``n`` bins, and the others."""
        return Bins(n, self.left, self.runs), Bins(self.bins - n, self.left, [(size, rank + n * k, k, at) for size, rank, k, at in self.runs])

    def with_run(self, run: tuple[int, int, int, int], demand: np.ndarray) -> "Bins":
        return Bins(self.bins, self.left - run[2] * demand, [*self.runs, run])


def best_fit(pieces: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> list[Bins]:
    """Place ``pieces`` (length to number), longest first, each in the bin that fits best under every capacity.

    A piece's demand is (length, 1, length squared). The best of the bins with room in all three has the least
    weighted ``norm`` of what would be left, or, by ``dot``, the least weighted product of what is left and the
    demand, both in shares of the capacities; of equals the one opened first. A bin just chosen has less left than
    before by either measure, so the next piece of that length goes there too while there is room: equal
    pieces are placed in equal bins at once, and the work depends on the number of different lengths, not of pieces.
    A piece whose cost alone exceeds the cost limit has a sequence to itself.
    """
    limits = capacity.limits
    shares, weight = limits.astype(float), np.asarray(weights, float)
    groups: list[Bins] = []
    left = np.zeros((64, 3), np.int64)  # of the groups, in their order
    for size in sorted(pieces, reverse=True):
        if not 1 <= size <= capacity.tokens:
            raise ValueError(f"pieces have 1 to {capacity.tokens} tokens")
        demand, count, rank = np.array([size, 1, size * size]), pieces[size], 0
        while count:
            fits = np.flatnonzero((left[: len(groups)] >= demand).all(axis=1))
            if len(fits):
                share = left[fits] / shares
                value = (share - demand / shares) ** 2 @ weight if score == "norm" else share * (demand / shares) @ weight
                at = int(fits[np.argmin(value)])
                group = groups[at]
            else:
                at, group = len(groups), Bins(count, np.maximum(limits, demand))
            each = min(int((group.left // demand).min()), count)
            chosen, rest = group.first(min(group.bins, count // each))
            chosen = chosen.with_run((size, rank, each, int(limits[0] - group.left[0])), demand)
            rank, count = rank + chosen.bins * each, count - chosen.bins * each
            opened = at == len(groups)
            groups[at : at + 1] = [chosen]
            if rest.bins and not opened:
                groups.append(rest)
            if len(groups) >= len(left):
                left = np.concatenate([left, np.zeros_like(left)])
            left[at], left[len(groups) - 1] = chosen.left, groups[-1].left
    return groups


def slots(groups: list[Bins]) -> np.ndarray:
    """Columns length, first rank, pieces, pieces in each bin, offset, first sequence; in order of length and rank."""
    firsts = np.cumsum([0, *(g.bins for g in groups)])
    out = [(size, rank, g.bins * k, k, at, first) for g, first in zip(groups, firsts, strict=False) for size, rank, k, at in g.runs]
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def cut_texts(docs: DataFrame, path: str, end_id: int, size: int = 1024) -> DataFrame:
    """Encode each ``text`` with the tokenizers file ``path``, append ``end_id`` and cut what is longer than ``size``
    into pieces of that size, the first of which may be shorter.

    Returns ``doc_id``, ``piece`` from 0, ``start`` (the document's ids before it), ``length`` and ``ids`` (little-endian
    unsigned 32-bit integers). Null text is empty and holds the end id alone. Rows that repeat an id, or have
    none, are documents of their own. Other columns are left out; an empty table gives an empty table."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _encoder(spec.value)
        for batch in batches:
            for part in parts(batch, batch.column(1), 4 << 20):
                ids, counts = encoder.encode(part.column(1))
                data, n = np.insert(ids, np.cumsum(counts), end_id).tobytes(), counts + 1
                each = -(-n // size)
                of, piece = np.repeat(np.arange(len(n)), each), ranges(np.zeros_like(each), each)
                first = n - (each - 1) * size
                start = np.where(piece > 0, first[of] + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, first[of])
                ends = (4 * np.cumsum(length)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def _numbered(pieces: DataFrame) -> DataFrame:
    """Add the reading task's number and, within it, each piece's rank among those of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            sizes, of = np.unique(batch.column("length").to_numpy(), return_inverse=True)
            order = np.argsort(of, kind="stable")
            counts = np.bincount(of, minlength=len(sizes))
            before = np.array([seen.get(x, 0) for x in sizes.tolist()], np.int64)
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(before, counts)
            seen.update(zip(sizes.tolist(), (before + counts).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), task)), pa.array(rank)], names=[*batch.schema.names, "_task", "_rank"])

    return pieces.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", _task bigint, _rank bigint")


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``: vector best fit over the whole table, see ``best_fit``.

    ``pieces`` holds ``length``; other columns pass through, but for those named like a result or a column used within
    (``_task``, ``_rank``, ``_n``, ``_before``, ``_at``), which are left out. Pieces whose length is null or below 1 take no place: their
    sequence and offset are null. Longer ones than the capacity are an error, as they should be cut first. Equal
    rows are pieces of their own. An empty table gives an empty table.

    The choice depends only on how many pieces there are of each length, at most ``capacity.tokens`` numbers,
    which alone go to the driver. Pieces learn their place in that plan by their rank among all of their length:
    the rank within a task, plus the numbers of the tasks before (prefix sums of counts). So tasks need not meet, no
    length is a group in one task, and pieces are shuffled at most once, without their ids if these are left out.
    """
    pieces = pieces.drop("sequence_id", "offset", "_task", "_rank", "_n", "_before", "_at").withColumn("length", F.col("length").cast("bigint"))
    ranked = written(_numbered(pieces.where("length >= 1")), "ranked")
    counts = ranked.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "counts")
    plan = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity, weights, score)
    sent = pieces.sparkSession.sparkContext.broadcast(slots(plan))
    columns = pieces.columns
    names = [*columns, "sequence_id", "offset"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        sizes = np.unique(table[:, 0])
        step = int(table[:, 1:3].sum(axis=1).max(initial=0)) + 1  # more than any rank
        keys = np.searchsorted(sizes, table[:, 0]) * step + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_at").to_numpy()
            slot = table[np.searchsorted(keys, np.searchsorted(sizes, length) * step + rank, "right") - 1]
            bin_, place = np.divmod(rank - slot[:, 1], slot[:, 3])
            out = [pa.array(slot[:, 5] + bin_), pa.array(slot[:, 4] + place * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], names=names)

    at = ranked.join(counts.select("_task", "length", "_before"), ["_task", "length"]).withColumn("_at", F.col("_rank") + F.col("_before"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    found = at.select(*columns, "_at").mapInArrow(placed, types + ", sequence_id bigint, offset bigint")
    none = pieces.where("length is null or length < 1").withColumns({c: F.lit(None).cast("bigint") for c in names[-2:]})
    return found.unionByName(none)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of packed pieces with their ``ids``: ``sequence_id``, ``n_tokens``, ``ids`` (joined in order of
    offset) and ``documents`` (doc_id, piece, offset, length of each, in order). A sequence is bounded by its capacity;
    pieces without a place are in none."""
    of = packed.where("sequence_id is not null").groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    return of.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("_p", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("documents"))


def pack_texts(docs: DataFrame, path: str, end_id: int = 2, capacity: Capacity = Capacity()) -> DataFrame:
    """Pieces of encoded texts with their places and the unsigned crc32 of their ids; ids themselves stay in a written
    table and are not shuffled."""
    pieces = written(cut_texts(docs, path, end_id, capacity.tokens), "pieces")
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
