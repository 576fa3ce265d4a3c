"""A content-addressed store of token ids: chunks cut by rolling hashes, recipes and Merkle manifests."""

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, parts, shared_dir, small_batches
from .pieces import ColumnEncoder

#: Ids in the rolling hash, and bits of it that must be zero where a chunk ends.
WINDOW, MASK = 16, (1 << 10) - 1
#: Distinct pieces that a worker remembers.
REMEMBERED = 600_000
#: Least and most ids of a chunk (a document's last may be shorter); LEAST exceeds WINDOW.
LEAST, MOST = 256, 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` ids lets a chunk end. As no chunk is shorter than the
    window but a document's last, the ids of many documents can be hashed at once."""
    roll = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for j in (1, 2, 4, 8):  # sums of 2, 4, 8 and WINDOW ids, each shifted by its distance
        roll[j:] += roll[:-j] << np.uint64(j)
    return np.flatnonzero(roll >> np.uint64(WINDOW) & np.uint64(MASK) == 0) + 1


def chunk_ends(marks: np.ndarray, start: int, end: int) -> list[int]:
    """Where the chunks of a document's ids, from ``start`` to ``end``, end: at the first mark after
    ``LEAST`` ids, or after ``MOST``, so equal passages are cut alike wherever they stand."""
    ends, at = [], start
    while end - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        at = min(int(marks[i]) if i < len(marks) else end, at + MOST, end)
        ends.append(at)
    return ends if at == end else [*ends, end]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over chunk digests; an odd one is carried up. No leaves: the digest of nothing."""
    while len(leaves) > 1:
        pairs = [digest(leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0] if leaves else digest(b"")


def _times(mat: list[int], vec: int) -> int:
    out, i = 0, 0
    while vec:
        if vec & 1:
            out ^= mat[i]
        vec >>= 1
        i += 1
    return out


class CrcJoin:
    """crc32(a + b) from crc32(a), crc32(b) and len(b), as zlib's crc32_combine: the bits of the first
    are carried over len(b) zero bytes by matrices over GF(2), one for each power of two."""

    def __init__(self) -> None:
        one = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
        self.powers = []
        for _ in range(3):
            one = [_times(one, x) for x in one]
        for _ in range(48):
            self.powers.append(one)
            one = [_times(one, x) for x in one]

    def __call__(self, a: int, b: int, size: int) -> int:
        i = 0
        while size:
            if size & 1:
                a = _times(self.powers[i], a)
            size >>= 1
            i += 1
        return a ^ b


_ENCODERS: dict[int, tuple[ColumnEncoder, int]] = {}


def _encoder(spec: bytes) -> tuple[ColumnEncoder, int]:
    """An encoder from a tokenizers file's bytes, kept by the worker, and the vocabulary's size."""
    key = zlib.crc32(spec)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec.decode())
        special = sorted(x.content for x in t.get_added_tokens_decoder().values())

        def ids_of(text: str) -> np.ndarray:
            return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

        _ENCODERS[key] = ColumnEncoder(ids_of, 50, REMEMBERED, special), t.get_vocab_size()
    return _ENCODERS[key]


#: Documents under one node of the manifest.
FAN_OUT = 1024


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row per ``FAN_OUT`` documents of a shard: their number, ids, and a root over their roots in order."""
    node = F.floor((F.col("place") % (1 << 33)) / FAN_OUT).alias("node")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: F.hex(x["root"]))
    return recipes.groupBy("shard", node).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(ordered, ""), 256).alias("root"))


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Encode texts with the tokenizers file ``path``, append ``end_id`` and write a store to ``folder``.

    - ``stored/kind=chunk``: ``key`` (digest), ``ids`` (little-endian integers of ``width`` bytes: 2 where
      the vocabulary allows it), each different chunk once;
    - ``recipes``: ``doc_id``, ``n_tokens``, ``recipe`` (digest and length of its chunks, in order) and
      ``root`` (Merkle root over them), in ascending ``doc_id`` order: ``shard`` numbers the ranges and
      ``place`` rises within them;
    - ``manifest``: the next level of the tree, a root over each ``FAN_OUT`` documents' roots.

    Null text is empty and holds the end id alone. Rows without an id come first. Rows that repeat an id
    are kept, next to each other, in the order of their roots. An empty table writes empty tables.

    Texts are not shuffled: scan tasks encode and cut, and chunks with their ids are shuffled once, by
    digest, with the recipes beside them, so nothing is encoded twice. A task sends a chunk once, so
    a document with very many copies makes no large partition.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = "kind string, key binary, ids binary, width int, doc_id bigint, n_tokens bigint, recipe array<struct<digest:binary,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(spec.value)
        width = 2 if size <= 1 << 16 and end_id < 1 << 16 else 4
        sent, row = set(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in parts(batch, batch.column(1), 4 << 20):
                ids, counts = encoder.encode(part.column(1))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), (counts + 1).tolist()
                marks, small = chunk_marks(ids), ids.astype(f"<u{width}").tobytes()
                chunks, digests, lengths, ends, at = {}, [], [], [0], 0
                for n in counts:
                    for to in chunk_ends(marks, at, at + n):
                        data = small[at * width : to * width]
                        key = digest(data)
                        digests.append(key)
                        lengths.append(to - at)
                        if key not in sent:
                            if len(sent) >= 1_000_000:
                                sent.clear()
                            sent.add(key)
                            chunks[key] = data
                        at = to
                    ends.append(len(digests))
                a, b = len(chunks), len(counts)
                keys = [*chunks, *(struct.pack(">IQ", task, row + i) for i in range(b))]
                row += b
                uses = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(lengths, pa.int32())], ["digest", "n"])
                recipes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), uses)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * a + ["recipe"] * b), pa.array(keys, pa.binary()), pa.array([*chunks.values(), *[None] * b], pa.binary()),
                        pa.array([width] * a + [None] * b, pa.int32()), pa.concat_arrays([pa.nulls(a, pa.int64()), part.column(0)]), pa.array([None] * a + counts, pa.int64()),
                        pa.concat_arrays([pa.nulls(a, recipes.type), recipes]),
                    ],
                    names=["kind", "key", "ids", "width", "doc_id", "n_tokens", "recipe"],
                )
        give_back()

    coded = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
    coded.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/stored")
    _stored(spark, folder, "recipe").select("doc_id", "n_tokens", "recipe", _root(F.col("recipe")).alias("root")).repartitionByRange(
        "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("place", F.monotonically_increasing_id()).withColumn(
        "shard", F.shiftright("place", 33)).write.parquet(f"{folder}/recipes")
    _manifest(spark.read.schema(_RECIPES).parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


_STORED = "key binary, ids binary, width int, doc_id bigint, n_tokens bigint, recipe array<struct<digest:binary,n:int>>, kind string"
_RECIPES = "doc_id bigint, n_tokens bigint, recipe array<struct<digest:binary,n:int>>, root binary, place bigint, shard bigint"


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{folder}/stored").where(F.col("kind") == kind)


def _root(recipe: Column) -> Column:
    def roots(recipes: pd.Series) -> pd.Series:
        return recipes.map(lambda r: merkle_root([bytes(x["digest"]) for x in r]))

    return F.pandas_udf(roots, "binary")(recipe)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a store from its files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers) and ``verified``.

    Each stored chunk is read, checked against its digest and summed up once; a document's checksum
    is joined from its chunks' in order, so ids are not shuffled however often a chunk is used.
    ``verified`` says that all chunks were found whole and that the Merkle root over them is the recipe's.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, ids, width in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                out.append((zlib.crc32(wide), len(wide), digest(ids) == key))
            crc, n, whole = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int32()), pa.array(whole, pa.bool_())], names=["digest", "crc", "len", "whole"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = CrcJoin()
        for batch in batches:
            out = []
            for parts, root in zip(batch.column("parts").to_pylist(), batch.column("root").to_pylist(), strict=True):
                crc = 0
                for i, p in enumerate(parts):
                    crc = join(crc, p["crc"] or 0, 4 * p["n"]) if i else p["crc"]
                good = all(p["whole"] and p["len"] == p["n"] for p in parts) and merkle_root([p["digest"] for p in parts]) == root
                out.append((crc, good))
            crc, good = zip(*out, strict=True) if out else ((), ())
            rest = ["doc_id", "n_tokens", "place", "shard"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=[*rest, "ids_crc32", "verified"])

    chunks = _stored(spark, folder, "chunk").select("key", "ids", "width").mapInArrow(sums, "digest binary, crc bigint, len int, whole boolean")
    recipes = spark.read.schema(_RECIPES).parquet(f"{folder}/recipes")
    used = recipes.select("place", "shard", "doc_id", "n_tokens", "root", F.posexplode("recipe").alias("i", "r")).select("*", "r.digest", "r.n")
    parts = used.join(chunks, "digest", "left").groupBy("place", "shard", "doc_id", "n_tokens", "root").agg(
        F.array_sort(F.collect_list(F.struct("i", "digest", "n", "crc", "len", "whole"))).alias("parts"))
    docs = parts.mapInArrow(joined, "doc_id bigint, n_tokens bigint, place bigint, shard bigint, ids_crc32 bigint, verified boolean")
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{folder}/manifest").groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(by_shard), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(shards, "shard").select(
        "doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32", "verified")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Whole id streams of a store: ``doc_id``, ``place`` and ``ids`` (array<int>)."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                data = [np.frombuffer(p["ids"], f"<u{p['width']}") for p in sorted(parts, key=lambda p: p["i"])]
                out.append(np.concatenate(data).astype("<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "place", "ids"])

    recipes = spark.read.schema(_RECIPES).parquet(f"{folder}/recipes")
    used = recipes.select("place", "doc_id", F.posexplode("recipe").alias("i", "r"))
    chunks = _stored(spark, folder, "chunk").select(F.col("key").alias("digest"), "ids", "width")
    parts = used.join(chunks, F.col("r.digest") == F.col("digest")).groupBy("place", "doc_id").agg(F.collect_list(F.struct("i", "ids", "width")).alias("parts"))
    return parts.mapInArrow(wide, "doc_id bigint, place bigint, ids array<int>")


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the manifest that the recipes do not give again (none in a sound store)."""
    names = ["shard", "node", "documents", "n_tokens", "root"]
    old, new = spark.read.parquet(f"{folder}/manifest"), _manifest(spark.read.schema(_RECIPES).parquet(f"{folder}/recipes"))
    return old.select(*names).exceptAll(new.select(*names))


def store_digests(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    folder = f"{shared_dir(docs.sparkSession)}/store-{uuid.uuid4().hex}"
    write_store(docs, path, folder, end_id)
    return read_store(docs.sparkSession, folder)
