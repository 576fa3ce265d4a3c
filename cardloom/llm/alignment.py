"""Alignment of two tokenizers' tokens by bytes, with corpus-wide counts of linked id pairs.

Where tokens of both end at one byte, a text is cut into groups, and all tokens of a group are linked.
Most links join an id of A to the id of B with the same bytes. That map is made once from the vocabularies,
so such links are counted in vectors as long as A's vocabulary; only other links are counted as pairs.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, parts, small_batches, written
from .pieces import PieceEncoder, space_pieces

#: Distinct pieces of texts that a worker remembers.
REMEMBERED = 300_000
#: Pairs with at least this share of all counted are sent to every task: so many at most.
FREQUENT = 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes by themselves, others counted from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers: the bytes of their entries, and the id of B with the bytes of each id of A (-1: none).

    A is a byte-level file of the tokenizers library, B a model of the sentencepiece library that puts a
    space before a text and falls back to bytes. Special tokens' strings in texts are plain text.
    """

    def __init__(self, spec_a: bytes, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(spec_a.decode()), sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        special = self.a.get_added_tokens_decoder()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        plain = {x: i for i, x in reversed([*enumerate(self.bytes_b)]) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([plain.get(x, -1) if i not in special else -1 for i, x in enumerate(self.bytes_a)], np.int64)
        self.space = plain[b" "]

    def encode_a(self, text: str) -> np.ndarray:
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def spans(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of these parts of a flat array one after another, and the number of the part of each."""
    sizes = offsets[which + 1] - offsets[which]
    of = np.repeat(np.arange(len(which)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[which], sizes), of


def summed(keys: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their uses."""
    order = np.argsort(keys, kind="stable")
    keys, uses = keys[order], uses[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(uses, begins) if len(keys) else uses


class Aligner:
    """Aligns whole texts by their pieces, and remembers distinct pieces.

    Texts are cut at single spaces between non-spaces and before single line ends, where tokens of both
    tokenizers begin whatever stands around (B has no entry with a space behind another letter, and none
    with a line end). A pair's code is A's id times B's vocabulary plus B's id.
    """

    def __init__(self, vocabularies: Vocabularies, most: int = REMEMBERED):
        self.v, self.most = vocabularies, most
        self.encoder = PieceEncoder(vocabularies.encode_a, 50)
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.v.bytes_a, self.v.bytes_b))
        self.wide = len(self.lengths_a) * len(self.lengths_b)
        self.names = list(map(str, range(max(len(self.lengths_a), len(self.lengths_b)))))
        self.vector = np.zeros(len(self.v.bytes_a), np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.whole, self.sizes = array("b"), array("q")  # whether bytes agree; four numbers a piece
        self.ids, self.id_uses, self.id_ends = array("q"), array("q"), array("q", [0])
        self.pairs, self.pair_uses, self.pair_ends = array("q"), array("q"), array("q", [0])

    def learn(self, keys: list[str]) -> None:
        """A key is a piece as cut, or, if a text begins with white space, its first piece behind the space that both put before it.

        All pieces are aligned at once: their bytes stand one after another, so the running ends of A's and of B's
        tokens are places in the same bytes, and those that both have are where groups end."""
        strings = [k if k[0] in " \n" else " " + k for k in keys]
        made = self.encoder.encode_strings(strings)
        many_b = self.v.b.encode([k[1:] if k[0] == " " else k for k in keys], num_threads=1)
        for i, key in enumerate(keys):
            if key[0] == "\n":  # B put a space before the line end
                many_b[i] = many_b[i][1:] if many_b[i][:1] == [self.v.space] else []
        many_a = [made[x] for x in strings]
        data = [x.encode() for x in strings]
        count = lambda x: np.fromiter(map(len, x), np.int64, len(x))
        n_a, n_b, n_bytes = count(many_a) // 4, count(many_b), count(data)
        a = np.frombuffer(b"".join(many_a), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(many_b), np.int64, int(n_b.sum()))
        piece_a, piece_b = np.repeat(np.arange(len(keys)), n_a), np.repeat(np.arange(len(keys)), n_b)
        whole = np.ones(len(keys), bool)
        for ids, piece, lengths, entries in ((a, piece_a, self.lengths_a, self.v.bytes_a), (b, piece_b, self.lengths_b, self.v.bytes_b)):
            whole &= np.bincount(piece, lengths[ids], len(keys)) == n_bytes
            said = [entries[i] for i in ids.tolist()]
            if b"".join(said) != b"".join(data):
                ends = np.searchsorted(piece, np.arange(len(keys) + 1))
                whole &= np.array([b"".join(said[i:j]) == x for i, j, x in zip(ends[:-1], ends[1:], data, strict=True)], bool)
        a, piece_a = a[whole[piece_a]], piece_a[whole[piece_a]]
        b, piece_b = b[whole[piece_b]], piece_b[whole[piece_b]]
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        first_a, first_b = (np.searchsorted(g, np.arange(len(ends) + 1)) for g in (group_a, group_b))
        size_a, size_b = np.diff(first_a), np.diff(first_b)
        piece = piece_a[first_a[:-1]]  # of each group
        place, of = spans(first_b, group_a)  # each token of A with each of B's in its group
        code, uses = summed(piece_a[of] * self.wide + a[of] * len(self.lengths_b) + b[place], np.ones(len(of), np.int64))
        owner, code = np.divmod(code, self.wide)
        own = self.v.same[code // len(self.lengths_b)] == code % len(self.lengths_b)
        for values, times, offsets, kept, found in (
                (self.ids, self.id_uses, self.id_ends, own, code // len(self.lengths_b)), (self.pairs, self.pair_uses, self.pair_ends, ~own, code)):
            offsets.frombytes((len(values) + np.searchsorted(owner[kept], np.arange(1, len(keys) + 1))).astype(np.int64).tobytes())
            values.frombytes(found[kept].tobytes())
            times.frombytes(uses[kept].tobytes())
        numbers = (n_a * whole, n_b * whole, np.bincount(piece, minlength=len(keys)), np.bincount(piece, size_a * size_b, len(keys)))
        self.sizes.frombytes(np.stack(numbers, axis=1).astype(np.int64).tobytes())
        self.whole.frombytes(whole.astype(np.int8).tobytes())
        self.say(a, b, first_a, first_b, (size_a == 1) & (size_b == 1), np.searchsorted(piece, np.arange(len(keys) + 1)))
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))

    def say(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, single: np.ndarray, ends: np.ndarray) -> None:
        """The groups of pieces as texts."""
        said_a, said_b = [self.names[i] for i in a.tolist()], [self.names[i] for i in b.tolist()]
        groups = [said_a[i] + "|" + said_b[j] for i, j in zip(first_a[:-1].tolist(), first_b[:-1].tolist(), strict=True)]
        for g in np.flatnonzero(~single).tolist():
            groups[g] = ",".join(said_a[first_a[g] : first_a[g + 1]]) + "|" + ",".join(said_b[first_b[g] : first_b[g + 1]])
        at = ends.tolist()
        self.texts += [";".join(groups[i:j]) if j - i > 1 else groups[i] if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]

    def align(self, texts: list[str | None]) -> dict:
        """Numbers, groups, and distinct linked ids and pairs with their uses, of each text; adds to ``vector``
        one for each text that links an id to its own bytes."""
        keys, ends = [], [0]
        for t in texts:
            if t:
                pieces = space_pieces(t)
                if not pieces[0] or pieces[0][0].isspace():
                    pieces[0] = " " + pieces[0]
                keys += pieces
            ends.append(len(keys))
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        if new and len(self.known) + len(new) > self.most:
            self.clear()
            new = [*dict.fromkeys(keys)]
        if new:
            self.learn(new)
        n, at = len(texts), np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        text = np.repeat(np.arange(n), np.diff(ends))
        view = lambda x: np.array(x, np.int64)
        odd = np.bincount(text, np.array(self.whole)[at] == 0, n) > 0
        sizes = view(self.sizes).reshape(-1, 4)
        keep = ~odd[text]
        numbers = [np.bincount(text[keep], sizes[at[keep], i], n).astype(np.int64) for i in range(4)]
        groups = ["" if odd[i] else ";".join([self.texts[x] for x in at[a:b].tolist()]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        kinds, uses = np.unique(text[keep] * len(self.texts) + at[keep], return_counts=True)
        text, at = np.divmod(kinds, max(1, len(self.texts)))
        out = {"numbers": numbers, "groups": groups}
        for name, values, times, offsets in (("ids", self.ids, self.id_uses, self.id_ends), ("pairs", self.pairs, self.pair_uses, self.pair_ends)):
            place, of = spans(view(offsets), at)
            found, times = summed(text[of] * self.wide + view(values)[place], view(times)[place] * uses[of])
            texts_of, found = np.divmod(found, self.wide)
            out[name] = np.searchsorted(texts_of, np.arange(n + 1)), found, times
        self.vector += np.bincount(out["ids"][1], minlength=len(self.vector))
        return out


_SCHEMA = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, "
           "ids array<int>, id_uses array<bigint>, pairs array<bigint>, pair_uses array<bigint>, vector binary")
_KNOWN: dict[tuple[int, int], Aligner] = {}  # a worker's


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """Align the tokens of each ``text``: ``row`` (a number of the row), ``doc_id``, numbers of tokens, groups and
    links, ``groups_sha256``, distinct linked ids (``ids``: of A, linked to B's id of the same bytes) and other linked ``pairs``
    with their numbers of links, and ``groups`` as text where they are asked for. Rows with a ``vector`` hold no text:
    each task adds one with its counts of ``ids``, documents that hold each.

    Null and empty texts, and those whose tokens do not give the text's bytes again, have no tokens: zeros, ''.
    Rows that repeat an id, or have none, are documents of their own. The result is a written table, so that
    counts and the documents that they are joined to are one reading. An empty table gives an empty table."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(files.value[0]), zlib.crc32(files.value[1])
        if key not in _KNOWN:
            _KNOWN[key] = Aligner(Vocabularies(*files.value))
        aligner, row = _KNOWN[key], TaskContext.get().partitionId() << 33
        aligner.vector[:] = 0
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for part in parts(batch, batch.column(1), 4 << 20):
                n, got = len(part), aligner.align(part.column(1).to_pylist())
                said = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in got["groups"]]
                ids, pairs = got["ids"], got["pairs"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), part.column(0), *map(pa.array, got["numbers"]), pa.array(got["groups"] if keep_groups else [None] * n, pa.string()), pa.array(said, pa.string()),
                        _lists(ids[0], ids[1], pa.int32()), _lists(ids[0], ids[2], pa.int64()), _lists(pairs[0], pairs[1], pa.int64()), _lists(pairs[0], pairs[2], pa.int64()), pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
                row += n
        if aligner.vector.any():
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([aligner.vector.tobytes()])], names=names)
        give_back()

    return written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SCHEMA), "aligned")


def identity_counts(aligned: DataFrame) -> DataFrame:
    """Documents that link each id of A to its own bytes in B, from the tasks' vectors: ``a``, ``n``."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                vector = np.frombuffer(data, np.int64)
                a = np.flatnonzero(vector)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(vector[a])], names=["a", "n"])

    return aligned.where("vector is not null").select("vector").mapInArrow(entries, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Documents that link each other pair: ``pair`` (its code), ``n``. Counted in each task before the shuffle."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def alignment_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """All linked id pairs of a corpus: ``a``, ``b``, ``n`` (documents that hold them linked) and ``best`` (no pair of
    this ``a`` has more)."""
    with open(path_a, "rb") as x, open(path_b, "rb") as y:
        v = Vocabularies(x.read(), y.read())
    aligned, width = align(docs, path_a, path_b), len(v.bytes_b)
    same = docs.sparkSession.createDataFrame([(i, int(j)) for i, j in enumerate(v.same) if j >= 0], "a bigint, b bigint")
    pair = F.col("pair")
    both = identity_counts(aligned).join(same, "a").select("a", "b", "n").unionByName(
        pair_counts(aligned).select(F.floor(pair / width).alias("a"), (pair % width).alias("b"), "n"))
    both = written(both, "pairs")
    return both.join(both.groupBy("a").agg(F.max("n").alias("_most")), "a").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def linked_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's alignment with corpus-wide counts: ``n_best`` links whose pair no other pair of their A id
    exceeds, ties included, and ``count_sum``, the counts of all its links' pairs. See ``align`` for odd texts.

    Counts of ids with their own bytes are vectors as long as A's vocabulary, sent to every task. Of other pairs
    those with a share of at least 1 / ``FREQUENT`` of all are broadcast, so never more than that; all others
    meet their counts in a join, where none is a hot key as each has less than that share.
    """
    with open(path_b, "rb") as f:
        import sentencepiece

        width = sentencepiece.SentencePieceProcessor(model_proto=f.read()).vocab_size()
    aligned = align(docs, path_a, path_b)
    spark = docs.sparkSession
    a_of = F.floor(F.col("pair") / width)
    counts, pairs = written(identity_counts(aligned), "identity"), written(pair_counts(aligned), "pairs")
    most = written(counts.unionByName(pairs.select(a_of.alias("a"), "n")).groupBy("a").agg(F.max("n").alias("most")), "most")
    table = most.join(counts, "a", "left").toArrow()  # a row for an id of the vocabulary
    size = (max(table.column("a").to_pylist()) if len(table) else 0) + 1
    vectors = np.zeros((2, size), np.int64)
    vectors[0][table.column("a").to_numpy()] = table.column("n").fill_null(0).to_numpy()
    vectors[1][table.column("a").to_numpy()] = table.column("most").to_numpy()
    sent = spark.sparkContext.broadcast(vectors)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of, most_of = sent.value
        for batch in batches:
            ids, uses = batch.column("ids"), batch.column("id_uses").flatten().to_numpy()
            flat, of = ids.flatten().to_numpy(), np.repeat(np.arange(len(batch)), ids.value_lengths().fill_null(0).to_numpy())
            best, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(best, of, uses * (n_of[flat] == most_of[flat]))
            np.add.at(total, of, uses * n_of[flat])
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(total)], names=[*names, "best", "total"])

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    texts = aligned.where("vector is null")
    own = texts.select(*names, "ids", "id_uses").mapInArrow(
        looked_up, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, best bigint, total bigint")
    share = (pairs.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    known = written(pairs.withColumn("a", a_of).join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("top"), (F.col("n") >= share).alias("frequent")), "counted")
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "pair_uses")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pair_uses").alias("uses"))
    first = links.join(F.broadcast(known.where("frequent").drop("frequent")), "pair", "left")
    rest = first.where("n is null").drop("n", "top").join(known.where("not frequent").drop("frequent"), "pair")

    def by_row(df: DataFrame) -> DataFrame:
        uses = F.col("uses")
        return df.groupBy("row").agg(F.sum(F.when(F.col("top"), uses).otherwise(0)).alias("_best"), F.sum(uses * F.col("n")).alias("_total"))

    # the frequent links of a text are summed in the task that explodes them, before anything is shuffled
    others = by_row(first.where("n is not null")).unionByName(by_row(rest)).groupBy("row").agg(F.sum("_best").alias("_best"), F.sum("_total").alias("_total"))
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return own.join(others, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("best", "_best").alias("n_best"), plus("total", "_total").alias("count_sum"), "groups_sha256")
