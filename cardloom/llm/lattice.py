"""Language-model scores of texts by a subword lattice over an existing unigram vocabulary."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import mixed

#: Bytes of texts in a group that shares one list of distinct words.
GROUP_BYTES = 8 << 20
#: Bytes up to which stretches of every word are looked up; beyond, only stretches that begin as a longer piece does.
STEM = 16
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: The token that ends every text; no word holds a space.
END = b" "


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces and scores of a sentencepiece model; a piece that begins a word begins with a space.

    The scores of a merge vocabulary are ranks, -r: they become log weights -log(r + 1). Control pieces,
    byte pieces and pieces with inner spaces are left out; every byte is a piece anyway.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_byte(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            out[piece] = -float(np.log1p(abs(model.get_score(i))))
    return out


class Lattice:
    """Log weights of pieces, found by hash: of pieces that begin a word, and of others with the word's end."""

    def __init__(self, weights: dict[bytes, float], end: float):
        self.pieces = [*weights]
        self.logs = np.array([weights[p] for p in self.pieces])
        self.end = end
        self._index()

    def _index(self) -> None:
        h = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(h)
        keys = h[order]
        if len(keys) > 1 and (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 4)
        self.keys, self.order, self.shift = np.append(keys, np.uint64(2**64 - 1)), np.append(order, -1), np.uint64(64 - bits)
        self.slots = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.full = np.diff(self.slots, append=len(keys)) > 0
        self.longest = max(map(len, self.pieces))
        self.stems = np.array(sorted({int(self._sum(p[:STEM])[0]) for p in self.pieces if len(p) > STEM}), np.uint64)

    @staticmethod
    def _sum(piece: bytes) -> np.ndarray:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = h * _MUL + np.uint64(b + 1)
        return h

    @classmethod
    def _hash(cls, piece: bytes) -> int:
        return int(mixed(cls._sum(piece))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these (unmixed) hashes, -1 for none."""
        out, h = np.full(h.shape, -1, np.int32), mixed(h)
        slot, flat = h >> self.shift, out.ravel()
        at = np.flatnonzero(self.full[slot])  # most stretches are no piece: their slots are empty
        h, place = h.ravel()[at], self.slots[slot.ravel()[at]]
        while len(at):
            key = self.keys[place]
            hit = key == h
            flat[at[hit]] = self.order[place[hit]]
            more = key < h
            at, h, place = at[more], h[more], place[more] + 1
        return out

    def arcs(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Of words of one length (a row of bytes each, with the space before), by length of a stretch: the
        piece of each stretch, by its first byte and word. Lengths without any piece are left out."""
        w, out = np.ascontiguousarray(words.T).astype(np.uint64) + np.uint64(1), {}
        n, h = len(w), np.zeros_like(w)
        for size in range(1, min(n, STEM) + 1):
            h = h[: n - size + 1] * _MUL + w[size - 1 :]
            found = self.find(h)
            if (found >= 0).any():
                out[size] = found
        if n <= STEM or not len(self.stems):
            return out
        at, row = np.nonzero(np.isin(h, self.stems))
        h = h[at, row]
        for size in range(STEM + 1, min(n, self.longest) + 1):
            inside = at + size <= n
            at, row, h = at[inside], row[inside], h[inside]
            if not len(at):
                break
            h = h * _MUL + w[at + size - 1, row]
            hit = self.find(h)
            if (hit >= 0).any():
                out[size] = np.full((n - size + 1, w.shape[1]), -1, np.int32)
                out[size][at, row] = hit
        return out

    def forward(self, words: np.ndarray, arcs: dict[int, np.ndarray], weights: np.ndarray | None = None) -> np.ndarray:
        """Log probability of what stands before each place, over all segmentations of it, by the pieces' log
        weights or by others."""
        n = words.shape[1]
        alpha = np.full((n + 1, len(words)), -np.inf)
        alpha[0] = 0
        logs = np.append(self.logs if weights is None else weights, -np.inf)  # -1: no piece
        some = {size: (found >= 0).any(axis=1) for size, found in arcs.items()}
        for j in range(1, n + 1):
            for size, found in arcs.items():
                if size <= j and some[size][j - size]:
                    np.logaddexp(alpha[j], alpha[j - size] + logs[found[j - size]], out=alpha[j])
        return alpha

    def log_probs(self, words: np.ndarray) -> np.ndarray:
        return self.forward(words, self.arcs(words))[-1] + self.end

    def expected(self, words: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words (forward and backward sums)."""
        n, arcs = words.shape[1], self.arcs(words)
        alpha = self.forward(words, arcs)
        beta = np.full((n + 1, len(words)), -np.inf)
        beta[n] = 0
        logs = np.append(self.logs, -np.inf)
        some = {size: (found >= 0).any(axis=1) for size, found in arcs.items()}
        for i in range(n - 1, -1, -1):
            for size, found in arcs.items():
                if i + size <= n and some[size][i]:
                    np.logaddexp(beta[i], logs[found[i]] + beta[i + size], out=beta[i])
        uses = np.zeros(len(self.pieces) + 1)
        for size, found in arcs.items():
            hit = found >= 0
            share = np.exp((alpha[: n - size + 1] + beta[size:] - alpha[n])[hit] + logs[found[hit]])
            uses += np.bincount(found[hit] + 1, share, len(uses))
        return uses[1:]


def normalised(uses: dict[bytes, float], words: float, prior: float) -> Lattice:
    """Two distributions: over the pieces that begin a word, and over other pieces and the word's end.

    ``prior`` is added to each use; single bytes are always pieces, so every word has a segmentation.
    """
    full = {bytes([b]): 0.0 for b in range(256)} | uses
    begin = {p: c + prior for p, c in full.items() if p[:1] == b" "}
    inner = {p: c + prior for p, c in full.items() if p[:1] != b" "}
    a, b = sum(begin.values()), sum(inner.values()) + words + prior
    logs = {p: float(np.log(c / a)) for p, c in begin.items()} | {p: float(np.log(c / b)) for p, c in inner.items()}
    return Lattice(logs, float(np.log((words + prior) / b)))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each length as rows of bytes after a space, with their numbers; long ones in small parts."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, (1 << 16) // (int(n) + 1))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            yield some, np.frombuffer(b"".join(b" " + words[k] for k in some), np.uint8).reshape(len(some), -1)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def score_texts(docs: DataFrame, path: str, rounds: int = 2, prior: float = 0.1) -> DataFrame:
    """Log10 probabilities of texts (``doc_id``, ``text``, ``held_out``), learned from rows not held out.

    A text is its words (by ASCII white space, A-Z lower-cased) and one end token; null text is empty.
    The probability of a word is (c - D) / N from its count c among N training tokens, plus what the
    discount D frees times its lattice probability: the sum over all segmentations into the
    vocabulary's pieces, by forward recursion in log space, times that of the word's end. D is n1 /
    (n1 + 2 n2), from the numbers of words seen once and twice. The lattice starts from the
    vocabulary's own scores; ``rounds`` of expectation maximisation over the different training words
    (each once) fit its weights. The end token has its share of the training tokens alone. Where training
    has no word at all the lattice alone scores words. Log probabilities stay in log space, so words of
    any length have their own.

    Where ``docs`` has a column ``class`` (a language, say; of few values, as each has a column of
    counts), counts are kept apart for each value and for null, and a text's probability is the
    mixture over these by their share of the training texts; its own class is no input.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (seen in training), ``train_tokens``
    (N), ``base_score`` (add-half unigram), ``score`` and ``lattice_score``: the marginal log10
    probability of the words by the vocabulary's own scores, with nothing learned. Rows that repeat an
    id are kept. With no training row N is 0 and words score by the lattice alone. An empty table gives
    an empty table.

    Texts are dealt by hash into groups of about ``GROUP_BYTES`` and sent twice: once to list a group's
    different words with their counts, once to meet their scores. Counts are summed and words scored
    once each, by word, beside the list of the groups that hold it; a word's scores go to each of these. The driver gets sums over the corpus and
    the uses of the vocabulary's pieces, bound by its size.
    """
    spark = docs.sparkSession
    kind = F.col("class") if "class" in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"), kind.cast("string").alias("class"))
    first = docs.groupBy("class").agg(F.sum(F.octet_length("text")).alias("b"), F.count_if(~F.col("held_out")).alias("n"))
    first = written(first, "classes")
    total = first.agg(F.sum("b")).first()[0] or 0
    named = [r[0] for r in first.where("class is not null and n > 0").orderBy("class").collect()]
    many = len(named) + 1
    groups = max(32, -(-total // GROUP_BYTES))
    which = F.coalesce(F.array_position(F.array(*map(F.lit, named)), F.col("class")), F.lit(0)) if named else F.lit(0)
    dealt = docs.select(
        "doc_id", "text", "held_out", which.cast("int").alias("k"),
        F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).cast("int").alias("g"))
    names = [f"c{i}" for i in range(many)]

    def listed(key, table):
        counts, seen = [Counter() for _ in names], {END}
        for batch in table.to_batches():
            for text, out, k in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), batch.column("k").to_pylist(), strict=True):
                words = _tokens(text)
                if out:
                    seen.update(words)
                else:
                    counts[k].update(words)
                    counts[k][END] += 1
        words = [*seen.union(*counts)]
        columns = [pa.array([c.get(w, 0) for w in words], pa.int64()) for c in counts]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(words), pa.int32()), pa.array(words, pa.binary()), *columns], ["g", "word", *names])

    ddl = ", ".join(f"{c} bigint" for c in names)
    lists = dealt.groupBy("g").applyInArrow(listed, f"g int, word binary, {ddl}")
    counts = written(lists.groupBy("word").agg(*(F.sum(c).alias(c) for c in names), F.collect_list("g").alias("groups")), "word-counts")
    c = [F.col(x) for x in names]
    every = reduce(lambda a, b: a + b, c)
    sums = counts.agg(
        F.count_if(every > 0),
        *(f for x in c for f in (F.sum(x), F.count_if(x > 0), F.count_if(x == 1), F.count_if(x == 2), F.sum(F.when(F.col("word") == END, x))))).first()
    kinds, per = int(sums[0]), np.array([int(x or 0) for x in sums[1:]], float).reshape(many, 5)
    tokens, ends = int(per[:, 0].sum()), per[:, 4]
    discount = np.clip(per[:, 2] / np.maximum(per[:, 2] + 2 * per[:, 3], 1), 0.05, 0.95)
    free = np.where(per[:, 0] > 0, discount * (per[:, 1] - (ends > 0)) / np.maximum(per[:, 0], 1), 1.0)
    share = ends / ends.sum() if ends.sum() else np.eye(many)[0]
    if not free[share > 0].any():
        free = np.ones_like(free)  # no training text has a word

    model = own = normalised({p: float(np.exp(s)) * 1e4 for p, s in vocabulary(path).items()}, 1e4, prior)
    for _ in range(rounds if kinds else 0):
        shared = spark.sparkContext.broadcast(pickle.dumps(model))

        def used(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = pickle.loads(shared.value)
            uses = np.zeros(len(lattice.pieces))
            for batch in batches:
                for _, rows in by_length([w for w in batch.column(0).to_pylist() if w != END]):
                    uses += lattice.expected(rows)
            hit = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(uses[hit])], ["piece", "uses"])

        got = counts.where(every > 0).select("word").mapInArrow(used, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        model = normalised(dict.fromkeys(model.pieces, 0.0) | {model.pieces[r.piece]: r.uses for r in got}, float(kinds), prior)

    by_piece = dict(zip(own.pieces, own.logs, strict=True))
    shared = spark.sparkContext.broadcast(pickle.dumps((model, np.array([by_piece[p] for p in model.pieces]), own.end)))

    fields = ["word", *names, "lattice", "own", "groups"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, own_logs, own_end = pickle.loads(shared.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            logs, own = np.zeros(len(words)), np.zeros(len(words))
            for at, rows in by_length(words):
                arcs = lattice.arcs(rows)
                logs[at] = lattice.forward(rows, arcs)[-1] + lattice.end
                own[at] = lattice.forward(rows, arcs, own_logs)[-1] + own_end
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs), pa.array(own), batch.columns[-1]], fields)

    scores = written(counts.select("word", *names, "groups").mapInArrow(scored, f"word binary, {ddl}, lattice double, own double, groups array<int>"), "word-scores")
    by_group = scores.select(F.explode("groups").alias("g"), *fields[:-1])

    def summed(left, right):
        index = dict(zip(right.column("word").to_pylist(), range(right.num_rows), strict=True))
        c = np.stack([right.column(x).to_numpy() for x in names]).astype(float)
        n = np.maximum(per[:, :1], 1)
        with np.errstate(divide="ignore"):
            s = np.logaddexp(np.log(np.maximum(c - discount[:, None], 0) / n), np.log(free)[:, None] + right.column("lattice").to_numpy())
            s[:, index[END]] = np.log(np.maximum(c[:, index[END]], 0.5) / n[:, 0])
            prior_of = np.log(share)
        seen, own = c.sum(0), right.column("own").to_numpy()
        base = np.log10((seen + 0.5) / (tokens + 0.5 * (kinds + 1)))
        rows = []
        for text in left.column("text").to_pylist():
            words = _tokens(text)
            at = np.array([*map(index.__getitem__, words), index[END]])
            by_class = s[:, at].sum(1) + prior_of
            rows.append((len(at), int((seen[at] > 0).sum()), float(base[at].sum()), float(np.logaddexp.reduce(by_class) / np.log(10)), float(own[at[:-1]].sum() / np.log(10))))
        n_tokens, known, b, score, lattice = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * len(rows), pa.int64()), pa.array(b, pa.float64()), pa.array(score, pa.float64()), pa.array(lattice, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double"
    return dealt.select("doc_id", "text", "held_out", "g").groupBy("g").cogroup(by_group.groupBy("g")).applyInArrow(summed, out)
