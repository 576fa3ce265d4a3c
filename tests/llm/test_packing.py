"""Packing against whole-text encodings, a best fit of single pieces, lower bounds and odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import SMALL
from tokenizers import Tokenizer

from cardloom.llm import packing, queries
from cardloom.llm.packing import Capacity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(sizes, capacity, weights, score):
    """Best fit of single pieces, longest first: the sorted contents of each bin."""
    limits, bins = [int(x) for x in capacity.limits], []
    for s in sorted(sizes, reverse=True):
        demand, best = (s, 1, s * s), None
        for b in bins:
            left = b[0]
            if all(x >= y for x, y in zip(left, demand, strict=True)):
                share = [(x / z, y / z) for x, y, z in zip(left, demand, limits, strict=True)]
                value = sum(w * ((x - y) ** 2 if score == "norm" else x * y) for w, (x, y) in zip(weights, share, strict=True))
                if best is None or value < best[0] - 1e-15:
                    best = value, b
        if best is None:
            bins.append([[max(x, y) for x, y in zip(limits, demand, strict=True)], []])
            best = 0, bins[-1]
        best[1][0] = [x - y for x, y in zip(best[1][0], demand, strict=True)]
        best[1][1].append(s)
    return sorted(b[1] for b in bins)


def contents(groups):
    """The same from groups of bins, with the ranks and offsets of every piece checked."""
    bins, ranks = defaultdict(list), defaultdict(list)
    for size, first, n, each, at, sequence in packing.slots(groups).tolist():
        for i in range(n):
            bins[sequence + i // each].append((at + i % each * size, size))
            ranks[size].append(first + i)
    for rank in ranks.values():
        assert sorted(rank) == list(range(len(rank)))
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
    return sorted([size for _, size in sorted(b)] for b in bins.values())


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity, weights", [
    (Capacity(64), (1, 0, 0)), (Capacity(64, 3), (1, 1, 0)), (Capacity(64, 5, 1500), (1, 0.5, 2)), (Capacity(64, None, 200), (1, 1, 1))])
def test_best_fit(capacity, weights, score):
    rng = random.Random(len(score))
    for n in (1, 7, 300):
        sizes = [rng.choice([1, 2, 3, 5, 9, 20, 33, 40, 63, 64, rng.randint(1, 64)]) for _ in range(n)]
        counts = {s: sizes.count(s) for s in sizes}
        got = contents(packing.best_fit(counts, capacity, weights, score))
        for b in got:
            assert sum(b) <= capacity.tokens and len(b) <= capacity.limits[1] and (len(b) == 1 or sum(x * x for x in b) <= capacity.limits[2])
        assert sorted(x for b in got for x in b) == sorted(sizes)
        want = one_by_one(sizes, capacity, weights, score)
        # the order of equally good bins may differ
        assert abs(len(got) - len(want)) <= len(want) // 50


def test_best_fit_of_one_capacity_is_exact():
    sizes = [random.Random(i).randint(1, 1024) for i in range(2000)]
    got = contents(packing.best_fit({s: sizes.count(s) for s in sizes}, Capacity()))
    filled = lambda bins: sorted(map(sum, bins))  # noqa: E731  (bins filled alike are interchangeable)
    assert filled(got) == filled(one_by_one(sizes, Capacity(), (1, 0, 0), "norm"))
    assert len(got) <= -(-sum(sizes) // 1024) * 1.01
    with pytest.raises(ValueError):
        packing.best_fit({2000: 1}, Capacity())


def test_many_pieces_are_few_groups():
    groups = packing.best_fit({s: 10**12 + 7 * s for s in range(1, 1025)}, Capacity())
    assert sum(g.bins for g in groups) * 1024 >= sum(s * (10**12 + 7 * s) for s in range(1, 1025))
    assert len(groups) < 5000


def pieces_of(rows):
    t = Tokenizer.from_file(PATH)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at, to, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            yield i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())
            at, to, k = to, to + 1024, k + 1


def check(got, rows):
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(pieces_of(rows))
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(filled)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op13_best_fit_packing(spark, SMALL).collect()
    lengths = [r.length for r in got]
    assert check(got, rows) == len(one_by_one(lengths, Capacity(), (1, 0, 0), "norm"))


def test_odd_texts_and_sequences(spark):
    texts = [None, "", "a", "<|endoftext|>", "wort " * 30_000, "x " * 1023, "x " * 1022, "é漢字\n\n ", "same", "same"]
    rows = [(None if i == 2 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 5, 1, "x") for r in rows], "doc_id long, text string, length int, offset int, _rank string").repartition(5)
    check(packing.pack_texts(df, PATH).collect(), rows)
    cut = packing.written(packing.cut_texts(df, PATH, 2), "cut")
    packed = packing.pack(cut, Capacity(1024, 3, 600_000), (1, 1, 1), "dot").cache()
    assert packed.count() == cut.count()
    whole = packing.sequences(packed).collect()
    by_place = {(r.sequence_id, r.offset): r.ids for r in packed.collect()}
    for s in whole:
        assert len(s.documents) <= 3 and s.n_tokens == sum(d.length for d in s.documents) == len(s.ids) // 4
        assert bytes(s.ids) == b"".join(bytes(by_place[s.sequence_id, d.offset]) for d in s.documents)
    assert packing.pack_texts(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_cut_ids_are_those_of_whole_texts(spark, size):
    texts = [None, "", "a", "x " * 1022, "x " * 1023, " wort,\n\n wort, <|endoftext|>", None, "wort wort, " * 900]
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        ends = [*range(len(ids), 0, -size)][::-1]
        want += [(i, k, a, b - a, ids[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    got = packing.cut_texts(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1), PATH, 2, size).collect()
    assert [(r.doc_id, r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want


def test_pieces_without_length(spark):
    df = spark.createDataFrame([(1, 5, "x", 1), (2, None, "x", 1), (3, 0, "x", 1), (4, 1024, "x", 1), (5, 5, "x", 1)], "doc_id long, length int, offset string, _rank int")
    got = {r.doc_id: (r.sequence_id is None, r.offset) for r in packing.pack(df).collect()}
    assert got[2] == got[3] == (True, None) and got[4] == (False, 0) and sorted((got[1], got[5])) == [(False, 0), (False, 5)]
