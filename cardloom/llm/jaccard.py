"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, parts, small_batches, written
from .hashing import mixed, shingle_sets

#: 64-bit words of a bitmap signature.
BITMAP = 8
#: Bits an element that the wide bitmap of a large set has at least; sets that need no more than ``BITMAP`` words have none.
WIDE = 2
#: Bits of a tile's name: fewer cost fewer bytes of the largest shuffle, and unlike parts that share a name only add
#: candidates. Of 10^13 tiles (some 100 TB of texts) about one in 30 would share its name with an unlike one.
NAME = 48
#: Growth of the size bands.
BAND = 1.5
#: Bytes of texts whose shingles a task holds at once; hashing takes about 50 times that.
STEP = 1 << 19
#: Members of a tile that meet in one group; larger tiles are cut into blocks.
MEMBERS = 256
#: Tiles that a member of open tiles carries, the smallest, so that a pair which shares several is made in the first alone.
CARRIED = 16
#: Documents whose ids may be broadcast to pick their texts; more are joined by a shuffle.
FEW = 500_000


def bands(largest: int) -> list[int]:
    """Least sizes of the bands, up to the first over ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def most_apart(size: int, percent: int) -> int:
    """Most elements in one of two sets but not in both, where the larger has ``size`` and 100 * |both| >= percent * |either|."""
    return 2 * size * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def parts_of(size: int, least: int, percent: int) -> tuple[int, int]:
    """Parts of a band whose largest set has ``size`` elements, and how many empty parts a set may have unseen.

    Sets that are alike differ in ``m`` parts at most. Of ``m + 1 + x`` parts ``x + 1`` are equal, so one
    of them holds something unless more than ``x`` are empty. ``x`` is the least that few sets exceed.
    """
    m, best = most_apart(size, percent), (2.0, 1, 0)
    for x in range(m // 4 + 9):
        k = m + 1 + x
        mean = k * (1 - 1 / k) ** least
        over = 0.5 * math.erfc((x + 0.5 - mean) / math.sqrt(2 * mean + 1e-9))  # of a normal of that mean and variance
        best = min(best, (over, k, x))
        if over < 1e-3:
            return k, x
    return best[1:]


def tiles(own: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a set of shingle hashes: two sets that are alike share one at least.

    Elements are dealt into parts by hash, as many as ``parts_of`` the larger set's band says, so that
    one part that is equal in both holds something. A tile names band, part and the sum of the part's
    elements. Only sets with more empty parts than allowed for also name those. A set takes part in
    its own band and in those that a larger set like it can be in.
    """
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    least = bands(n * 100 // percent)
    out, strong = [], mixed(own ^ np.uint64(0xA24BAED4963EE407))
    for b in range(np.searchsorted(least, n, "right") - 1, len(least) - 1):
        if least[b] > n * 100 // percent:
            break
        parts, spare = parts_of(least[b + 1] - 1, max(1, least[b] * percent // 100), percent)
        part = ((own >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        ends = np.cumsum(counts)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(strong[order], out=sums[1:])
        key = mixed(np.arange(parts, dtype=np.uint64) + np.uint64(b << 40)) + counts.astype(np.uint64)
        named = mixed(mixed(sums[ends] - sums[ends - counts]) ^ key)
        out.append(named if (counts == 0).sum() > spare else named[counts > 0])
    return np.concatenate(out) >> np.uint64(64 - NAME)


def bitmap(own: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """A bit per hash value, flipped by each element: two bitmaps differ in no more bits than the sets in elements.

    With a power of two as ``words``, the exclusive or of a bitmap's halves is the bitmap of half as many."""
    flips = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def wide_words(size: int) -> int:
    """Words of the wide bitmap of a set of ``size`` elements; 0: it has none."""
    words = 1 << max(0, WIDE * size - 1).bit_length()
    return words // 64 if words > 64 * BITMAP else 0


def _per_text(docs: DataFrame, shingle: int, ddl: str, maker, fresh: bool = False) -> DataFrame:
    """Columns made from the sets of each document; ``fresh``: by what ``maker`` gives in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker() if fresh else maker
        for batch in batches:
            for part in parts(batch, batch.column(1), STEP):
                sets = shingle_sets([x or "" for x in part.column(1).to_pylist()], shingle)
                yield _batch(part.column(0), make(sets))
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, " + ddl)


def _batch(ids: pa.Array, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *columns.values()], ["doc_id", *columns])


def _lists(arrays: list[np.ndarray], of: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, of))


def _whole(own: np.ndarray) -> bytes:
    """16 bytes that tell a set."""
    one = mixed(own ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.array([one.sum(dtype=np.uint64), mixed(one).sum(dtype=np.uint64)], np.uint64)
    return mixed(sums + np.uint64(len(own))).tobytes()


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document the size of its set and a hash of the whole set."""

    def make(sets: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"n": pa.array([len(s) for s in sets], pa.int64()), "whole": pa.array([_whole(s) for s in sets], pa.binary())}

    return _per_text(docs, shingle, "n bigint, whole binary", make)


def _tiled(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per document its tiles; of equal sets a task tells one, so copies do not crowd a tile."""

    def maker():
        told: set[bytes] = set()

        def make(sets: list[np.ndarray]) -> dict[str, pa.Array]:
            if len(told) > 1_000_000:
                told.clear()
            out = []
            for s in sets:
                key = _whole(s)
                out.append(tiles(s, percent) if key not in told else np.zeros(0, np.uint64))
                told.add(key)
            return {"tiles": _lists(out, pa.int64())}

        return make

    return _per_text(docs, shingle, "tiles array<bigint>", maker, fresh=True)


def _bitmaps(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document the bitmap of its set and, of a large set, the wide one."""
    names = [f"b{i}" for i in range(BITMAP)]

    def make(sets: list[np.ndarray]) -> dict[str, pa.Array]:
        maps = np.stack([bitmap(s) for s in sets]) if sets else np.zeros((0, BITMAP), np.int64)
        wide = [bitmap(s, w) if (w := wide_words(len(s))) else None for s in sets]
        return {c: pa.array(maps[:, i].copy()) for i, c in enumerate(names)} | {"wide": pa.array(wide, pa.list_(pa.int64()))}

    return _per_text(docs, shingle, ", ".join(f"{c} bigint" for c in names) + ", wide array<bigint>", make)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (``a``, ``b``): ``node``, ``component``.

    Labels take the least label around, then their label's label, until none changes; each round is
    a written table. Labels and edges stay distributed.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_n")).agg(F.min("component").alias("_m"))
        least = labels.join(around, F.col("node") == F.col("_n")).select("node", F.col("component").alias("_old"), F.least("component", "_m").alias("_c"))
        jumped = least.join(labels.select(F.col("node").alias("_n"), F.col("component").alias("_m")), F.col("_c") == F.col("_n"), "left")
        new = written(jumped.select("node", "_old", F.least("_c", "_m").alias("component")), "labels")
        if new.where("_old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _alike(x: str, y: str, percent: int) -> Column:
    """What sizes and bitmaps allow: bits that differ bound the elements that do from below."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(BITMAP)])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits * (100 + percent) <= (n + m) * (100 - percent))


def _folded(wide: Column, words: Column) -> Column:
    """A wide bitmap as one of ``words`` words: that many, or half as many, as it has."""
    halves = F.zip_with(F.slice(wide, 1, words), F.slice(wide, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(wide) > words, halves).otherwise(wide)


def _not_told_apart(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that wide bitmaps allow, and those without them on either side.

    Sizes of pairs that come here are alike, so one bitmap has twice the other's words at most; other
    sizes are those of further texts of an id, which tell nothing."""
    one = signs.select(F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("wide").alias("v"))
    two = signs.select(F.col("doc_id").alias("b"), "n", "wide")
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    words = F.least(F.size("v"), F.size("wide"))
    bits = F.aggregate(
        F.zip_with(_folded(F.col("v"), words), _folded(F.col("wide"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    untold = F.col("v").isNull() | F.col("wide").isNull() | (F.size("v") > 2 * words) | (F.size("wide") > 2 * words)
    return both.where(F.when(untold, True).otherwise(bits * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))).select("a", "b")


def _candidates(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that sizes and bitmaps allow."""
    both = pairs.alias("p").join(signs.alias("x"), F.expr("p.a = x.doc_id")).join(signs.alias("y"), F.expr("p.b = y.doc_id"))
    return both.where(_alike("x", "y", percent))


def _open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the tiles that hold more than one component by ``links``, with their component, the tile's
    most common one and its number of rows."""
    labels = components(links).withColumnRenamed("node", "doc_id")
    placed = shared.select("tile", "doc_id", F.col("head.doc_id").alias("first")).join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    kinds = placed.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("k"))
    tiles = kinds.groupBy("tile").agg(F.max_by("component", F.struct("k", "component")).alias("common"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("size"))
    return written(placed.join(tiles.where("kinds > 1"), "tile"), "open-tiles")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of these ids (a written table), broadcast only where they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")


def _linked(pairs: DataFrame, signs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of documents whose sets are alike, by exact intersection of sorted arrays.

    Only pairs that wide bitmaps leave are compared, and only their texts are shuffled: compressed they are
    a fraction of their sets' hashes."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.column("text_a"), STEP // 2):
                one, two = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
                seen = list(dict.fromkeys(x or "" for x in one + two))
                own, good = dict(zip(seen, shingle_sets(seen, shingle), strict=True)), []
                for x, y in zip(one, two, strict=True):
                    s, t = own[x or ""], own[y or ""]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(100 * both >= percent * (len(s) + len(t) - both))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])
        give_back()

    pairs = written(_not_told_apart(written(pairs.select("a", "b"), "allowed"), signs, percent), "pairs")
    needed = _of(docs, written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed"))
    one = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(exact, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of documents (``doc_id``, ``text``).

    A document's set holds its different ``shingle``-word shingles (words by ASCII white space, A-Z
    lower-cased; with fewer words, all of them as one). Two are linked where 100 * |both| >= percent
    * |either|. ``component_id`` is the smallest id reachable by links, the document's own included.
    Null text, and text without words, has an empty set and no link. Rows that repeat an id should
    repeat its text: of unlike texts of one id, each has the component of its own class, and a link of
    one may count for the other. A null id is returned with a null component and links nothing. An
    empty table gives an empty table.

    Sets are compared by the 64-bit hashes of their shingles, and equal sets are told by two sums of
    them, 64 bits each, and their size: two of n shingles share a hash with probability n^2 / 2^65 (for a
    million shingles in one pair of sets under 1 in 10^7), two of n sets a class with n^2 / 2^129.

    Sets that are equal are one class, held by its smallest id, so copies cost a row each. Classes
    meet only in a tile (see ``tiles``), which unlike texts do not share even where they share long
    passages. In a tile all are first compared with its
    smallest, so large groups of near copies become one component by few pairs. Then each member outside
    a tile's most common component meets all members of others, in blocks (a tile that lies within
    another is left out); sizes and bitmaps decide
    which pairs are compared exactly. No pair that is linked is left out unless its ends are connected
    already.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    signed = written(_signed(docs, shingle), "signed")
    some = signed.where("n > 0 and doc_id is not null")
    classes = written(some.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")
    within = Window.partitionBy("tile")
    told = _tiled(docs.where("doc_id is not null"), shingle, percent).select("doc_id", F.explode("tiles").alias("tile"))
    ends = [F.min("doc_id").over(within).alias("lo"), F.max("doc_id").over(within).alias("hi")]
    # near copies share most of their tiles: tiles of the same members become one (by their hash; a clash only adds candidates)
    crowded = told.select("*", *ends, F.bit_xor(F.xxhash64("doc_id")).over(within).alias("members")).where("lo <> hi")
    crowded = written(crowded.select(F.xxhash64("lo", "hi", "members").alias("tile"), "doc_id").distinct(), "tiles")
    named = written(
        crowded.select("doc_id").distinct().join(some, "doc_id")
        .join(classes.select("whole", F.col("doc_id").alias("holder")), "whole").select("doc_id", "holder", "n").distinct(), "holders")
    rows = crowded.join(named, "doc_id").select("tile", F.col("holder").alias("doc_id"), "n").distinct()
    stats = rows.groupBy("tile").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    every = written(rows.join(stats, "tile"), "tiles")
    # a tile whose members are all in the one tile that is the largest of each has no pair of its own
    largest = every.groupBy("doc_id").agg(F.max_by("tile", F.struct("size", "tile")).alias("largest"))
    needed = every.join(largest, "doc_id").groupBy("tile").agg(F.min("largest").alias("lo"), F.max("largest").alias("hi")).where("lo <> hi OR lo = tile")
    shared = written(every.join(needed.select("tile"), "tile").select("tile", "doc_id", "n", "head"), "tiles")
    wanted = written(every.select("doc_id").distinct(), "wanted")
    signs = written(_bitmaps(_of(docs, wanted), shingle).join(every.select("doc_id", "n").distinct(), "doc_id"), "signs")
    stars = every.where("doc_id <> head.doc_id").select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    narrow = signs.drop("wide")
    links = written(_linked(_candidates(stars, narrow, percent), signs, docs, shingle, percent), "links")
    rest = _open(shared, links).where("doc_id <> first").withColumn("lone", F.col("component") != F.col("common"))  # the first has met all
    carried = rest.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("tile")), 1, CARRIED).alias("carried"))
    rest = written(rest.join(narrow, "doc_id").join(carried, "doc_id"), "open-rows")
    blocks = F.ceil(F.col("size") / MEMBERS).cast("int")
    left = rest.where("lone").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    # both ends of a pair are in its least shared tile, where it is made; a tile is passed over only for a smaller one that both carry
    first = ~F.coalesce(F.array_min(F.array_intersect("x.carried", "y.carried")) < F.col("x.tile"), F.lit(False))
    apart = (
        left.alias("x").join(right.alias("y"), F.expr("x.tile = y.tile AND x.block = y.block AND x.component <> y.component AND (NOT y.lone OR x.doc_id < y.doc_id)") & _alike("x", "y", percent) & first)
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    )
    more = written(_linked(apart, signs, docs, shingle, percent), "links")
    whole = written(components(links.union(more)), "components")
    of_class = written(
        classes.select("whole", "doc_id").join(whole, F.col("doc_id") == F.col("node"), "left")
        .select("whole", F.coalesce("component", "doc_id").alias("component_id")), "classes-of")
    return signed.select("doc_id", "n", "whole").join(of_class, "whole", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
