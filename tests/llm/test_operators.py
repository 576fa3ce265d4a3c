"""Operators without SQL against brute force, and every operator on nulls, ties, repeats and empty tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardloom.llm import bpe, chat, jaccard, language, lattice, line_dedup, media, mixing, queries, token_store, topk

SCHEMA = "doc_id long, text string, lang string, source string, size long, ids string, media string"
ODD = [
    (1, None, "en", None, 9, "x", "y"), (2, "", "en", "a", None, "x", "y"), (3, "a b c d e f", None, "b", 1, None, None), (3, "a b c d e f", None, "b", 1, None, None),
    (4, "A b  c\nd\te f ", "en", "b", 1, "x", "y"), (5, "wort " * 30_000, "de", "a", 1, "x", "y"), (None, "no id here", "en", "a", 1, "x", "y"),
    (6, " \n\n <|endoftext|> é漢字🙂 it's 12,5!!  ", "fr", "c", 1, "x", "y"), (7, "x" * 5000, "fr", "c", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return text.encode().lower().split()


def test_lattice_scores(spark, docs):
    got = by_id(queries.op1_lattice_scores(spark, SMALL))
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(w for i, t in docs if not out[i] for w in [*words(t), b" "])
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        ws = [*words(t), b" "]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert -1e6 < r.score < 0


def test_fitted_scores_do_not_depend_on_partitions(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, f"some words {i % 7} of texts{i % 5} that repeat {'x' * (i % 4)}", i % 5 == 1) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    some, others = (by_id(lattice.score_texts(t, path)) for t in (table.repartition(1), table.repartition(9)))
    assert all(some[i].score == pytest.approx(others[i].score, rel=1e-9) for i, *_ in rows)


def test_lattice_sums_all_segmentations():
    weights = {b"a": 3.0, b"b": 2.0, b"ab": 5.0, b" a": 4.0, b" ": 1.0, b" ab": 2.0}
    m = lattice.normalised(weights, 7.0, 0.1)
    p = {piece: math.exp(x) for piece, x in zip(m.pieces, m.logs)}
    cut = p[b" "] * p[b"a"] * p[b"b"] + p[b" "] * p[b"ab"] + p[b" a"] * p[b"b"] + p[b" ab"]
    row = np.frombuffer(b" ab", np.uint8)[None]
    assert m.log_probs(row)[0] == pytest.approx(math.log(cut) + m.end)
    assert m.expected(row)[m.pieces.index(b" ab")] == pytest.approx(p[b" ab"] / cut)
    assert sum(math.exp(x) for q, x in zip(m.pieces, m.logs) if q[:1] == b" ") == pytest.approx(1)


def log_of_all_cuts(model, word):
    """The log of the sum over all segmentations, by a plain loop."""
    logs, text = dict(zip(model.pieces, model.logs)), b" " + word
    longest, alpha = max(map(len, logs)), [0.0]
    for j in range(1, len(text) + 1):
        ways = [alpha[i] + logs[text[i:j]] for i in range(max(0, j - longest), j) if text[i:j] in logs]
        alpha.append(max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways)))
    return alpha[-1] + model.end


def test_lattice_of_long_words(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    weights = lattice.vocabulary(path)
    assert " Становништво".encode() in weights
    model = lattice.normalised({p: math.exp(s) * 1e4 for p, s in weights.items()}, 1e4, 0.1)
    long = [hashlib.sha512(b"word").hexdigest() * 40, "Становништво" + "漢字仮名министрацииинистратив" * 80, "Становништво", "z" * 30_000]
    long = [w.encode()[:5000].decode(errors="ignore") if i < 2 else w for i, w in enumerate(long)]
    for w in long[:3]:
        row = np.frombuffer(b" " + w.encode(), np.uint8)[None]
        assert model.log_probs(row)[0] == pytest.approx(log_of_all_cuts(model, w.encode()), rel=1e-12)
    rows = [(i, w, True) for i, w in enumerate(long)]
    want = [log_of_all_cuts(model, w.encode().lower()) for w in long]
    assert want[0] < -745 and want[3] < -1e5
    ddl = "doc_id long, text string, held_out boolean"
    alone = by_id(lattice.score_texts(spark.createDataFrame(rows, ddl), path, rounds=0))
    for i, w in enumerate(want):
        assert alone[i].score == pytest.approx((w + math.log(0.5)) / math.log(10), rel=1e-9)
        assert alone[i].lattice_score == pytest.approx(w / math.log(10), rel=1e-9)
    # of a, a, b and the end, two are seen once and one twice: a discount of 1/2, for two words of four tokens
    learned = by_id(lattice.score_texts(spark.createDataFrame([*rows, (9, "a a b", False)], ddl), path, rounds=0))
    for i, w in enumerate(want):
        assert learned[i].score == pytest.approx((w + math.log(0.25) + math.log(0.25)) / math.log(10), rel=1e-9)
    # texts without words in the training of one class say nothing of the other
    classes = [(*r, "x") for r in rows] + [(9, "a a b", False, "x"), (10, "", False, "y")]
    both = by_id(lattice.score_texts(spark.createDataFrame(classes, ddl + ", class string"), path, rounds=0))
    for i in range(len(long)):
        assert both[i].score == pytest.approx(learned[i].score + math.log10(0.5), rel=1e-9)
    none = by_id(lattice.score_texts(spark.createDataFrame([*rows, (9, "", False)], ddl), path, rounds=0))
    for i, w in enumerate(want):
        assert none[i].score == pytest.approx(w / math.log(10), rel=1e-9)
    assert len({none[i].score for i in range(len(long))}) == len(long)


def test_scores_of_odd_rows_and_of_an_independent_sum(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = odd.select("doc_id", "text", (F.col("doc_id") % 2 == 1).alias("held_out"), F.lit("x").alias("score"), F.lit(1).alias("word"))
    got = lattice.score_texts(rows, path, rounds=0).collect()
    assert len(got) == len(ODD) and lattice.score_texts(rows.limit(0), path).count() == 0
    model = lattice.normalised({p: math.exp(s) * 1e4 for p, s in lattice.vocabulary(path).items()}, 1e4, 0.1)
    train = [r[1] or "" for r in ODD if r[0] is None or r[0] % 2 == 0]
    c = Counter(w for t in train for w in [*words(t), b" "])
    n, ones, twos, ends = sum(c.values()), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()), c[b" "]
    d = min(0.95, max(0.05, ones / (ones + 2 * twos)))
    free = d * (len(c) - 1) / n
    of = {w: log_of_all_cuts(model, w) for r in ODD for w in set(words(r[1] or ""))}
    for r in got:
        texts = [x[1] or "" for x in ODD if x[0] == r.doc_id]
        logs = [math.log(math.exp(of[w]) * free + max(0, c[w] - d) / n) if of[w] > -700 else of[w] + math.log(free) for w in words(texts[0])]
        assert r.score == pytest.approx((sum(logs) + math.log(ends / n)) / math.log(10), rel=1e-9)
        assert r.lattice_score == pytest.approx(sum(of[w] for w in words(texts[0])) / math.log(10), rel=1e-9)
        assert (r.n_tokens, r.n_known) == (len(logs) + 1, sum(w in c for w in words(texts[0])) + 1)


def test_classes_are_mixed_by_their_share(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, f"only{i}", False, f"c{i}") for i in range(12)] + [(99, "only3", True, None)]
    got = by_id(lattice.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, class string"), path, rounds=0))
    model = lattice.normalised({p: math.exp(s) * 1e4 for p, s in lattice.vocabulary(path).items()}, 1e4, 0.1)
    free = 0.95 / 2  # each class: its word once, its end once; a discount of 1 is cut to 0.95
    word = math.exp(log_of_all_cuts(model, b"only3"))
    want = (sum(free * word * 0.5 for _ in range(11)) + (0.05 / 2 + free * word) * 0.5) / 12
    assert got[99].score == pytest.approx(math.log10(want), rel=1e-9)


def test_bpe_equals_tiktoken(spark, odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(odd.select("doc_id", "text", "ids"), path, public_tokenizers.PATTERN)
    for r in coded.withColumn("back", bpe.decode(F.col("ids"), path)).collect():
        assert (r.ids, bytes(r.back)) == (e.encode_ordinary(r.text or ""), (r.text or "").encode())
    got = by_id(queries.op2_byte_bpe(spark, SMALL))
    for i, t in docs:
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e.encode_ordinary(t))).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] \\ <\\| <|im_end|> <\\\\|"
    rows = [(1, 0, "system", "be \\ brief"), *((1, i, ("assistant", "user")[i % 2], f"{said} {i}\n" * 30) for i in range(1, 40)), (None, None, None, None), (2, 5, "us<|er\nx", "a"), (2, 5, "assistant", None)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 400, 200)
    assert windows.where("conv_id = 1").count() > 3
    back = sorted(chat.read_windows(windows).where("conv_id = 1").collect(), key=lambda r: r.window)
    assert [(t.role, t.text) for r in back for t in r.turns] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert [t for r in back for t in r.targets] == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert all("be \\\\ brief" in r.formatted for r in back)
    assert {t.role for r in chat.read_windows(windows).where("conv_id = 2").collect() for t in r.turns} == {"us<|er\nx", "assistant"}
    assert windows.where("conv_id is null").first().n_turns == 1
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mix(spark, odd):
    got = mixing.mix(odd.drop("size")).collect()
    assert len(got) == len(ODD) and {r.source: r.source_size for r in got}[None] == 0
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken <= 2 * r.size for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert mixing.mix(odd.limit(0).drop("size")).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.learn(docs.select("doc_id", "text", "lang"))
    good = language.predict(docs, model)
    assert good.where("lang = lang_pred").count() >= 0.97 * good.count()
    assert good.where("rejected").count() <= 0.02 * good.count()
    got = language.predict(odd, model).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    none = language.predict(odd, language.learn(odd.where("lang = 'xx'")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and language.predict(odd.limit(0), model).count() == 0


def test_kneser_ney_by_dictionaries():
    texts = ["abra cadabra", "a bar, a car!", "Abracadabra bab"]
    streams = ["\x01\x01\x01" + t for t in ("abra cadabra", "a bar a car ", "abracadabra bab")]
    order, model = language.ORDER, language.fit(texts)
    grams = [Counter(s[i - n : i + 1] for s in streams for i in range(3, len(s))) for n in range(order)]
    counts = [Counter(g[1:] for g in grams[n + 1]) for n in range(order - 1)] + [grams[-1]]

    def prob(gram):
        n = len(gram) - 1
        below = prob(gram[1:]) if n else 1 / language.ALPHABET
        c = counts[n]
        ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        after = {g: x for g, x in c.items() if g[:-1] == gram[:-1]}
        if not after:
            return below
        total = sum(after.values())
        return (max(0, c[gram] - d) if gram in c else 0) / total + d * len(after) / total * below

    for t, s in (("abra", "abra"), ("czbra cab", "czbra cab"), ("BAR?? ab", "bar ab")):
        s = "\x01\x01\x01" + s
        want = -sum(math.log(prob(s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)
        h, n = language.cross_entropies([model], [t])
        assert n[0] == len(s) - 3 and h[0, 0] == pytest.approx(want, rel=1e-6)


def test_languages_of_all_kinds_and_lengths_are_told_or_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.learn(docs.select("doc_id", "text", "lang"))
    foreign = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "我能吞下玻璃而不伤身体", "чай", "zzqx jjwkq xzzv qqkzj wvxk zzjq kkqx"]
    rows = [(i, t) for i, t in enumerate(foreign)] + [(10, "the"), (11, "de la"), (12, "a"), (13, "")]
    got = by_id(language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model))
    assert [got[i].rejected for i in (0, 1, 2, 3, 10, 11, 12, 13)] == [True] * 4 + [False] * 3 + [True]
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 9, f"l{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    learned = language.learn(many)
    assert len(learned.names) == 300
    assert language.predict(many, learned).where("lang = lang_pred").count() == 300


def test_near_duplicates(spark, docs):
    texts = docs + [(10_000, "a b"), (10_001, "A  B"), (10_002, "a b c"), (10_003, ""), (10_004, None)] + [(20_000 + i, " ".join(f"w{j}" if j != 20 * i else "new" for j in range(400))) for i in range(12)]
    got = by_id(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90))
    sets = {}
    for i, t in texts:
        w = words(t or "")
        sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_wide_bitmaps_fold_and_bound():
    rng = np.random.default_rng(5)
    for n in (100, 300, 700, 5000):
        own = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        words = jaccard.wide_words(len(own))
        assert (words == 0) == (n <= 256)
        wide = jaccard.bitmap(own, words or 16)
        half = len(wide) // 2
        assert (wide[:half] ^ wide[half:] == jaccard.bitmap(own, half)).all()
        other = np.unique(np.concatenate((own[n // 10 :], rng.integers(0, 2**63, n // 10, dtype=np.uint64))))
        bits = sum(int(x).bit_count() for x in (wide ^ jaccard.bitmap(other, len(wide))).view(np.uint64))
        assert bits <= len(np.setxor1d(own, other))


def test_near_duplicates_of_long_texts_at_the_threshold(spark):
    """Sizes about a doubling of the bitmap, and parts changed so that some pairs link and some just do not."""
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for n in (255, 262, 505, 530, 1020, 1040, 2100):
        words = [f"w{n}x{j}" for j in range(n)]
        for share in (0, 0.03, 0.09, 0.1, 0.105, 0.11, 0.115, 0.12, 0.13, 0.2):
            cut = int(n * share)
            at = int(rng.integers(0, n - cut + 1))
            rows.append((i, " ".join(words[:at] + [f"n{i}x{j}" for j in range(cut)] + words[at + cut :])))
            i += 1
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = {d: min(ra, rb) if r in (ra, rb) else r for d, r in root.items()}
    # ids of two texts, large and small: wide bitmaps of the large ones tell nothing of the small ones
    small = " ".join(f"s{j}" for j in range(30))
    rows += [(900, small), (901, small + " more")] + [(d, " ".join(f"v{d}x{j}" for j in range(600))) for d in (900, 901)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = {(r.doc_id, r.component_id) for r in got.collect()}
    assert {x for x in found if x[0] < 900} == set(root.items())
    assert len(set(root.values())) > 7
    assert (901, 900) in found


def test_near_duplicates_of_odd_rows(odd):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_top_k_ties_and_gaps(spark):
    rows = [(0, [1, -2]), (1, [1, -2]), (2, [1, -2]), (3, [0, 0]), (4, [-5, 1]), (5, None), (6, [3])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<int>")
    got = topk.top_k(v.where("vec_id in (0, 3, 5)"), v, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 5), (0, 2, 5), (0, 3, 0), (3, 0, 0), (3, 1, 0), (3, 2, 0)]
    assert topk.top_k(v.limit(0), v, 3).count() == 0


def test_no_random_access_reads_less_and_finds_all():
    rng = np.random.default_rng(1)
    for spread, n, part in ((9, 500, 64), (2, 700, 100), (60, 900, 900)):
        x = rng.integers(-spread, spread, (n, 12))
        x[::3] = x[0]  # a third of all alike
        ids = rng.permutation(n) * 3
        got = topk.search_block(ids, x, ids, x, 20, part)
        for q in range(n):
            s = x @ x[q]
            want = [i for i in np.lexsort((ids, -s)) if i != q][:20]
            mine = got[got.query_id == ids[q]]
            assert mine.vec_id.tolist() == ids[want].tolist() and mine.score.tolist() == s[want].tolist()


def test_bounds_let_outsiders_go():
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 21, (2000, 16))
    q = x[:1]
    best = topk.Best(1, 5)
    best.add(0, np.arange(-5, 0), np.full(5, int((x @ q[0]).max())))
    seen = []

    class Counted(topk.Lists):
        def ends(self, share):
            seen.append(share)
            return super().ends(share)

    topk.read(Counted(np.arange(2000), x), q, np.array([0]), best)
    assert seen and seen[-1] < max(topk.DEPTHS) and best.ids[0].tolist() == [-5, -4, -3, -2, -1]


def test_top_k_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (1, [nan, 1.0], "x"), (2, [inf, 1.0], "x"), (3, None, "x"), (4, [None, 1.0], "x"), (20, [2.0, 1.0], None), (None, [9.0, 9.0], "x"), (40, [], "x"), (5, [0.5, -0.01], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.embedding_top_k(v).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 20, 64 * 64 * 4), (0, 5, 64 * (32 - 2)), (20, 0, 64 * 64 * 4), (20, 0, 64 * 64 * 4), (20, 5, 64 * (64 - 1))]
    assert topk.embedding_top_k(v.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((200, 16)) * 5000).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(x.astype(float) * 64).astype(np.int64)
    scores = whole @ whole.T
    assert abs(scores).max() > 2**31
    got = topk.embedding_top_k(v, k=5).orderBy("query_id", "rank").collect()
    want = [(q, i, scores[q, i]) for q in range(0, 200, 20) for i in [i for i in np.lexsort((np.arange(200), -scores[q])) if i != q][:5]]
    assert [(r.query_id, r.vec_id, r.score) for r in got] == want
    far = np.array([[2**40, 1], [-(2**40), 1]])
    assert topk.search_block(np.arange(2), far, np.array([-1]), np.array([[2**20, 1]]), 2).score.tolist() == [2**60 + 1, -(2**60) + 1]
    with pytest.raises(ValueError):
        topk.search_block(np.arange(2), far, np.array([-1]), np.array([[2**40, 1]]), 2)


def test_lines(odd):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd, 2, 1).collect()}
    assert got[1].text == "" and got[1].n_lines == 1 and got[3].n_dropped == 0
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_token_store(spark, odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got, start = by_id(queries.op9_token_store(spark, SMALL)), 0
    for i, text in sorted(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/odd-store"
    token_store.write_store(odd, path, folder)
    back = sorted((r.doc_id or 0, r.ids) for r in token_store.read_ids(spark, folder).collect())
    assert back == sorted((d[0] or 0, [*t.encode(d[1] or "", add_special_tokens=False).ids, 0]) for d in ODD)
    assert token_store.damaged(spark, folder).count() == 0


def test_streams(odd, spark):
    for r in media.media_digests(odd.select("doc_id", "text")).collect():
        raw = next(d[1] or "" for d in ODD if d[0] == r.doc_id).encode()
        p = media.padded(raw.decode())
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    good = media.write_stream(bytes(100_000))
    assert media.read_stream(good)["gaps"] == 0
    flipped = good[:9] + bytes([good[9] ^ 1]) + good[10:]  # in the program table
    for bad in (b"", good[:-1], good[: 188 * 2], flipped, b"\0" + good[1:]):
        with pytest.raises((ValueError, IndexError)):
            media.read_stream(bad)
    starts = [i for i in range(0, len(good), 188) if good[i + 1] & 0x40]
    cut = starts[2] + 188 * 20  # a packet within an access unit
    with pytest.raises(ValueError):
        media.read_stream(good[:cut] + good[cut + 188 :])
    assert media.media_digests(odd.limit(0).select("doc_id", "text")).count() == 0


def test_near_copies_go_by_text_not_by_id(spark):
    import corpus_pipeline

    def text(name, new=()):
        return " ".join("new" if j in new else f"{name}{j}" for j in range(200))

    rows = [
        (1, text("a")), (5, text("a", [3])), (5, text("b")), (5, text("b")), (6, text("b", [9])), (7, text("a")), (7, text("e")), (8, text("c")), (8, text("d")),
        (2, text("f", [1])), (-4, text("f")), (9, ""), (9, None), (9, None), (10, "a b"), (11, "A b"), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect()
    named = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t or "")) else set() for _, t in named]
    group = list(range(len(named)))
    for _ in named:  # least label around, until none changes
        for i, s in enumerate(sets):
            for j, t in enumerate(sets):
                if s and 100 * len(s & t) >= 80 * len(s | t):
                    group[i] = min(group[i], group[j])
    want = [r for i, r in enumerate(named) if group[i] == i] + [r for r in rows if r[0] is None]
    assert (5, text("b")) in want and (7, text("e")) in want and (5, text("a", [3])) not in want
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        names.append(name)
    assert corpus_pipeline.run(spark, SMALL).where("not decodes").count() == 0
