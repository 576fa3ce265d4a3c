"""Alignment against whole-text encodings and pair counts by brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from oracle import SMALL
from tokenizers import Tokenizer

from cardloom.llm import alignment, queries

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def whole():
    """Group lists of a text by encoding it whole; None where it has no tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {}
    n = 0
    for i in range(256):
        shown = 33 <= i <= 126 or 161 <= i <= 172 or i >= 174
        letters[chr(i) if shown else chr(256 + n)] = i
        n += not shown

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return None
        want = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        said_a, said_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [*map(bytes_b, ids_b)]
        if b"".join(said_a) != want or b"".join(said_b) != want:
            return None

        def ends(said):
            at, out = 0, []
            for x in said:
                at += len(x)
                out.append(at)
            return out

        ends_a, ends_b = ends(said_a), ends(said_b)
        common = sorted(set(ends_a) & set(ends_b))
        return [([i for i, e in zip(ids_a, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(ids_b, ends_b, strict=True) if lo < e <= hi])
                for lo, hi in zip([0, *common], common, strict=False)]

    return groups


def brute(texts, groups):
    """The rows of ``linked_counts`` for texts in order, without ids."""
    cut = [groups(t) or [] for t in texts]
    links = [Counter((i, j) for x, y in g for i in x for j in y) for g in cut]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for g, c in zip(cut, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out, count, best


ODD = [None, "", " ", "  ", "\n", "\na", " a", "a ", "a\nb", "a \nb", "a;\r\nb", "x \r y", "a  b   c", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "tab\there", " x  ",
       "é 漢字 \U0001f642\U0001f642 ﬁ", "1,234.50 it's", "x" * 3000, " " * 700, "wort " * 5000, "あ" * 500, "a\n\n\nb", "it’s “so”", "\u0000a \u0001", "A, b. C,\nd."]


def test_pieces_align_as_whole_texts(whole):
    rng = random.Random(5)
    letters = list("abcdeXYZ019,.;'\"()<>|_-\n\n\t\r     ") + ["é", "漢", "\U0001f642", "́", "▁", " ", "　", "\u0085", "the ", " and", "ing", "\n\n", "{\r", "�", "ا"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    with open(A, "rb") as x, open(B, "rb") as y:
        aligner = alignment.Aligner(alignment.Vocabularies(x.read(), y.read()), most=5000)
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        for text, said in zip(some, aligner.align(some)["groups"], strict=True):
            want = whole(text) or []
            assert said == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want), repr(text)


def test_query_equals_brute_force(spark, whole):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = brute([r.text for r in rows], whole)
    got = {r[0]: tuple(r[1:]) for r in queries.op12_token_alignment(spark, SMALL).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3])
def test_odd_texts(spark, whole, monkeypatch, frequent):
    """Nulls, empty and long texts, repeated rows and ids, no ids, clashing columns; with and without pairs that are not frequent."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    texts = [*ODD, ODD[18], ODD[18]]
    rows = [(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(texts)]
    got = alignment.linked_counts(spark.createDataFrame(rows, "doc_id long, text string, pair string, n_best int"), A, B)
    want, count, best = brute(texts, whole)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))
    table = alignment.alignment_table(spark.createDataFrame(rows, "doc_id long, text string, pair string, n_best int"), A, B)
    assert {(r.a, r.b): (r.n, r.best) for r in table.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_groups_and_nothing(spark):
    one = alignment.align(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B, keep_groups=True).where("vector is null").first()
    assert one.n_groups == 2 and one.groups.count(";") == 1
    assert alignment.linked_counts(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
