"""Columns of texts by their distinct pieces, against the tokenizers library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cardloom.llm.pieces import ColumnEncoder, column_pieces, space_pieces

PARTS = ["Hand", "hand,", "hand.", "x.,", ",", ".", "a", "don't", "'s", "é.", "ñu,", "日本語", "1234", "12.5,", "<|endoftext|>", "a<|endoftext|>b", " ", "x　y", "\x85", "\x1c", "q" * 80]
SPACES = [" "] * 12 + ["\n"] * 4 + ["  ", " \n", "\n\n", "\t", "\r\n", "\n ", ""]


def texts(n):
    r = random.Random(5)
    made = ["".join(r.choice(PARTS) + r.choice(SPACES) for _ in range(r.randrange(25))).strip(r.choice(["", " \n"])) for _ in range(n)]
    return [None, "", " ", "\n", " a", "a ", *made]


def test_column_pieces():
    some = [t or "" for t in texts(400)]
    pieces, counts = column_pieces(pa.array(some))
    assert pieces.to_pylist() == [p for t in some for p in space_pieces(t)] and counts.tolist() == [len(space_pieces(t)) for t in some]


@pytest.mark.parametrize("most", [0, 7, 10_000])
def test_ids_are_those_of_whole_texts(most):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = sorted(x.content for x in tokenizer.get_added_tokens_decoder().values())
    sent = []

    def ids_of(text):
        sent.append(text)
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    encoder, some = ColumnEncoder(ids_of, 5, most, special), texts(600)
    for i in (0, 0, 200, 400):
        part = some[i : i + 206]
        ids, counts = encoder.encode(pa.array(part, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []
    assert len(encoder.number) <= most

    # a piece goes to the library once, however often a column has it, and not again where it is remembered
    before = len(sent)
    encoder.encode(pa.array(["w " + "zebra " * 50 + "zebra, zebra.", "w zebra"]))
    assert sum(t.count("zebra") for t in sent[before:]) == 1
    encoder.encode(pa.array(["w zebra"]))
    assert sum(t.count("zebra") for t in sent[before:]) <= (1 if most == 10_000 else 2)
