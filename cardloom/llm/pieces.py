"""Splitting texts into independent pieces and remembering what distinct pieces encode to."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single space between two non-spaces is always where a pre-token begins, so texts can be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")
#: A letter or digit before a last comma or full stop: the mark is a pre-token of its own.
_MARKED = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ɏ][,.]\Z")
#: Distinct pieces that a worker remembers, about 230 bytes each.
REMEMBERED = 300_000
#: Characters from which a piece is not remembered.
LONG = 64


def _even(text: str) -> bool:
    """Whether all white space of a text is single and between non-spaces."""
    return not _RUN.search(text) and not text[:1].isspace() and not text[-1:].isspace()


def space_pieces(text: str) -> list[str]:
    """Cut a text at single spaces, and before single line ends, between non-spaces. Every piece but the
    first begins after its space, or with its line end where it has one (see ``as_in_text``)."""
    if _even(text):
        return text.replace("\n", " \n").split(" ")
    return _CUT.split(text)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of each, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def column_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of many texts (see ``space_pieces``) one after another, and how many each has."""
    strings = texts.to_pylist()
    even = np.array([_even(t) for t in strings], bool)
    cut = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(even)), "\n", " \n"), " ")
    odd = [_CUT.split(t) for t, e in zip(strings, even, strict=True) if not e]
    pieces, counts = cut.flatten(), np.empty(len(strings), np.int64)
    counts[even], counts[~even] = pc.list_value_length(cut).to_numpy(zero_copy_only=False), [len(x) for x in odd]
    if odd:
        pieces = pa.concat_arrays([pieces, pa.array([p for x in odd for p in x], pieces.type)])
        order = np.argsort(np.concatenate([np.flatnonzero(even), np.flatnonzero(~even)]))
        sizes = np.concatenate([counts[even], counts[~even]])
        pieces = pieces.take(pa.array(ranges((np.cumsum(sizes) - sizes)[order], sizes[order])))
    return pieces, counts


def as_in_text(piece: str) -> str:
    """A later piece as it stands in its text."""
    return piece if piece[:1] == "\n" else " " + piece


class PieceEncoder:
    """Encodes whole texts by their pieces; ids are little-endian unsigned 32-bit integers.

    ``ids_of(str)`` gives the ids of any text. Distinct pieces that are not remembered go to it many at
    once, as ``lines`` lines of one text, whose ids are parted at those of the line ends: a line end
    before a non-space is a token of its own. Pieces that hold other white space or a ``special`` string
    go alone. The first ``most`` pieces are remembered, as the most
    frequent come early; where many more have come since, the table starts anew.
    """

    def __init__(self, ids_of: Callable[[str], np.ndarray], lines: int, most: int = REMEMBERED, special: Sequence[str] = ()):
        self.odd = re.compile("|".join([r"(?s:.)\s|^[^\S \n]", *map(re.escape, special)]))
        self.ids_of, self.lines, self.most, self.passed = ids_of, lines, most, 0
        self.known: dict[str, bytes] = {}
        self.marks = {c: self._one(c) for c in ",.\n"}
        self.line = int.from_bytes(self.marks["\n"], "little") if len(self.marks["\n"]) == 4 else None

    def _one(self, text: str) -> bytes:
        return self.ids_of(text).astype("<u4").tobytes() if text else b""

    def encode_strings(self, strings: Sequence[str]) -> dict[str, bytes]:
        """The ids of these strings, each as it stands in its text or at its beginning."""
        out, plain = {}, []
        for s in strings:
            if self.line is None or s in ("", " ", "\n") or self.odd.search(s):
                out[s] = self._one(s)
            else:
                plain.append(s)
        first = self.marks["\n"]
        for i in range(0, len(plain), self.lines):
            some = plain[i : i + self.lines]
            ids = self.ids_of("\n".join([s[1:] if s[0] == "\n" else s for s in some])).astype("<u4", copy=False)
            data, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.line)).tolist(), 4 * len(ids)]
            starts = [0, *(e + 4 for e in ends[:-1])]
            out.update(zip(some, [first + data[a:b] if s[0] == "\n" else data[a:b] for s, a, b in zip(some, starts, ends, strict=True)], strict=True))
        return out

    def _new(self, missing: set[str], heads: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Later pieces that are not known, and first ones; a comma or full stop after a word does not make another word."""
        marked = [p for p in missing if _MARKED.search(p)]
        known = self.known
        bases = [p for p in missing.difference(marked).union([p[:-1] for p in marked]) if p not in known]
        strings = list(map(as_in_text, bases))
        made = self.encode_strings([*heads.union(strings)])
        out = {p: made[s] for p, s in zip(bases, strings, strict=True)}
        for p in marked:
            base = p[:-1]
            out[p] = (out.get(base) or known[base]) + self.marks[p[-1]]
        room = self.most - len(known)
        if room > 0:
            known.update([x for x in out.items() if len(x[0]) < LONG][:room])
        else:
            self.passed += len(out)
            if self.passed > 4 * self.most:
                known.clear()
                self.passed = 0
        return out, made

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        get, cut, found, heads = self.known.get, [], [], []
        missing: set[str] = set()
        for t in texts:
            pieces = space_pieces(t)
            heads.append(pieces.pop(0))
            ids = list(map(get, pieces))
            if None in ids:
                missing.update([p for p, x in zip(pieces, ids, strict=True) if x is None])
            else:
                pieces = []
            cut.append(pieces)
            found.append(ids)
        new, first = self._new(missing, set(heads))
        return [
            first[h] + b"".join([new[p] if x is None else x for p, x in zip(pieces, ids, strict=True)] if pieces else ids)
            for h, pieces, ids in zip(heads, cut, found, strict=True)]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return flat[ranges(starts, sizes)]


class ColumnEncoder:
    """Encodes columns of whole texts by their distinct pieces, with the ids of all pieces in flat arrays.

    ``ids_of``, ``lines``, ``most`` and ``special`` as for ``PieceEncoder``, whose rules are kept: which pieces go
    to ``ids_of`` together and which alone, and how many are remembered."""

    def __init__(self, ids_of: Callable[[str], np.ndarray], lines: int, most: int = REMEMBERED, special: Sequence[str] = ()):
        self.single = PieceEncoder(ids_of, lines, 0, special)
        self.ids_of, self.lines, self.most, self.passed = ids_of, lines, most, 0
        self.alone = re.compile("|".join([r"[^\S\n ]", *map(re.escape, special)]))
        self.mark = {c: np.frombuffer(self.single.marks[c], "<u4") for c in ",."}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _made(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of later pieces, and where each has its own. Pieces go in groups as lines of one text, each after its line end."""
        found, starts, sizes, at = [], [], [], 0
        for i in range(0, len(pieces), self.lines):
            some = pieces[i : i + self.lines]
            ended = np.array([p[0] == "\n" for p in some])
            text = "\n" + "\n".join([p[1:] if p[0] == "\n" else " " + p for p in some])
            ends = None
            if self.single.line is not None and not self.alone.search(text) and text.count("\n") == len(some) and text.count(" ") == len(some) - ended.sum() and "\n" not in some:
                ids = self.ids_of(text)
                ends = np.flatnonzero(ids == self.single.line)
            if ends is not None and len(ends) == len(some):
                starts.append(ends + ~ended + at)
                sizes.append(np.append(ends[1:], len(ids)) - ends - ~ended)
            else:
                one = self.single.encode_strings([*map(as_in_text, some)])
                parts = [np.frombuffer(one[as_in_text(p)], "<u4") for p in some]
                ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
                starts.append(np.cumsum(n) - n + at)
                sizes.append(n)
            found.append(ids)
            at += len(ids)
        if not found:
            return np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(starts), np.concatenate(sizes)

    def _lookup(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these later pieces and of others, and where each of these has its own."""
        known = len(self.starts)
        number = np.array(list(map(self.number.get, distinct, repeat(-1))), np.int64)
        at = np.flatnonzero(number < 0)
        missing = [distinct[i] for i in at.tolist()]
        marked = np.array([p[-1] in ",." and _MARKED.match(p, len(p) - 2) is not None for p in missing], bool)
        todo = [p for p, m in zip(missing, marked, strict=True) if not m]
        names = [p for p, m in zip(missing, marked, strict=True) if m]
        number[at[~marked]] = known + np.arange(len(todo))
        number[at[marked]] = known + np.arange(len(names))  # shifted below, as their words may be new
        new = dict(zip(todo, range(known, known + len(todo)), strict=True))
        base = []
        for p in names:
            n = self.number.get(p[:-1])
            if n is None:
                n = new.setdefault(p[:-1], known + len(new))
            base.append(n)
        todo = [*new]
        number[at[marked]] += len(todo)
        ids, starts, sizes = self._made(todo)
        flat = np.concatenate([self.flat, ids])
        starts, sizes = np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.sizes, sizes])
        if names:
            n = sizes[base]
            marks = [self.mark[p[-1]] for p in names]
            own = np.insert(_gather(flat, starts[base], n), np.repeat(np.cumsum(n), [len(m) for m in marks]), np.concatenate(marks))
            n = n + [len(m) for m in marks]
            starts, sizes, flat = np.concatenate([starts, np.cumsum(n) - n + len(flat)]), np.concatenate([sizes, n]), np.concatenate([flat, own])
        self._remember(todo + names, flat, starts[known:], sizes[known:])
        return flat, starts[number], sizes[number]

    def _remember(self, names: list[str], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.starts)
        if known < self.most:
            keep = [i for i, p in enumerate(names) if len(p) < LONG][: self.most - known]
            n = sizes[keep]
            self.number.update(zip([names[i] for i in keep], range(known, known + len(keep)), strict=True))
            self.starts = np.concatenate([self.starts, np.cumsum(n) - n + len(self.flat)])
            self.flat, self.sizes = np.concatenate([self.flat, _gather(flat, starts[keep], n)]), np.concatenate([self.sizes, n])
            return
        self.passed += len(names)
        if self.passed > 4 * self.most:
            self._forget()
            self.passed = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (null is empty) one after another, and how many each has."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        pieces, counts = column_pieces(pc.fill_null(texts, ""))
        coded = pieces.dictionary_encode()
        codes, firsts = coded.indices.to_numpy().astype(np.int64), np.cumsum(counts) - counts
        heads = pieces.take(pa.array(firsts)).to_pylist()
        later = np.ones(len(codes), bool)
        later[firsts] = False
        used = np.bincount(codes[later], minlength=len(coded.dictionary)) > 0
        flat, starts, sizes = self._lookup(coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        first = self.single.encode_strings([*set(heads)])
        own = [first[h] for h in heads]
        n = np.array([len(x) // 4 for x in own])
        codes = (np.cumsum(used) - 1)[codes]
        codes[firsts] = len(starts) + np.arange(len(heads))
        starts, sizes = np.concatenate([starts, np.cumsum(n) - n + len(flat)]), np.concatenate([sizes, n])
        each = sizes[codes]
        return _gather(np.concatenate([flat, np.frombuffer(b"".join(own), "<u4")]), starts[codes], each), np.add.reduceat(each, firsts)
