"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, parts, small_batches, written

#: Characters of the longest n-gram.
ORDER = 4
#: Mass of an unseen character: one of so many.
ALPHABET = 4096
#: Bytes of texts that a task looks at together.
STEP = 1 << 17
_MUL = np.uint64(0x9E3779B97F4A7C15)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or a space for what is no letter; 1 is the text's edge."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[1] = 1
        _TABLE.append(table)
    return _TABLE[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts, lower-cased, with one space for each run of others and ``ORDER - 1`` edges before each
    text; and for each character the number of its text. Edges are code 1 (a text's own such codes are spaces)."""
    edge = "\x01" * (ORDER - 1)
    joined = "".join(edge + t.replace("\x01", " ") for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.array([len(t) + ORDER - 1 for t in texts])
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | ((codes[:-1] != 32) & (codes[:-1] != 1))
    return codes[keep], of[keep]


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the hash of the n characters that end at each place (0 where there are none)."""
    one = (codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
    one ^= one >> np.uint64(29)
    out = [one]
    for _ in range(1, ORDER):
        h = np.zeros_like(one)
        h[1:] = out[-1][:-1] * _MUL
        h += one
        h ^= h >> np.uint64(31)
        out.append(h)
    return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of sorted ``keys`` at ``wanted``, and where they were found."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def fit(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """An interpolated Kneser-Ney model: for n = 1..ORDER sorted hashes of n-grams with their log probability, and
    sorted hashes of contexts (n - 1 characters) with the log weight of the shorter model."""
    codes, _ = characters(texts)
    hs = hashes(codes)
    real = np.flatnonzero(codes != 1)
    if not len(real):
        return []
    context = [np.zeros(len(codes), np.uint64)] + [np.concatenate(([np.uint64(0)], h[:-1])) for h in hs[:-1]]
    grams, counts = [], [None] * ORDER
    for n in range(ORDER):
        keys, first, raw = np.unique(hs[n][real], return_index=True, return_counts=True)
        grams.append((keys, real[first]))
        counts[n] = raw
    for n in range(ORDER - 1):  # of shorter n-grams count what may stand before them
        ends = hs[n][grams[n + 1][1]]
        keys, kinds = np.unique(ends, return_counts=True)
        got, found = _find(keys, kinds, grams[n][0])
        counts[n] = np.where(found, got, 1)
    model, lower = [], None
    for n in range(ORDER):
        keys, at = grams[n]
        c = counts[n].astype(float)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        contexts, inverse = np.unique(context[n][at], return_inverse=True)
        total, kinds = np.bincount(inverse, c), np.bincount(inverse)
        weight = discount * kinds / total
        below = np.full(len(keys), 1 / ALPHABET) if lower is None else np.exp(_find(*lower, hs[n - 1][at])[0])
        prob = np.log((c - np.minimum(discount, c)) / total[inverse] + weight[inverse] * below)
        model.append((keys, prob, contexts, np.log(weight)))
        lower = keys, prob
    return model


def log_probs(model: list, hs: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Log probability of the character at each place given those before it."""
    out = np.full(len(at), -np.log(ALPHABET))
    for n, (keys, prob, contexts, weight) in enumerate(model):
        before = hs[n - 1][at - 1] if n else np.zeros(len(at), np.uint64)
        w, known = _find(contexts, weight, before)
        p, found = _find(keys, prob, hs[n][at])
        out = np.where(found, p, out + np.where(known, w, 0.0))
    return out


def cross_entropies(models: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character of each text under each model, and the number of characters (0: no letter)."""
    codes, of = characters(texts)
    sizes = np.zeros(len(texts), np.int64)
    sums = np.zeros((len(texts), len(models)))
    if not len(codes):
        return sums, sizes
    hs = hashes(codes)
    real = np.flatnonzero(codes != 1)
    real = real[real > 0]
    if len(real):
        groups, kinds = pd.factorize(hs[-1][real])
        at = np.empty(len(kinds), np.int64)
        at[groups] = real
        for k, model in enumerate(models):
            sums[:, k] = np.bincount(of[real], log_probs(model, hs, at)[groups], len(texts))
        sizes = np.bincount(of[real], minlength=len(texts))
    letters = np.bincount(of[(codes != 1) & (codes != 32)], minlength=len(texts))
    sizes = np.where(letters > 0, sizes, 0)
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows (``lang``, ``text``) of each language, in the order of a hash of their id.

    A first cut by the hash keeps about twice that, so that no task sorts a whole language."""
    counts = written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")  # broadcast by its size
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    few = labelled.join(counts, "lang").withColumn("_h", place).where(
        F.col("_h") * F.col("_n") <= 2 * per_language + 16)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_k") <= per_language).select("lang", "text", "_k")


class LanguageModel:
    """Models, names, limits and spreads of languages; see ``learn`` and ``predict``."""

    def __init__(self, names: list[str], models: list, limits: list[float], spreads: list[float]):
        self.names, self.models, self.limits, self.spreads = names, models, np.array(limits), np.array(spreads)


def spread(model: list, texts: list[str]) -> float:
    """The standard deviation of a character's log probability."""
    codes, _ = characters(texts)
    real = np.flatnonzero(codes != 1)
    return float(log_probs(model, hashes(codes), real).std()) if len(real) else 0.0


def learn(labelled: DataFrame, per_language: int = 400, quantile: float = 0.99, slack: float = 1.6, sigmas: float = 3.0) -> LanguageModel:
    """Fit one model per language on ``per_language`` labelled documents at most (``doc_id``, ``text``, ``lang``).

    Every fifth of the sample is held back: the limit of a language's cross-entropy is ``slack`` times
    the ``quantile`` of those texts', for a text of n characters plus ``sigmas`` standard deviations of
    a character's log probability over the root of n. Rows of null text or language are left out. A
    language is fitted in one task, from at most ``per_language`` whole texts; the models (a size bound
    by that, one for every language there is) come to the driver.
    """

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        held = pdf["_k"] % 5 == 0
        texts, back = list(pdf.text[~held]), list(pdf.text[held])
        model = fit(texts)
        give_back()
        if not model:
            return pd.DataFrame({"lang": [], "model": [], "limit": [], "spread": []})
        h, n = cross_entropies([model], back or texts)
        h = h[n > 0, 0]
        limit = float(np.quantile(h, quantile) * slack) if len(h) else float("inf")
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "model": [pickle.dumps([tuple(a.astype(np.float32) if a.dtype == float else a for a in m) for m in model])], "limit": [limit], "spread": [spread(model, back or texts)]})

    rows = sample(labelled.where("text is not null and lang is not null").select("doc_id", "lang", "text"), per_language)
    got = sorted(rows.groupBy("lang").applyInPandas(fitted, "lang string, model binary, limit double, spread double").collect())
    return LanguageModel([r.lang for r in got], [pickle.loads(r.model) for r in got], [r.limit for r in got], [sigmas * r.spread for r in got])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` from the whole ``text`` alone.

    The language of least cross-entropy per character; ``score`` is its share (0 to 1) of the models'
    likelihoods per character to the power 20; ``rejected`` where the text has no letter or its
    cross-entropy exceeds the language's limit for its length. Null text, text without a letter, and any text if no
    language was learned, give ``und``, 0 and true. Columns of these names in ``docs`` are replaced.
    An empty table gives an empty table. There is no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.models, model.limits, model.spreads))
    new = ["lang_pred", "score", "rejected"]
    rest = [c for c in docs.columns if c not in new]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, models, limits, spreads = shared.value
        for batch in batches:
            for part in parts(batch, batch.column("text"), STEP):
                h, n = cross_entropies(models, [x or "" for x in part.column("text").to_pylist()])
                if names:
                    best = h.argmin(1)
                    low = h[np.arange(len(h)), best]
                    score = np.where(n > 0, 1 / np.exp(np.maximum(-700, 20 * (low[:, None] - h))).sum(1), 0.0)
                    out = (n == 0) | (low > limits[best] + spreads[best] / np.sqrt(np.maximum(n, 1)))
                    lang = [names[b] if k else "und" for b, k in zip(best, n, strict=True)]
                else:
                    lang, score, out = ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=rest + new)
        give_back()

    return docs.select(*rest).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    """Whether a document is kept from learning: the crc32 of its id as text leaves this rest."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
