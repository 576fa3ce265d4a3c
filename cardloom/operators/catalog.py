"""Catalogue tables: upserts, first-wins deduplication, lookups and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_uid, normalize_number, variant_class
from .ranks import values_at_ranks


def with_uid(cards: DataFrame) -> DataFrame:
    return cards.withColumn("uid", canonical_uid(F.col("language"), F.col("set_id"), F.col("local_id"), F.col("variant")))


def market_queries(cards: DataFrame) -> DataFrame:
    """Two search texts per card: name, set, number and variant; name, number and set. Blank: null."""
    number = normalize_number(F.col("local_id"))
    variant = F.when(variant_class(F.col("variant")) == "standard", "").otherwise(F.col("variant"))
    joined = lambda *xs: F.nullif(F.array_join(F.filter(F.array(*[F.trim(F.coalesce(x, F.lit(""))) for x in xs]), lambda x: x != ""), " "), F.lit(""))
    return cards.select("id", joined(F.col("name"), F.col("set_id"), number, variant).alias("query_us"), joined(F.col("name"), number, F.col("set_id")).alias("query_eu"))


def first_seen(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row of least ordinal for each key."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.col(ordinal)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, batch: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Replace by key; of a batch's rows of one key the last by ordinal stays."""
    fresh = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), F.col(ordinal)).alias("r"))
    fresh = fresh.select(key, "r.*").select(*old.columns)
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)


def concat_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all, with the place of their source in the order given."""
    marked = [f.withColumn("source_order", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def dedupe_results(results: DataFrame, ordinal: str, ids: Sequence[str]) -> DataFrame:
    """First result by (name, set, number); each provider id is the first that is not null, in order."""
    keys = ["name", "set_id", "local_id"]
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in ids]
    return results.groupBy(*keys).agg(F.min(ordinal).alias("place"), *filled)


def category_counts(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def axis_bounds(points: DataFrame, axes: Sequence[str], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """One row with the quantiles ``lo`` and ``hi`` of each axis, to six places; see ``quantiles``."""
    found = quantiles(points, axes, (lo, hi))
    return found.agg(*(F.round(F.max(F.when((F.col("axis") == a) & (F.col("q") == q), F.col("value"))), 6).alias(f"{a}_{n}") for a in axes for n, q in (("lo", lo), ("hi", hi))))


def focus(points: DataFrame, axes: Sequence[str], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Points within the quantile bounds on all axes; the bounds are one row."""
    found = quantiles(points, axes, (lo, hi))
    bounds = found.agg(*(F.max(F.when((F.col("axis") == a) & (F.col("q") == q), F.col("value"))).alias(f"_{a}_{n}") for a in axes for n, q in (("lo", lo), ("hi", hi))))
    inside = reduce(lambda a, b: a & b, [F.col(a).between(F.col(f"_{a}_lo"), F.col(f"_{a}_hi")) for a in axes])
    return points.join(F.broadcast(bounds)).where(inside).select(*points.columns)


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page without query and fragment, each once, at its first place."""
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda x: F.regexp_replace(x, "[?#].*$", ""))
    found = pages.select("page_id", F.posexplode(links).alias("place", "link")).where("link <> ''")
    return found.groupBy("page_id", "link").agg(F.min("place").alias("place"))


def highlight(points: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Points whose name or variant holds ``text`` in any case, of one variant if given."""
    found = F.contains(F.lower(F.concat_ws(" ", "name", "variant")), F.lit(text.lower()))
    return points.where(found if kind is None else found & (F.col("variant") == kind))


def with_image(cards: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    return cards.join(images.select(key), key, "left_semi")


def unseen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    return rows.join(seen.select(*keys), list(keys), "left_anti")


def union_candidates(candidates: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """Per ``by`` the first ``limit`` different (set, name), in any case, by source and id."""
    keys = [F.lower("set_id").alias("set_key"), F.lower("name").alias("name_key")]
    first = candidates.groupBy(by, *keys).agg(F.min(F.struct("source_order", "id")).alias("f"))
    w = Window.partitionBy(by).orderBy("f")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(by, "f.source_order", "f.id", "place")


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of these columns is null or blank."""
    there = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in columns]
    return rows.where(reduce(lambda a, b: a & b, there))


def quantiles(points: DataFrame, axes: Sequence[str], at: Sequence[float]) -> DataFrame:
    """Exact quantiles of columns, between two values in proportion: ``axis``, ``q``, ``value``. Nulls do not count; a column without values has no rows."""
    long = points.select(F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes))))
    place = lambda q, n: q * (n - 1) + 1
    ranks = lambda n: F.array(*(f(place(q, n)) for q in at for f in (F.floor, F.ceil)))
    found = values_at_ranks(long, ["axis"], "value", ranks)
    entry = F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v")
    by_axis = found.groupBy("axis").agg(entry, F.max("n").alias("n"))

    def between(q: float) -> Column:
        exact = place(q, F.col("n"))
        low, high = F.element_at("_v", F.floor(exact)), F.element_at("_v", F.ceil(exact))
        return F.struct(F.lit(float(q)).alias("q"), (low + (high - low) * (exact - F.floor(exact))).alias("value"))

    return by_axis.select("axis", F.inline(F.array(*map(between, at))))


def manifest(crops: DataFrame, by: str, crop: str) -> DataFrame:
    """Per label its crops in order, and how many there are."""
    return complete(crops, by).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(crop)).alias("crops"))


def provenance(points: DataFrame, *by: str) -> DataFrame:
    """How many points there are of each value of each column."""
    counts = [points.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("by"), "value", "n") for c in by]
    return reduce(lambda a, b: a.unionByName(b), counts)
