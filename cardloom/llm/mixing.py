"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written


def random_key(doc_id: Column, seed: str) -> Column:
    """A hash of seed and id that orders documents at random, alike in every run."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets per source from (``source``, ``source_size``): one row per source in and out.

    Water-filling in closed form: with sources sorted by cap/weight, the level is the first at which
    what is left, dealt by weight, exceeds no cap of the rest.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("_n", F.row_number().over(by_name) - 1).withColumns({
        "_w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")),
        "_cap": F.col("source_size") * F.lit(float(cap)),
    })
    leveled = weighed.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumn(
        "_level",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)))
        / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return leveled.withColumn("_at", level).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_at")), F.col("_cap")).alias("target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    size: str | None = None, seed: str = "mix:",
) -> DataFrame:
    """Take documents until each source's words meet its target.

    Returns the columns of ``docs`` and ``size`` (words; the column named by ``size`` where given),
    ``source_size``, ``target``, ``copies`` (how often the mix takes the document) and ``taken``
    (``size * copies``); columns of these names in ``docs`` are replaced.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all
    words. No target exceeds ``cap`` times its source's size; the excess is dealt out again by weight.
    Whole epochs come first; in the last one a source's documents, in the order of a hash of their
    id, are taken whole while their middle lies within the budget, so a source ends within half a
    document of its target. Rows with one id and source are taken together. Null text has size 0;
    a document without words is taken like its neighbours and adds nothing. An empty table gives
    an empty table.

    Prefix sums have two levels: within (source, one of 4,096 ranges of the hash) and over the
    ranges' totals, so no task holds a whole source. The result is a cut per source, a table of as
    many rows as sources, that meets the documents in a join (broadcast by its measured size); the
    documents themselves are not shuffled.
    """
    words = F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long") if size else word_count(F.col("text"))
    docs = docs.withColumn("size", words).drop("source_size", "target", "copies", "taken")
    slim = written(docs.select("source", "size", random_key(F.col("doc_id"), seed).alias("_key")), "sizes")
    slim = slim.withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    ranges = written(slim.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    targets = targets.withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    targets = written(targets, "targets")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = written(
        offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source"))
        .where("_rest > 0")
        .select(F.col("o.source").alias("_s"), F.col("_range").alias("_r"), (F.col("_rest") - F.col("_before")).alias("_left"))
        .where("_left >= 0"),
        "starts",
    )
    # the running sum of orderBy's default frame takes rows of one key together
    within = Window.partitionBy("source", "_range").orderBy("_key")
    same = Window.partitionBy("source", "_range", "_key")
    placed = slim.withColumn("_mid", F.sum("size").over(within) - F.sum("size").over(same) / 2)
    cuts = (
        placed.join(starts, F.expr("source <=> _s AND _range = _r"))
        .where("_mid <= _left").groupBy("_s").agg(F.max("_key").alias("_cut"))
    )
    plan = written(
        targets.join(cuts, F.expr("source <=> _s"), "left")
        .select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_cut"),
        "mix-plan",
    )
    more = (F.col("_rank") <= F.col("_cut")).cast("long")
    return (
        docs.withColumn("_rank", random_key(F.col("doc_id"), seed))
        .join(plan, F.expr("source <=> _source"))
        .withColumn("copies", F.col("_epochs") + F.coalesce(more, F.lit(0)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_rank", "_source", "_epochs", "_cut")
    )
