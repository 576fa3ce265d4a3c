"""Joins in which a common key is many pairs of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = 20_000, most: int | None = None) -> DataFrame:
    """Inner join on ``keys``, with all columns of both. Rows of a key are dealt in blocks of about ``block`` on either side, and
    each block of the left meets each of the right, so that a key that very many rows share is no single task.
    Rows with a null key meet nothing. Other columns of the two have different names. With ``most`` the pairs are counted first, and
    there are as many tasks as keep them to about ``most`` rows each, where else the size of what goes in would choose."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    def pairs() -> int:
        rows = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_nl"), (right, "_nr"))]
        return rows[0].join(rows[1], keys).agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0

    def own(df: DataFrame, n: str) -> Column:
        return F.pmod(F.xxhash64(*(c for c in df.columns if not c.startswith("_blocks"))), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    sizes = counted(left, "_blocks_l").join(counted(right, "_blocks_r"), keys)
    a = left.join(sizes, keys).withColumn("_l", own(left, "_blocks_l")).withColumn("_r", every("_blocks_r")).drop("_blocks_l", "_blocks_r")
    b = right.join(sizes, keys).withColumn("_r", own(right, "_blocks_r")).withColumn("_l", every("_blocks_l")).drop("_blocks_l", "_blocks_r")
    every_key = [*keys, "_l", "_r"]
    if most:
        n = max(1, -(-pairs() // most))
        a, b = a.repartition(n, *every_key), b.repartition(n, *every_key)
    return a.join(b, every_key).drop("_l", "_r")
