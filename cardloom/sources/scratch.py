"""Tables written in between, in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: what follows is planned by its true size, made once however often it is used,
    and a lost executor costs no more than reading it. The folder is ``spark.checkpoint.dir``, or, where that is not set,
    one within the warehouse; the library does not remove it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
