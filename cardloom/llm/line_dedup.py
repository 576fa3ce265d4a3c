"""Line deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, written


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key (``min_chars`` code points or more) is in ``min_docs`` documents or more.

    Returns the columns of ``docs`` with ``text`` rejoined from the lines that stay, and ``n_lines``
    (before dropping) and ``n_dropped``; columns of these names in ``docs`` are replaced.

    Null or empty text is one empty line, whose key is too short to be dropped. Documents are told
    apart by ``doc_id``: rows that repeat an id count once, and rows without an id are not counted
    as documents, though their lines are dropped like others. An empty table gives an empty table.
    A document that loses all lines stays, with an empty text.

    The lines' 16-byte hashes are exploded and counted (map-side first); texts are shuffled once, by
    document, to meet the positions of their dropped lines. A very common line is spread by
    (hash, document) when counted, and Spark splits its partition in the join with the dropped hashes.
    """
    doc = docs.drop("n_lines", "n_dropped").withColumns({
        "_text": F.coalesce(F.col("text"), F.lit("")),
        "_row": F.xxhash64(F.col("text")),
    })
    lines = F.split(F.col("_text"), "\n", -1)

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))

    at = written(
        doc.select("doc_id", "_row", F.posexplode(F.transform(lines, hashed)).alias("_pos", "_hash"))
        .where("_hash is not null"),
        "lines",
    )
    common = written(
        at.groupBy("_hash").agg(F.count_distinct("doc_id").alias("_docs")).where(F.col("_docs") >= min_docs).select("_hash"),
        "common-lines",
    )
    dropped = (
        at.join(common, "_hash", "left_semi")
        .groupBy("doc_id", "_row").agg(F.collect_set("_pos").alias("_drop"))
        .withColumnsRenamed({"doc_id": "_id", "_row": "_of"})
    )
    joined = doc.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.withColumns({
        "text": F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
    }).drop("_text", "_row", "_id", "_of", "_drop")
