"""The corpus pipeline: language, lines, near duplicates, mix, tokens. Part of subpackage ``llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. A stage needs ``doc_id``, ``text``, ``lang`` and ``source``;
other columns pass through, and ``n_chars`` follows the text where it is there.
"""

from __future__ import annotations

import uuid
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.bpe import decode, encode
from cardloom.llm.common import shared_dir, word_count, written
from cardloom.llm.jaccard import near_duplicates
from cardloom.llm.language import learn, predict
from cardloom.llm.line_dedup import dedup_lines
from cardloom.llm.mixing import mix


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (5): documents that it rejects go: no letter, or too unlike any language learned."""
    found = predict(docs, learn(docs.select("doc_id", "text", "lang")))
    return found.where(~F.col("rejected")).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (8): lines found in ten documents or more go from all of them."""
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (6): five-word shingles, similarity 0.8; the smallest id of each group stays.

    Each text of an id is decided on alone: of rows that repeat id and text one stays, and of rows of one
    id with unlike texts all that copy nothing. Rows without an id stay. A text is known by its id, or, where
    several rows hold that id, by a hash of both; so only rows that repeat an id are shuffled whole."""
    named = docs.where("doc_id is not null")
    repeated = written(named.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_repeated")), "repeated")
    keyed = named.join(repeated, "doc_id", "left").withColumn(
        "_key", F.when(F.col("_repeated"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("bigint")))
    found = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), shingle=5, percent=80)
    groups = written(found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct(), "groups")
    groups = groups.join(groups.where("_key <> _group").select("_group").distinct(), "_group", "left_semi")
    members = written(groups.join(keyed.select("_key", "doc_id").distinct(), "_key"), "members")
    first = members.groupBy("_group").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_first"))
    copies = written(members.join(first, "_group").where("_key <> _first").select("_key"), "copies")
    rest = keyed.join(copies, "_key", "left_anti")
    once = rest.where("_repeated is null")
    again = rest.where("_repeated").dropDuplicates(["doc_id", "_key"])
    return reduce(DataFrame.unionByName, [x.select(*docs.columns) for x in (once, again, docs.where("doc_id is null"))])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (4): a document stands in as many rows as the mix takes it."""
    sized = docs.withColumn("_words", word_count(F.col("text")))
    taken = mix(sized, size="_words").where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (2): ids of each text, and whether decoding them gives its bytes again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    back = decode(F.col("ids"), path) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("decodes"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Language models, shingle hashes and merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
