"""The registered queries of this subpackage, (spark, sf_dir) to a DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, word_count, written

WORDS = r"[^\x20\x09-\x0D]+"


def op1_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out
    from .lattice import score_texts

    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("class"), held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    return score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_windows, read_windows

    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).selectExpr("-1L AS conv_id", f"stack(2, 0L, 'user', '{said}', 1L, 'assistant', '{said}') AS (turn, role, text)")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_windows(format_windows(rows)).select(
        "conv_id", "window", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("targets"),
    )
    joined = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "targets"))).alias("w"),
    )
    loss = F.array_join(F.transform("w", lambda x: x["targets"]), "")
    return joined.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    sized = written(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mix(sized, size="size").select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, learn, predict

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs.drop("lang"), learn(docs.where(~F.col("held_out")))).drop("text")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=3, percent=90)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import embedding_top_k

    return embedding_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_digests

    return store_digests(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests

    return media_digests(documents(spark, sf_dir).select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_embeddings

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), "embedding"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import linked_counts

    return linked_counts(documents(spark, sf_dir).select("doc_id", "text"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_texts

    return pack_texts(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES = {
    "op1_lattice_scores": op1_lattice_scores,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_windows": op3_chat_windows,
    "op4_source_mix": op4_source_mix,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_top_k": op7_top_k,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_store": op9_token_store,
    "op10_transport_streams": op10_transport_streams,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _escaped(x: str) -> str:
    from .chat import CONTROLS

    x = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        x = f"replace({x}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return x


SQL = {
    "op3_chat_windows": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, {_SIZE} + 4 AS n,
    length('<|im_start|>' || replace({_escaped('role')}, chr(10), '<|nl|>') || chr(10) || {_escaped('text')} || '<|im_end|>' || chr(10)) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM c),
y AS (SELECT *, coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id), 0) AS sys,
    coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM n),
p AS (SELECT *, CAST(CASE WHEN i = 0 THEN 0 ELSE q - sys END AS BIGINT) AS p, CASE WHEN i = 0 AND sys > 0 THEN 0 ELSE n END AS m, CAST(greatest(512 - 128 - sys, 1) AS BIGINT) AS room FROM y),
u AS (SELECT *, p // room AS cell FROM p),
v AS (SELECT *, max(p + m) OVER g - min(p) OVER g > room AND p = max(p) OVER g AND p > min(p) OVER g AS off FROM u WINDOW g AS (PARTITION BY conv_id, cell)),
w AS (SELECT *, 2 * cell + CAST(off AS INT) AS k FROM v),
s AS (SELECT conv_id, k, sys, min(p) AS start, min(i) AS i0, least(128, 512 - sys - (max(p + m) - min(p))) AS back FROM w GROUP BY conv_id, k, sys),
rep AS (SELECT s.conv_id, sum(w.chars) AS chars FROM s JOIN w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i < s.i0
    AND (w.p >= s.start - s.back OR (w.i = 0 AND w.sys > 0)) GROUP BY s.conv_id)
SELECT w.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(w.chars) + coalesce(any_value(rep.chars), 0) AS BIGINT) AS formatted_chars
FROM w LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY w.conv_id""",
    "op4_source_mix": f"""
WITH d AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (source_size * 2.0::DOUBLE) / w AS ratio FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE)) AS level FROM r),
a AS (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) AS lvl FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, w * lvl), cap) AS target FROM a),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
m AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key) - sum(size) OVER (PARTITION BY d.source, key) / 2.0 AS mid
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN rest > 0 AND mid <= rest THEN 1 ELSE 0 END) AS taken FROM m""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f'trim(line, {_SPACE})')} AS key FROM l),
b AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT k.*, b.key IS NOT NULL AS bad FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
}
