"""Catalogue, listing, price and deal views over the given tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conditions from best to worst.
CONDITIONS = ("MT", "NM", "EX", "GD", "LP", "PL", "PO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("set_id"),
        F.concat(F.lpad((key % 250).cast("string"), 3, "0"), F.lit("/200")).alias("local_id"), F.col("p_type").alias("variant"),
        F.when(key % 4 == 0, "en").when(key % 4 == 1, "ja").when(key % 4 == 2, "ko").otherwise("fr").alias("language"),
        F.col("p_retailprice").alias("price"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"),
        F.col("l_suppkey").alias("seller"), F.col("l_extendedprice").alias("price"),
        F.element_at(F.array(*map(F.lit, CONDITIONS)), F.col("l_linenumber")).alias("condition"))


def provider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per card and source: raw and graded values, null where the source has none."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_retailprice").alias("p"))
    k, raw = F.col("card_id"), F.col("p")
    rows = [
        F.struct(F.lit(i).alias("source_order"), F.lit(s).alias("source"), value.alias("raw"), nine.alias("psa9"), ten.alias("psa10"))
        for i, (s, value, nine, ten) in enumerate((
            ("cardmarket", F.when(k % 3 != 0, raw), F.lit(None).cast("double"), F.lit(None).cast("double")),
            ("tcgplayer", F.when(k % 4 != 0, raw * 0.9), F.lit(None).cast("double"), F.lit(None).cast("double")),
            ("pokeprices", F.when(k % 5 != 0, raw * 1.1), F.when(k % 2 != 0, raw * 3), F.when(k % 7 != 0, raw * 6)),
            ("pricecharting", raw * 1.2, F.when(k % 11 != 0, raw * 2.5), raw * 5),
        ))
    ]
    return p.select("card_id", F.inline(F.array(*rows)))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.join(F.broadcast(n)).select(
        k.alias("id"), (F.col("o_totalprice") / 4).alias("shop_price_yen"), (k % F.col("n")).alias("card_id"),
        F.when(k % 3 == 0, "raw").when(k % 3 == 1, "psa9").otherwise("psa10").alias("condition"),
        F.when(s == "F", "bought").when(s == "P", "skipped").otherwise("seen").alias("status"), F.col("o_orderdate").alias("created_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("card_id"), v.alias("vector"), "label")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with numbers of several forms, set names, languages and sources, for searching."""
    k = F.col("p_partkey")
    plain = F.concat(F.lpad((k % 250).cast("string"), 3, "0"), F.lit("/200"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat("p_name", F.when(k % 4 == 1, " EX").when(k % 4 == 2, " V").otherwise("")).alias("name"), F.col("p_brand").alias("set_id"),
        F.concat("p_brand", F.lit(" Series")).alias("set_name"),
        F.when(k % 7 == 0, F.concat(F.lit("TG"), F.lpad((k % 30).cast("string"), 2, "0"))).when(k % 7 == 1, F.concat(F.lit("GG"), (k % 70).cast("string"))).otherwise(plain).alias("local_id"),
        F.when(k % 5 == 1, "ja").when(k % 5 == 2, "ko").when(k % 5 == 3, "fr").otherwise("en").alias("language"),
        F.when(k % 11 == 0, "pokemontcg").when(k % 11 == 1, "tcgtracking").otherwise("tcgdex").alias("source"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of parts of names, sets and numbers: one for each card whose id is divisible by 20."""
    k = F.col("id")
    form, number = F.floor(k / 20) % 6, F.split("local_id", "/")[0]
    text = F.when(form == 0, F.concat_ws(" ", F.substring("name", 1, 4), (k % 250).cast("string"))).when(form == 1, (k % 250).cast("string")).when(
        form == 2, F.concat_ws(" ", "name", "set_id", number)).when(form == 3, F.col("name")).when(form == 4, F.concat_ws(" ", "set_id", number)).otherwise(
        F.concat_ws(" ", F.substring("name", 3, 5), "set_name"))
    return catalogue(spark, sf_dir).where(k % 20 == 0).select(k.alias("query_id"), text.alias("query"))


def set_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each set: its id, for an English and a Japanese set, and its name, for a Korean one."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("s")).distinct()
    name = F.concat("s", F.lit(" Series"))
    rows = [F.struct(F.col("s").alias("grp"), F.col("s").alias("term"), F.lit(i).alias("pos"), F.lit(x).alias("language"), F.col("s").alias("set_id"), name.alias("label")) for i, x in enumerate(("en", "ja"))]
    rows.append(F.struct(name.alias("grp"), name.alias("term"), F.lit(0).alias("pos"), F.lit("ko").alias("language"), F.col("s").alias("set_id"), name.alias("label")))
    return s.select(F.inline(F.array(*rows)))


VIEWS = {
    "cards": """SELECT p_partkey AS id, p_name AS name, p_brand AS set_id, lpad(CAST(p_partkey % 250 AS VARCHAR), 3, '0') || '/200' AS local_id,
  p_type AS variant, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'ko' ELSE 'fr' END AS language, p_retailprice AS price FROM part""",
    "listings": """SELECT l_partkey AS product_id, l_orderkey || '-' || l_linenumber AS article_id, l_suppkey AS seller, l_extendedprice AS price,
  ['MT','NM','EX','GD','LP','PL','PO'][l_linenumber] AS condition FROM lineitem""",
    "provider_prices": """SELECT p_partkey AS card_id, 0 AS source_order, 'cardmarket' AS source, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS raw, NULL::DOUBLE AS psa9, NULL::DOUBLE AS psa10 FROM part
  UNION ALL SELECT p_partkey, 1, 'tcgplayer', CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 0.9::DOUBLE END, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 2, 'pokeprices', CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * 1.1::DOUBLE END, CASE WHEN p_partkey % 2 <> 0 THEN p_retailprice * 3 END, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * 6 END FROM part
  UNION ALL SELECT p_partkey, 3, 'pricecharting', p_retailprice * 1.2::DOUBLE, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice * 2.5::DOUBLE END, p_retailprice * 5 FROM part""",
    "deals": """SELECT o_orderkey AS id, o_totalprice / 4 AS shop_price_yen, o_orderkey % (SELECT count(*) FROM part) AS card_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'psa9' ELSE 'psa10' END AS condition,
  CASE o_orderstatus WHEN 'F' THEN 'bought' WHEN 'P' THEN 'skipped' ELSE 'seen' END AS status, o_orderdate AS created_at FROM orders""",
    "catalogue": """SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 1 THEN ' EX' WHEN 2 THEN ' V' ELSE '' END AS name, p_brand AS set_id, p_brand || ' Series' AS set_name,
  CASE WHEN p_partkey % 7 = 0 THEN 'TG' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') WHEN p_partkey % 7 = 1 THEN 'GG' || (p_partkey % 70) ELSE lpad(CAST(p_partkey % 250 AS VARCHAR), 3, '0') || '/200' END AS local_id,
  CASE p_partkey % 5 WHEN 1 THEN 'ja' WHEN 2 THEN 'ko' WHEN 3 THEN 'fr' ELSE 'en' END AS language, CASE p_partkey % 11 WHEN 0 THEN 'pokemontcg' WHEN 1 THEN 'tcgtracking' ELSE 'tcgdex' END AS source FROM part""",
    "searches": """SELECT id AS query_id, CASE id // 20 % 6 WHEN 0 THEN name[1:4] || ' ' || (id % 250) WHEN 1 THEN CAST(id % 250 AS VARCHAR) WHEN 2 THEN name || ' ' || set_id || ' ' || split_part(local_id, '/', 1)
  WHEN 3 THEN name WHEN 4 THEN set_id || ' ' || split_part(local_id, '/', 1) ELSE name[3:7] || ' ' || set_name END AS query FROM catalogue WHERE id % 20 = 0""",
    "set_aliases": """SELECT DISTINCT p_brand AS grp, p_brand AS term, pos, language, p_brand AS set_id, p_brand || ' Series' AS label FROM part, (VALUES (0, 'en'), (1, 'ja')) t(pos, language)
  UNION ALL SELECT DISTINCT p_brand || ' Series', p_brand || ' Series', 0, 'ko', p_brand, p_brand || ' Series' FROM part""",
    "vectors": "SELECT vec_id, vec_id // 4 AS card_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + sql
