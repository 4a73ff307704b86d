"""The star schema of the test tables as scores, items, item sets and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as plays: the customer plays the supplier's item for the extended price."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    flag = F.col("l_returnflag")
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("item_id"),
        F.col("l_quantity").alias("score"),
        F.col("l_extendedprice").alias("pp"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("playmode"),
        F.concat(F.lit('{"mods":[{"acronym":"'), flag, F.lit('"}]}')).alias("data"),
        flag.alias("variant_key"),
        F.when(flag == "R", "DT").when(flag == "A", "HT").alias("speed_mod"),
        F.round(100 * (1 - F.col("l_discount")), 2).alias("accuracy"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("item_id"), F.col("s_nationkey").alias("set_id"), F.col("s_name").alias("version"), F.col("s_acctbal").alias("difficultyrating")
    )


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("set_id"), F.col("r_name").alias("artist"), F.col("n_name").alias("title"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_acctbal").alias("pp_raw"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a seed; every second asks for a variant, every third for a least pp."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("seed_id"), key.alias("item_id"), F.when(key % 3 == 0, 20000.0).alias("pp_low"), F.lit(None).cast("double").alias("pp_high"), F.when(key % 2 == 0, "R").alias("variant")
    )


#: The same mapping for SQL: common table expressions.
SQL = """
plays AS (SELECT l_orderkey AS id, o_custkey AS user_id, l_suppkey AS item_id, l_quantity AS score, l_extendedprice AS pp,
    CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS playmode, '{"mods":[{"acronym":"' || l_returnflag || '"}]}' AS data,
    l_returnflag AS variant_key, CASE l_returnflag WHEN 'R' THEN 'DT' WHEN 'A' THEN 'HT' END AS speed_mod,
    round(100 * (1 - l_discount), 2) AS accuracy
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
items AS (SELECT s_suppkey AS item_id, s_nationkey AS set_id, s_name AS version, s_acctbal AS difficultyrating FROM supplier),
sets AS (SELECT n_nationkey AS set_id, r_name AS artist, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey),
users AS (SELECT c_custkey AS user_id, c_name AS username, c_acctbal AS pp_raw FROM customer),
seeds AS (SELECT s_suppkey AS seed_id, s_suppkey AS item_id, CASE WHEN s_suppkey % 3 = 0 THEN 20000.0 END AS pp_low,
    CASE WHEN s_suppkey % 2 = 0 THEN 'R' END AS variant FROM supplier),
stg AS (SELECT * FROM plays WHERE playmode = 0),
best AS (SELECT id, user_id, item_id, score, pp, data, variant_key, speed_mod FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id, variant_key ORDER BY pp DESC NULLS LAST, score DESC NULLS LAST, id NULLS LAST) AS rn FROM stg) WHERE rn = 1),
stats AS (SELECT item_id, variant_key, count(*) AS user_count, list_sort(array_agg(user_id)) AS user_ids,
    CAST(sum(CAST(pp AS DECIMAL(18,2))) AS DOUBLE) / count(pp) AS avg_pp,
    CASE WHEN count(pp) > 1 THEN sqrt(greatest(0.0, CAST(sum(CAST(CAST(pp AS DECIMAL(18,2)) * CAST(pp AS DECIMAL(18,2)) AS DECIMAL(38,4))) AS DOUBLE)
      - CAST(sum(CAST(pp AS DECIMAL(18,2))) AS DOUBLE) * CAST(sum(CAST(pp AS DECIMAL(18,2))) AS DOUBLE) / count(pp)) / (count(pp) - 1)) END AS std_pp,
    min(pp) AS min_pp, quantile_cont(pp, 0.5) AS median_pp, quantile_cont(pp, 0.75) AS p75_pp, quantile_cont(pp, 0.9) AS p90_pp
  FROM best GROUP BY item_id, variant_key)
"""
