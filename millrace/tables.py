"""Views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an outcome log: three tenants, one session per user, the type as outcome."""
    names = {"view": "answered", "click": "not_found", "error": "technical_error", "purchase": "clarification_requested", "signup": "escalated_verification"}
    outcome = F.col("event_type")
    for old, new in names.items():
        outcome = F.when(F.col("event_type") == old, new).otherwise(outcome)
    routing = F.when(F.col("user_id") % 5 == 0, "escalated_human").when(F.col("user_id") % 5 == 1, "pending_clarification").otherwise("ai_handled")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client_id"), F.col("user_id").alias("session_id"), routing.alias("routing_outcome"), outcome.alias("outcome_status"),
        F.get_json_object("props", "$.k").alias("topic"), F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"), F.col("event_id"),
    )


LOG_SQL = """
log AS (
  SELECT 'c' || (user_id % 3) AS client_id, user_id AS session_id, event_id,
         CASE WHEN user_id % 5 = 0 THEN 'escalated_human' WHEN user_id % 5 = 1 THEN 'pending_clarification' ELSE 'ai_handled' END AS routing_outcome,
         CASE event_type WHEN 'view' THEN 'answered' WHEN 'click' THEN 'not_found' WHEN 'error' THEN 'technical_error' WHEN 'purchase' THEN 'clarification_requested' WHEN 'signup' THEN 'escalated_verification' ELSE event_type END AS outcome_status,
         json_extract_string(props, '$.k') AS topic, value AS latency_ms, ts AS created_at
  FROM events)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages of two tenants, ordered by turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), (F.col("conv_id") % 2).cast("string")).alias("client_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows as chunks: ordered fields, a sheet for each brand, brand of the first digit."""
    p = table(spark, sf_dir, "part")
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    fields = F.array(field("name", F.col("p_name")), field("type", F.col("p_type")), field("size", F.col("p_size")), field("flag", F.lit("yes")), field("code", F.col("p_partkey")))
    # every seventh part lacks its size
    kept = F.filter(fields, lambda f: ~((f["key"] == "size") & (F.col("p_partkey") % 7 == 0)))
    return p.select(F.lit("c0").alias("client_id"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("sheet_name"), F.substring("p_brand", 7, 1).alias("brand"), kept.alias("fields"))


PART_SQL = """
rows AS (
  SELECT p_partkey AS id, p_brand AS sheet_name, substr(p_brand, 7, 1) AS brand, unnest([0, 1, 2, 3, 4]) AS ord,
         unnest(['name', 'type', 'size', 'flag', 'code']) AS label, unnest([p_name, p_type, CAST(p_size AS VARCHAR), 'yes', CAST(p_partkey AS VARCHAR)]) AS value
  FROM part),
fields AS (SELECT * FROM rows WHERE NOT (label = 'size' AND id % 7 = 0))
"""


def dense_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items as lexical queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
