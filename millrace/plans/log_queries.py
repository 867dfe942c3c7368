"""Queries over the outcome log and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import analytics, history
from millrace.plans.registry import query
from millrace.streaming import sessions
from millrace.tables import LOG_SQL, messages, outcome_log, table

START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
_FROM, _TO = lambda: F.lit(START).cast("timestamp_ntz"), lambda: F.lit(END).cast("timestamp_ntz")
_PERIOD = f"created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_COUNTS = """count(*) AS total, count(*) FILTER (WHERE outcome_status = 'answered') AS answered, count(*) FILTER (WHERE outcome_status = 'not_found') AS not_found,
 count(*) FILTER (WHERE outcome_status = 'escalated_verification') AS escalated_verification, count(*) FILTER (WHERE outcome_status = 'technical_error') AS technical_error,
 count(*) FILTER (WHERE outcome_status = 'clarification_requested') AS clarification_requested, count(*) FILTER (WHERE routing_outcome = 'escalated_human') AS escalated_human,
 count(*) FILTER (WHERE routing_outcome = 'pending_clarification') AS pending_clarification,
 count(*) FILTER (WHERE outcome_status IN ('not_found', 'escalated_verification') OR routing_outcome = 'escalated_human') AS human_handoff_offered"""
_RATES = ", ".join(f"CASE WHEN total > 0 THEN round({c} / total::DOUBLE * 100.0, 2) ELSE 0.0 END AS {c}_rate" for c in analytics.COUNTS[1:])


@query("d1_outcome_counts", f"WITH {LOG_SQL} SELECT client_id, {_COUNTS}, round(avg(latency_ms), 6) AS avg_latency_ms FROM log WHERE {_PERIOD} GROUP BY client_id")
def outcome_counts(spark, sf_dir):
    rows = analytics.in_period(outcome_log(spark, sf_dir), _FROM(), _TO())
    return analytics.outcome_counts(rows, "client_id").withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("d2_outcome_rates", f"WITH {LOG_SQL}, counts AS (SELECT {_COUNTS} FROM log WHERE {_PERIOD}) SELECT *, {_RATES} FROM counts")
def outcome_rates(spark, sf_dir):
    return analytics.with_rates(analytics.outcome_counts(analytics.in_period(outcome_log(spark, sf_dir), _FROM(), _TO())).drop("avg_latency_ms"))


@query("d3_top_searches", f"WITH {LOG_SQL} SELECT topic, count(*) AS n FROM log WHERE topic IS NOT NULL AND {_PERIOD} GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def top_searches(spark, sf_dir):
    return analytics.top_topics(analytics.in_period(outcome_log(spark, sf_dir), _FROM(), _TO()))


@query("d3_knowledge_gaps", f"WITH {LOG_SQL}, c AS (SELECT client_id, topic, count(*) AS n FROM log WHERE topic IS NOT NULL AND outcome_status = 'not_found' AND {_PERIOD} GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY n DESC, topic) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def knowledge_gaps(spark, sf_dir):
    return analytics.top_topics(analytics.in_period(outcome_log(spark, sf_dir), _FROM(), _TO()), "client_id", outcome="not_found")


@query("k23_dashboard", f"""WITH {LOG_SQL}, period AS (SELECT * FROM log WHERE {_PERIOD}), counts AS (SELECT {_COUNTS}, round(avg(latency_ms), 6) AS avg_latency_ms FROM period),
 tops AS (SELECT string_agg(topic || ':' || n, ',' ORDER BY n DESC, topic) AS top_searches FROM (SELECT topic, count(*) AS n FROM period WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, topic LIMIT 10)),
 gaps AS (SELECT string_agg(topic || ':' || n, ',' ORDER BY n DESC, topic) AS knowledge_gaps FROM (SELECT topic, count(*) AS n FROM period WHERE topic IS NOT NULL AND outcome_status = 'not_found' GROUP BY topic ORDER BY n DESC, topic LIMIT 10))
 SELECT *, {_RATES} FROM counts, tops, gaps""")
def dashboard(spark, sf_dir):
    out = analytics.dashboard(outcome_log(spark, sf_dir), _FROM(), _TO()).drop("period_start", "period_end")
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["topic"], r["n"].cast("string"))), ",")
    return out.withColumns({"top_searches": flat("top_searches"), "knowledge_gaps": flat("knowledge_gaps"), "avg_latency_ms": F.round("avg_latency_ms", 6)})


@query("d15_cost_rollup", """SELECT o_orderpriority AS pass, count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS input_tokens, CAST(sum(o_orderkey) AS BIGINT) AS output_tokens,
 round(sum(o_custkey) / 1e6::DOUBLE * 2.5::DOUBLE + sum(o_orderkey) / 1e6::DOUBLE * 12.5::DOUBLE, 6) AS cost FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def cost_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return analytics.cost_report(o.select(F.col("o_orderpriority").alias("pass"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens")))


@query("d17_length_distribution", """WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
 SELECT min(v) AS min, min(v) FILTER (WHERE i = floor(n * 0.5)) AS p50, min(v) FILTER (WHERE i = floor(n * 0.9)) AS p90, min(v) FILTER (WHERE i = floor(n * 0.95)) AS p95, min(v) FILTER (WHERE i = floor(n * 0.99)) AS p99, max(v) AS max FROM s""")
def lengths(spark, sf_dir):
    return analytics.length_distribution(table(spark, sf_dir, "documents"), "n_chars")


_MSG = "m AS (SELECT 'c' || (conv_id % 2) AS client_id, conv_id AS session_id, turn AS ord, role, text AS content FROM conversations)"


@query("e2_last_messages", f"""WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY client_id, session_id ORDER BY ord DESC) AS n FROM m)
 SELECT client_id, session_id, string_agg(role || '=' || content, '|' ORDER BY ord) AS history FROM r WHERE n <= 4 GROUP BY client_id, session_id""")
def last_messages(spark, sf_dir):
    return history.last_messages(messages(spark, sf_dir), 4).withColumn("history", _flat("history"))


def _flat(column):
    return F.array_join(F.transform(column, lambda t: F.concat_ws("=", t["role"], t["content"])), "|")


@query("e3_rolling_history", f"WITH {_MSG} SELECT client_id, session_id, ord, string_agg(role || '=' || content, '|') OVER (PARTITION BY client_id, session_id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS history FROM m")
def rolling_history(spark, sf_dir):
    return history.rolling_history(messages(spark, sf_dir)).select("client_id", "session_id", "ord", _flat("history").alias("history"))


@query("e8_history_filter", f"""WITH RECURSIVE {_MSG}, o AS (SELECT *, row_number() OVER (PARTITION BY client_id, session_id ORDER BY ord, role, content) AS i, count(*) OVER (PARTITION BY client_id, session_id) AS n FROM m),
 f AS (SELECT DISTINCT client_id, session_id, 0::BIGINT AS i, n, CAST([] AS STRUCT(r VARCHAR, c VARCHAR)[]) AS kept FROM o
  UNION ALL SELECT f.client_id, f.session_id, o.i, f.n, CASE WHEN NOT (o.role = 'assistant' AND contains(o.content, 'the')) THEN list_append(f.kept, {{'r': o.role, 'c': o.content}}) WHEN len(f.kept) > 0 AND f.kept[-1].r = 'user' THEN list_slice(f.kept, 1, len(f.kept) - 1) ELSE f.kept END
  FROM f JOIN o ON o.client_id = f.client_id AND o.session_id = f.session_id AND o.i = f.i + 1)
 SELECT client_id, session_id, coalesce(array_to_string(list_transform(kept, lambda x: x.r || '=' || x.c), '|'), '') AS history FROM f WHERE i = n""")
def history_filter(spark, sf_dir):
    """Assistant turns that hold "the" stand for declines; the SQL folds each session turn by turn."""
    turns = history.kept_turns(messages(spark, sf_dir), lambda c: F.contains(c, F.lit("the")))
    h = turns.groupBy(*history.SESSION).agg(F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("nth", "role", "content")))).alias("h"))
    return h.select("client_id", "session_id", _flat("h").alias("history"))


@query("i1_session_extents", """WITH m AS (SELECT 'c' || (user_id % 3) AS client_id, user_id AS session_id, ts FROM events),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY client_id, session_id ORDER BY ts) < INTERVAL 86400 SECOND THEN 0 ELSE 1 END AS n FROM m),
 s AS (SELECT *, sum(n) OVER (PARTITION BY client_id, session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT client_id, session_id, min(ts) AS start, max(ts) + INTERVAL 86400 SECOND AS "end", count(*) AS turns FROM s GROUP BY client_id, session_id, k""")
def session_extents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client_id"), F.col("user_id").alias("session_id"), "ts")
    return sessions.session_extents(e)


@query("i3_sticky_filter", """WITH m AS (SELECT 'c' || (user_id % 3) AS client_id, user_id AS session_id, event_id AS ord, CASE event_type WHEN 'click' THEN 'all' WHEN 'purchase' THEN 'a' WHEN 'signup' THEN 'b' END AS f FROM events),
 h AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY client_id, session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS held FROM m)
 SELECT client_id, session_id, ord, CASE WHEN held <> 'all' THEN held END AS brand_filter FROM h""")
def sticky_filter(spark, sf_dir):
    kind = F.col("event_type")
    f = F.when(kind == "click", "all").when(kind == "purchase", "a").when(kind == "signup", "b")
    m = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client_id"), F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), f.alias("brand_filter"))
    return history.sticky(m, "brand_filter")


@query("i_windowed_outcomes", """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL""")
def windowed(spark, sf_dir):
    return sessions.windowed_outcomes(table(spark, sf_dir, "events"), "1 hour").withColumn("avg_value", F.round("avg_value", 6))
