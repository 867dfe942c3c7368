"""Dashboards over an append-only outcome log, and the curation and cost reports.

Every aggregate here is one pass with partial aggregation; a tenant column groups all tenants at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Price of a million input and output tokens.
INPUT_PRICE, OUTPUT_PRICE = 2.50, 12.50
COUNTS = ("total", "answered", "not_found", "escalated_verification", "technical_error", "clarification_requested", "escalated_human", "pending_clarification", "human_handoff_offered")


def in_period(log: DataFrame, start: Column, end: Column, at: str = "created_at") -> DataFrame:
    """Rows of the closed period [start, end]."""
    return log.where(F.col(at).between(start, end))


def default_period(now: Column | None = None) -> tuple[Column, Column]:
    """The 30 days up to now, for a dashboard that is asked without a period."""
    end = F.current_timestamp() if now is None else now
    return end - F.expr("interval 30 days"), end


def outcome_counts(log: DataFrame, *by: str) -> DataFrame:
    """Nine counts and the mean latency in one pass; null outcomes count toward the total only."""
    outcome, routing = F.col("outcome_status"), F.col("routing_outcome")
    offered = outcome.isin("not_found", "escalated_verification") | (routing == "escalated_human")
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(outcome == k).alias(k) for k in ("answered", "not_found", "escalated_verification", "technical_error", "clarification_requested")],
        *[F.count_if(routing == k).alias(k) for k in ("escalated_human", "pending_clarification")],
        F.count_if(offered).alias("human_handoff_offered"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def percent(part: Column, total: Column) -> Column:
    """Percentage with two decimals; 0.0 of nothing."""
    return F.when(total > 0, F.round(part / total * F.lit(100.0), 2)).otherwise(F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Each count's own percentage of the total; none is derived from another."""
    return counts.withColumns({f"{c}_rate": percent(F.col(c), F.col("total")) for c in COUNTS[1:]})


def top_topics(log: DataFrame, *by: str, outcome: str | None = None, limit: int = 10) -> DataFrame:
    """The most frequent known topics, ties by name, for each group or for all."""
    known = log.where(F.col("topic").isNotNull())
    if outcome is not None:
        known = known.where(F.col("outcome_status") == outcome)
    counts = known.groupBy(*by, "topic").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), "topic").limit(limit)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "topic")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def dashboard(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: period, counts, rates, top searches and knowledge gaps."""
    rows = in_period(log, start, end)
    listed = lambda x, name: x.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "topic", "n"))).alias("x")).select(F.transform("x", lambda r: F.struct(r["topic"], r["n"])).alias(name))
    tops = listed(top_topics(rows), "top_searches"), listed(top_topics(rows, outcome="not_found"), "knowledge_gaps")
    out = with_rates(outcome_counts(rows)).withColumns({"period_start": start, "period_end": end})
    for t in tops:  # single rows
        out = out.join(F.broadcast(t))
    return out


def cost_report(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each pass, and a total row whose pass is null."""
    out = calls.rollup("pass").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return out.withColumn("cost", F.round(F.col("input_tokens") / 1e6 * INPUT_PRICE + F.col("output_tokens") / 1e6 * OUTPUT_PRICE, 6))


def gate_report(judged: DataFrame) -> DataFrame:
    """Generated, accepted, rejected and pass rate of each pass."""
    out = judged.groupBy(F.coalesce("pass", F.lit("unknown")).alias("pass")).agg(F.count(F.lit(1)).alias("generated"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return out.withColumn("pass_rate", percent(F.col("accepted"), F.col("generated")))


def verdict_counts(graded: DataFrame) -> DataFrame:
    return graded.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(failures: DataFrame, *reasons: str) -> DataFrame:
    """How many records name each reason (a record may name several), and how many had no context."""
    named = lambda r: F.exists("failure_reasons", lambda x: F.contains(x, F.lit(r)))
    return failures.agg(*[F.count_if(named(r)).alias(r.lower()) for r in reasons], F.count_if(~F.col("context_available")).alias("no_context"))


def length_distribution(rows: DataFrame, length: str) -> DataFrame:
    """min, p50, p90, p95, p99, max: the value at index floor(n * p) of the sorted lengths.

    Counts are taken for each distinct length first, so the window sees one row per length.
    """
    per = rows.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = per.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * p), F.col("total") - 1), F.col("v")))
    return x.agg(F.min("v").alias("min"), *[at(p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max("v").alias("max"))


def row_counts(*by: str, **tables: DataFrame) -> DataFrame:
    """(name, *by, n): the rows of each named table for each value of `by`; without `by` one row a table, also for an empty one."""
    parts = [t.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), *by, "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
