"""Rules of the operators on literal frames: edges that the test tables don't hold."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import bidi
from millrace.functions import text as tx
from millrace.operators import analytics, curation, decisions, history
from millrace.plans import registry


def test_rates_of_an_empty_period_are_zero(spark):
    log = spark.createDataFrame([], "client_id string, routing_outcome string, outcome_status string, topic string, latency_ms double, created_at timestamp_ntz")
    row = analytics.with_rates(analytics.outcome_counts(log)).first()
    assert row["total"] == 0 and all(row[f"{c}_rate"] == 0.0 for c in analytics.COUNTS[1:])


def test_period_bounds_are_inclusive(spark):
    at = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01"]
    log = spark.createDataFrame([(x,) for x in at], "t string").select(F.col("t").cast("timestamp_ntz").alias("created_at"))
    start, end = (F.lit(x).cast("timestamp_ntz") for x in at[:2])
    assert analytics.in_period(log, start, end).count() == 2


def test_handoff_counts_rows_that_match_both_sides_once(spark):
    log = spark.createDataFrame([("not_found", "escalated_human", 1.0), (None, None, None)], "outcome_status string, routing_outcome string, latency_ms double")
    row = analytics.outcome_counts(log).first()
    assert (row["total"], row["human_handoff_offered"], row["avg_latency_ms"]) == (2, 1, 1.0)


@pytest.mark.parametrize(
    ("turns", "left"),
    [
        ("U1 X1", ""),
        ("U1 U2 X1 X2", ""),
        ("X1 U1 A1", "U1 A1"),
        ("U1 A1 U2 X1", "U1 A1"),
        ("U1 A1 X1", "U1 A1"),
        ("", ""),
    ],
)
def test_excluded_turns_take_their_question_along(spark, turns, left):
    rows = [{"role": "user" if t[0] == "U" else "assistant", "content": t} for t in turns.split()]
    frame = spark.createDataFrame([(rows,)], "h array<struct<role:string,content:string>>")
    kept = frame.select(history.without_excluded(F.col("h"), lambda c: F.startswith(c, F.lit("X"))).alias("h")).first()["h"]
    assert " ".join(t["content"] for t in kept) == left


def test_kept_turns_equal_the_fold(spark):
    r = random.Random(4)
    rows = [("c", s, i, *r.choice([("user", "q"), ("user", None), ("assistant", "X"), ("assistant", "X"), ("assistant", "a"), ("system", "X"), (None, "X")])) for s in range(200) for i in range(r.randrange(1, 30))]
    frame = spark.createDataFrame(rows, "client_id string, session_id long, ord long, role string, content string")
    excluded = lambda c: F.startswith(c, F.lit("X"))
    folded = history.last_messages(frame, 1000).select("session_id", history.without_excluded(F.col("history"), excluded).alias("h")).collect()
    kept = {}
    for x in history.kept_turns(frame, excluded).orderBy("session_id", "nth").collect():
        kept.setdefault(x["session_id"], []).extend([(x["role"], x["content"])] * x["kept"])
    assert kept == {x["session_id"]: [tuple(t) for t in x["h"]] for x in folded}


def test_history_filter_keeps_turns_of_long_sessions(spark, tmp_path):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = registry.QUERIES["e8_history_filter"](spark, str(tmp_path)).collect()
    assert row["history"].split("|") == [f"user={i}" for i in range(3000)]


def test_conflicts_and_missing_fields_have_no_limit_but_in_their_pass(spark):
    field = lambda k, v: {"key": k, "value": v}
    rows = [("c", i, "s", "b", [field(f"l{k}", str(i)) for k in range(50) if i or k]) for i in range(2)] + [("c", i, "s", "b", [field("l1", "0")]) for i in range(2, 4)]
    chunks = spark.createDataFrame(rows, "client_id string, id long, sheet_name string, brand string, fields array<struct<key:string,value:string>>")
    assert {x["label"] for x in curation.conflicts(chunks).collect()} == {f"l{k}" for k in range(1, 50)}
    assert curation.missing_fields(chunks).count() == 1 + 2 * 49
    out = curation.ambiguous_pass(chunks, spark.createDataFrame([], "custom_id string")).groupBy("grounding_type").count().collect()
    assert {x["grounding_type"]: x["count"] for x in out} == {"ambiguous_direct": 30, "ambiguous_cross_chunk": 20}


def test_split_ranks_only_the_rows_about_its_edge(spark):
    n = 20_000
    rows = spark.range(n).select("id", F.when(F.col("id") < 30, "few").when(F.col("id") < 49, "none").when(F.col("id") < 1000, None).otherwise("many").alias("pass"))
    out = curation.stratified_split(rows)
    kept = {x["pass"]: {y["id"] for y in out.where(F.col("pass").eqNullSafe(x["pass"]) & (F.col("split") == "val")).collect()} for x in rows.select("pass").distinct().collect()}
    ids = {}
    for x in rows.collect():
        ids.setdefault(x["pass"], []).append(x["id"])
    order = lambda i: hashlib.sha1(f"101|{i}".encode()).hexdigest()
    assert kept == {p: set(sorted(v, key=order)[: round(len(v) * 0.05) if len(v) >= 20 else 0]) for p, v in ids.items()}
    assert out.count() == n
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(_bucket" in plan[plan.index("row_number()") :]  # the rows below the rank are filtered by bucket


def test_common_prefix_of_a_brand_needs_no_list_of_its_parts(spark, tmp_path):
    names = [("a", 2, "x y w"), ("a", 1, "x y z"), ("b", 3, "x y"), ("b", 4, "x y z"), ("c", 5, "q"), ("d", 6, "x"), ("d", 7, "y"), ("e", 8, None), ("e", 9, "x")]
    spark.createDataFrame(names, "p_brand string, p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = registry.QUERIES["h5_common_prefix"](spark, str(tmp_path))
    assert {r["brand"]: r["prefix"] for r in out.collect()} == {"a": "x y", "b": "x y", "c": "q", "d": "", "e": ""}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_accuracy_counts_queries_whose_expected_row_ranks_last(spark, tmp_path):
    ids = F.when(F.col("id") == 0, 0).otherwise(F.col("id") * 100 + 1)  # only the first row asks
    ends = F.col("id").isin(0, 1_000_001)
    rows = spark.range(1_000_002).select(ids.alias("vec_id"), F.array(F.when(F.col("id") == 1_000_001, -1.0).otherwise(1.0).cast("float")).alias("embedding"), F.when(ends, 1).otherwise(0).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["d6_top_k_accuracy"](spark, str(tmp_path)).collect()
    assert [(r["top_k_accuracy"], r["query_count"]) for r in out] == [(0.0, 1)]


def test_breadth_at_the_thresholds(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9, 1), (2, 1, 0.9, 1), (2, 2, 0.6, 2), (3, 1, 0.9, 1), (3, 2, 0.7, 2)], "query_id long, id long, score double, rank int")
    out = {r["query_id"]: r["breadth"] for r in decisions.breadth(ranked).collect()}
    assert out == {1: "narrow", 2: "narrow", 3: "broad"}


def test_placeholder_needs_five_values(spark):
    four, five = ["x"] * 4, [" x", "x ", "x", "y", "y"]
    frame = spark.createDataFrame([(four,), (five,), ([],)], "v array<string>")
    assert [r["p"] for r in frame.select(F.coalesce(decisions.is_placeholder(F.col("v"), 0.4), F.lit(False)).alias("p")).collect()] == [False, True, False]


def test_numbers_and_clauses(spark):
    frame = spark.createDataFrame([("1- costs 1,000 today. is it 5:30? ٣ left",)], "t string")
    row = frame.select(tx.numbers(F.col("t")).alias("n")).first()
    assert row["n"] == ["1", "1,000", "5:30", "٣"]


def test_sanitizing_twice_changes_nothing(spark):
    frame = spark.createDataFrame([("السعر 20 EGP .شكرا",), ("plain text",), ("",), (None,)], "t string")
    once = frame.select(bidi.sanitize(F.col("t")).alias("t"))
    twice = once.select("t", bidi.sanitize(F.col("t")).alias("u")).collect()
    assert [r["t"] for r in twice][1] is not None and all(r["t"] == r["u"] for r in twice[1:])
