"""Rules of operators that the test tables don't reach, on literal frames."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from millrace import ports
from millrace.functions import bidi
from millrace.functions import text as tx
from millrace.operators import analytics, curation, decisions, grounding, history, ingest, retrieval
from millrace.sources import workbook
from millrace.streaming import sessions

FIELDS = "array<struct<key:string,value:string>>"


def one(spark, column, **values):
    """The column's value over one row of typed values: name=(type, value)."""
    row = spark.createDataFrame([tuple(v for _, v in values.values())], ", ".join(f"{k} {t}" for k, (t, _) in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda t: tx.without_tatweel(t), "a  B\tب. 5"),
        (lambda t: tx.display(t), "a b ـب. 5"),
        (lambda t: tx.truncated(t, 3), "a  …"),
        (lambda t: tx.truncated(t, 10), "a  B\tـب. 5"),
        (lambda t: tx.sentences(t), ["a  B\tـب.", "5"]),
        (lambda t: tx.contains_any(t, ("zz", "ـب")), True),
        (lambda t: tx.contains_any(t, ("zz",)), False),
        (lambda t: tx.substituted(F.lit("<{x}|{y}|{x}>"), {"x": t, "y": F.lit("{x}")}), "<a  B\tـب. 5|{x}|a  B\tـب. 5>"),
    ],
)
def test_text_rules(spark, column, wanted):
    assert one(spark, column(F.col("t")), t=("string", "a  B\tـب. 5")) == wanted


def test_sections_objects_and_histories(spark):
    t = "## FIRST: one\n two\n## NEXT PART: three"
    assert [one(spark, tx.section(F.col("t"), h), t=("string", t)) for h in ("FIRST", "NEXT PART", "NONE")] == ["one\n two", "three", ""]
    assert one(spark, tx.last_object(F.col("t")), t=("string", 'x {"a": "1"} y {"b": "2"} z')) == {"b": "2"}
    assert one(spark, tx.last_object(F.col("t")), t=("string", "none")) is None
    turns = [{"role": "user", "content": f"q{i}"} for i in range(8)]
    assert one(spark, tx.history_text(F.col("h"), 2), h=("array<struct<role:string,content:string>>", turns)) == "user: q6\nuser: q7"
    assert one(spark, tx.history_text(F.col("h")), h=("array<struct<role:string,content:string>>", turns[:1])) == "user: q0"
    asked = one(spark, tx.clarification(F.lit("laser"), F.array(F.lit("small"), F.lit("large"))))
    assert asked.split("\n")[1:3] == ["- small", "- large"] and "laser" in asked and one(spark, history.is_clarification(F.col("t")), t=("string", asked))
    fields = [{"key": "nـame", "value": " "}, {"key": " name 2", "value": "a  b "}]
    assert one(spark, tx.first_field(F.col("f"), "name"), f=(FIELDS, fields)) == "a b"
    assert one(spark, tx.first_field(F.col("f"), "size"), f=(FIELDS, fields)) is None


def test_fenced_blocks(spark):
    cases = [("a ```json\n{\"k\": 1}\n``` b ", '{"k": 1}', "b"), ("no block", None, "no block"), ("```json\n{bad\n``` c", None, "c")]
    for text, json, rest in cases:
        assert one(spark, tx.fenced_json(F.col("t")), t=("string", text)) == json
        assert one(spark, tx.phrasing(F.col("t")), t=("string", text)) == rest
    entries = '[{"source": 1, "fields": {"a": "1", "b": "2"}}, {"source": 2, "fields": {"a": "3"}}]'
    assert one(spark, tx.json_values(F.col("t")), t=("string", entries)) == "1 2 3"
    assert one(spark, tx.flattened(F.col("t")), t=("string", entries)) == {"a": "3", "b": "2"}
    empties = [('[{"source": 1, "fields": {}}]', True), ("{}", True), ("[]", True), (entries, False), (None, False), ("x", False)]
    assert [one(spark, tx.json_is_empty(F.col("t")), t=("string", t)) for t, _ in empties] == [e for _, e in empties]


def test_mixed_scripts(spark):
    assert one(spark, bidi.script_spacing(F.col("t")), t=("string", "سعرABCهنا")) == "سعر ABC هنا"
    assert one(spark, bidi.paragraph_spacing(F.col("t")), t=("string", "a. b؟ c")) == "a.\n\nb؟\n\nc"
    assert one(spark, bidi.paragraph_spacing(F.col("t")), t=("string", "a. b\nc")) == "a. b\nc"
    mark = bidi.RLM
    assert one(spark, bidi.anchor_punctuation(F.col("t")), t=("string", "سعر. a.")) == f"سعر{mark}.{mark} a."


def test_routing_and_outcomes(spark):
    intents = spark.createDataFrame([("book",), ("odd",), (None,)], "i string").select(decisions.route(F.col("i"), {"book": "booking"}).alias("t")).collect()
    assert [r["t"] for r in intents] == ["booking", "text_pipeline", "text_pipeline"]
    assert one(spark, F.array(*[decisions.routing_outcome(F.lit(t)) for t in ("text_pipeline", "booking")])) == ["ai_handled", "not_implemented"]
    assert one(spark, F.array(*[decisions.in_closed_set(F.lit(x), F.array(F.lit("a")), "z") for x in ("a", "b")])) == ["a", "z"]
    topics = [("o", "answered", "q", "c"), (None, "answered", "q", "c"), (None, None, "q", "c"), (None, "answered", " \t", "c")]
    got = spark.createDataFrame(topics, "o string, s string, q string, c string").select(decisions.topic_of(F.col("o"), F.col("s"), F.col("q"), F.col("c")).alias("t")).collect()
    assert [r["t"] for r in got] == ["o", "c", None, None]
    turns = [("normal", True, True, True), ("unavailable_everywhere", False, True, True), ("normal", False, False, True), ("normal", False, True, False), ("unavailable_here", False, True, True)]
    got = spark.createDataFrame(turns, "a string, m boolean, g boolean, v boolean").select(decisions.outcome_status(F.col("a"), F.col("m"), F.col("g"), F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == ["clarification_requested", "not_found", "technical_error", "escalated_verification", "answered"]
    said = decisions.template_reply(spark.createDataFrame([("c", "s", "r"), ("c", "u", "r")], "client_id string, dialogue_state string, r string"), spark.createDataFrame([("c", "s", "T")], "client_id string, dialogue_state string, template string"), F.col("r"))
    assert {r["dialogue_state"]: r["reply"] for r in said.collect()} == {"s": "T", "u": "r"}


def test_history_of_routing_and_of_generation(spark):
    decline, asked = history.DECLINE_MARKERS[0], f"x {history.CLARIFICATION_SUFFIX}"
    turns = [{"role": r, "content": c} for r, c in (("user", "q1"), ("assistant", decline), ("user", "q2"), ("assistant", asked), ("user", "q3"))]
    left = lambda excluded: [t["content"] for t in one(spark, history.without_excluded(F.col("h"), excluded), h=("array<struct<role:string,content:string>>", turns))]
    assert left(history.excluded_from_routing) == ["q2", asked, "q3"] and left(history.excluded_from_generation) == ["q3"]


def test_reports(spark):
    graded = spark.createDataFrame([("PASS",), ("PASS",), ("FAIL",)], "verdict string")
    assert {r["verdict"]: r["n"] for r in analytics.verdict_counts(graded).collect()} == {"PASS": 2, "FAIL": 1}
    failures = spark.createDataFrame([(["A", "B"], True), (["A: more"], False)], "failure_reasons array<string>, context_available boolean")
    assert analytics.reason_counts(failures, "A", "B").first().asDict() == {"a": 2, "b": 1, "no_context": 1}
    block = lambda j: f"```json\n{j}\n```"
    rows = [(block('{"a": {"c": 1, "b": 2}}'), block('{"a": {"b": 2, "c": 1}}')), ("plain", "plain"), (block("{bad"), block("{}")), (block('{"a": 1}'), block('{"a": 2}'))]
    assert grounding.json_accuracy(spark.createDataFrame(rows, "output string, expected string")).first().asDict() == {"accuracy": 0.5, "n": 4}
    start, end = analytics.default_period(F.lit(datetime.datetime(2024, 3, 31)))
    log = spark.createDataFrame([(datetime.datetime(2024, 3, d),) for d in (1, 31)] + [(datetime.datetime(2024, 2, 29),)], "created_at timestamp")
    assert analytics.in_period(log, start, end).count() == 2
    ranked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "query_id int, rank int")
    kinds = spark.createDataFrame([(1, "narrow"), (2, "broad")], "query_id int, breadth string")
    assert sorted((r["query_id"], r["rank"]) for r in retrieval.window_report(ranked, kinds).where("in_first").collect()) == [(1, 1), (2, 1), (2, 2)]
    seeds = spark.createDataFrame([("c", 1, "b", "s", [{"key": str(i), "value": "same " if i else "other"} for i in range(5)]), ("c", 2, "b", "s", [{"key": str(i), "value": str(i)} for i in range(5)])], f"client_id string, id int, brand string, sheet_name string, fields {FIELDS}")
    assert [r["id"] for r in curation.disclaimer_seeds(seeds).collect()] == [1]
    lines = ["2024-01-01 00:00:00 x [context] query='q' full_context_block=", "b1", "b2", "2024-01-01 00:00:01 y", "after"]
    found = workbook.context_blocks(spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no int, text string")).collect()
    assert [(r["query"], r["block"]) for r in found] == [("q", "b1\nb2")]


def test_hybrid_results_and_reranking(spark):
    chunks = spark.createDataFrame([(1, "red shoe", [1.0, 0.0]), (2, "red hat shoe", [0.6, 0.8]), (3, "blue", [0.0, 1.0])], "id long, content string, embedding array<float>")
    queries = spark.createDataFrame([(1, "hat", [1.0, 0.0])], "query_id int, query_text string, vector array<float>")
    fused = {r["id"]: r["rank"] for r in retrieval.hybrid_top_k(queries, chunks, 3).collect()}
    assert fused == {2: 1, 1: 2, 3: 3}  # 1/62 + 1/61, then 1/61, then 1/63
    assert [r["id"] for r in retrieval.hybrid_top_k(queries, chunks, 1, rerank=lambda q, c: F.length(c) * -1.0).collect()] == [3]
    assert retrieval.candidate_k(5) == 20 and retrieval.candidate_k(9) == 36
    assert one(spark, retrieval.unknown_filter_keys(F.col("f"), F.array(F.lit("brand"))), f=("map<string,string>", {"z": "1", "a": "2", "brand": "3"})) == ["a", "z"]


def test_ports(spark):
    rows = spark.createDataFrame([(1, "Red  red hat", None), (2, "hat red RED", None), (3, "", None), (4, None, None), (5, "x", [9.0])], "id int, content string, embedding array<float>")
    v = {r["id"]: r["embedding"] for r in ports.embed_missing(rows).collect()}
    assert v[1] == v[2] and math.isclose(sum(x * x for x in v[1]), 1, rel_tol=1e-5) and len(v[1]) == ports.DIMENSIONS
    assert not any(v[3]) and v[4] is None and v[5] == [9.0]
    assert one(spark, F.array(*[ports.keyword_intent(F.lit(t), {"book": ("reserve",)}) for t in ("Reserve it", "price")])) == ["book", "inquiry"]
    topics = F.array(F.lit("laser large"), F.lit("laser"))
    assert one(spark, F.array(*[ports.keyword_topic(F.lit(t), topics) for t in ("the laser, please", "large laser", "none")])) == ["laser", "laser large", None]
    assert one(spark, ports.port(ports.REWRITERS, "unchanged")(F.lit(" q "), F.lit(None))) == "q" and ports.port(ports.EMBEDDERS, "other") is None


def test_tenants_and_embeddings(spark):
    config = spark.createDataFrame([("k1", "c1")], "admin_api_key string, client_id string")
    asked = ingest.tenant_of_key(spark.createDataFrame([("k1",), ("k2",)], "api_key string"), config)
    assert {r["api_key"]: r["client_id"] for r in asked.collect()} == {"k1": "c1", "k2": None}
    chunks = spark.createDataFrame([("c", 1, "f", None), ("c", 2, "g", None), ("c", 3, "f", [1.0])], "client_id string, id int, source_file string, embedding array<float>")
    assert ingest.without_embedding(chunks).count() == 2 and [r["id"] for r in ingest.without_embedding(chunks, "f").collect()] == [1]
    filled = ingest.with_embeddings(chunks, spark.createDataFrame([("c", 1, [2.0]), ("d", 2, [3.0])], "client_id string, id int, embedding array<float>"))
    assert {r["id"]: r["embedding"] for r in filled.collect()} == {1: [2.0], 2: None, 3: [1.0]}


def test_mirror_of_a_folder(spark):
    staged = f"client_id string, source_file string, sheet_name string, ord long, fields {FIELDS}"
    cell = lambda k, v: [{"key": k, "value": v}]
    rows = spark.createDataFrame([("c", "new.xlsx", "S", 1, cell("a", "1")), ("c", "bad.xlsx", "T", 1, cell("a", "2"))], staged)
    staging = spark.createDataFrame([("c", "new.xlsx", "S", 9, cell("a", "0")), ("c", "bad.xlsx", "T", 9, cell("b", "0")), ("c", "gone.xlsx", "S", 9, cell("a", "0"))], staged)
    registry = spark.createDataFrame([("c", "T", ["b"], ["b"])], "client_id string, sheet_name string, columns array<string>, mandatory_fields array<string>")
    config = spark.createDataFrame([("c", {"x": "X"})], "client_id string, brand_value_aliases map<string,string>")
    chunks = ingest.chunk_rows(staging, registry, config)
    listed = spark.createDataFrame([("c", "new.xlsx"), ("c", "bad.xlsx")], "client_id string, source_file string")
    for ok in (True, False):
        after, made, rejected = ingest.mirror_sync(rows, listed, staging, chunks, registry, config, ok)
        gone = set() if ok else {("gone.xlsx", 9)}
        assert {(r["source_file"], r["ord"]) for r in after.collect()} == {("new.xlsx", 1), ("bad.xlsx", 9)} | gone
        assert {(r["source_file"], r["content"].split("] ")[1]) for r in made.collect()} == {("new.xlsx", "a: 1"), ("bad.xlsx", "b: 0")} | {(f, "a: 0") for f, _ in gone}
        assert [(r["source_file"], r["missing"]) for r in rejected.collect()] == [("bad.xlsx", ["b"])]
    keys = spark.createDataFrame([("c", "gone.xlsx"), ("c", "never.xlsx")], "client_id string, source_file string")
    assert {r["source_file"]: r["n"] for r in ingest.deleted_counts(staging, keys).collect()} == {"gone.xlsx": 1, "never.xlsx": 0}


def test_streams_of_windows_and_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([(at, "a", 1.0), (at + datetime.timedelta(minutes=1), "a", 3.0), (at + datetime.timedelta(hours=5), "b", 5.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = sessions.windowed_outcomes(stream, "1 hour", late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["start"], r["event_type"], r["n"], r["avg_value"]) for r in spark.table("windows").collect()] == [(at, "a", 2, 2.0)]
    sessions.file_chain(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), f"{tmp_path}/c").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/0").count() == 3


def test_json_is_all_of_a_text(spark):
    good = ['{"a": 1}', ' [1, {"b": []}] ', '"x"', "1", "{}"]
    bad = ['{"a": 1}}', '{"a": 1} x', "[1]]", "1 2", '{"a": 1', "1, 2", '1, "k"', '1, "k": 2', '{"a": 1}], [1', '{"a": 1}, {"b": 2}', "", "x"]
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad] + [(None, False)], "x string, whole boolean")
    assert all(r["whole"] == r["got"] for r in rows.select("whole", tx.parsed(rows.x).isNotNull().alias("got")).collect())
