"""Operators on literal frames: reasons, blanks, nested JSON, retrieval, streams, workbooks and sinks."""

from __future__ import annotations

import datetime
import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import bidi
from millrace.functions import text as tx
from millrace.operators import curation, decisions, evaluation, grounding, ingest, retrieval
from millrace.sources import sinks, workbook
from millrace.streaming import sessions

RECORDS = "id int, grounding_type string, output_json string, output_phrasing string, field_data map<string,string>, sources array<map<string,string>>, target_field string, conflicting_values array<string>"


def test_every_reason_of_the_record_gate(spark):
    data, two = {"a": "1", "b": "x"}, [{"a": "1"}, {"b": "2"}]
    broad = lambda *e: json.dumps([{"source": s, "fields": f} for s, f in e])
    cases = [
        ("narrow", '{"a": "1"}', "it is 1.", None), ("narrow", "[]", "", "output_json_not_a_dict"), ("narrow", '{"c": "1"}', "", "invented_key"), ("narrow", '{"a": "2"}', "", "value_mismatch"), ("narrow", '{"a": "1"}', "it is 77.", "unverified_numeric_claim"),
        ("broad", broad((1, {"a": "1"}), (2, {"b": "2"})), "1 and 2.", None), ("broad", "{}", "", "broad_output_not_a_list"), ("broad", broad((1, {"a": "1"})), "", "source_count_mismatch"), ("broad", broad((1, {"b": "2"}), (2, {"b": "2"})), "", "wrong_source_attribution"), ("broad", broad((1, {"a": "1"}), (2, {"b": "2"})), "9.", "unverified_numeric_claim"),
        ("absence", " { } ", "none.", None), ("absence", '{"a": "1"}', "", "non_empty_json_for_absence"), ("absence", None, "", "non_empty_json_for_absence"), ("absence", "[]", "5.", "unverified_numeric_claim"),
        ("ambiguous_direct", "{}", "", None), ("ambiguous_direct", '{"t": "7"}', "", "invented_value_for_missing_field"), ("ambiguous_direct", '{"t": " \\t"}', "", None), ("ambiguous_direct", "{}", "8.", "unverified_numeric_claim"),
        ("ambiguous_cross_chunk", "{}", "", None), ("ambiguous_cross_chunk", None, "", "non_empty_json_for_ambiguous"), ("ambiguous_cross_chunk", '{"a": "1"}', "", "non_empty_json_for_ambiguous"), ("other", "{}", "", "unknown_grounding_type"),
    ]
    rows = [(i, k, j, p, data, two, "t", ["u", "v"]) for i, (k, j, p, _) in enumerate(cases)] + [(99, "ambiguous_cross_chunk", "{}", "", data, two, "t", ["u", "u"])]
    out = {r["id"]: r for r in grounding.check_records(spark.createDataFrame(rows, RECORDS)).collect()}
    assert [out[i]["rejection_reason"] for i in range(len(cases))] == [c[3] for c in cases]
    assert out[99]["rejection_reason"] == "ambiguous_premise_invalid" and out[0]["accepted"] and out[1]["rejection_stage"] == "structural" and out[2]["rejection_stage"] == "grounding"
    assert len({c[3] for c in cases} - {None}) == 11


def test_json_keys_are_sorted_at_all_depths(spark):
    same = ['{"x": {"b": 1, "a": [{"d": 2, "c": 3}]}}', '{"x": {"a": [{"c": 3, "d": 2}], "b": 1}}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*same, '{"x": {"a": 1, "b": 1}}', "not json", None])], "i int, t string")
    got = [r["c"] for r in frame.select("i", tx.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got[0] == got[1] != got[2] and got[3:] == ["not json", None]
    records = spark.createDataFrame([(i, "p", "q", "in", t, "say") for i, t in enumerate(same)], "ord int, pass string, instruction string, input string, output_json string, output_phrasing string")
    assert curation.dedup_report(records).first()["exact_duplicates_dropped"] == 1


def test_first_json_with_its_end(spark):
    cases = [("a ```json\n{\"k\": 1}\n``` b", '{"k": 1}', 22), ('x {"a": "}", "b": {"c": [1]}} y', '{"a": "}", "b": {"c": [1]}}', 29), ('[1, {"]": 2}] {"a": 1}', '[1, {"]": 2}]', 13), ("{ open", None, None), ("none", None, None), (None, None, None), ("{bad}", None, None)]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = [(r["j"]["json"], r["j"]["end"]) if r["j"] else (None, None) for r in frame.select("i", tx.first_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [c[1:] for c in cases]


def test_blank_is_white_space_of_any_kind(spark):
    blanks = ["\t", "\n ", "\u00a0", "\u2003", "\x1c", ""]
    frame = spark.createDataFrame([([{"key": f"k{i}", "value": v} for i, v in enumerate([*blanks, None, " x "])],)], "f array<struct<key:string,value:string>>")
    row = frame.select(ingest.chosen_fields(F.col("f"), F.transform("f", lambda x: x["key"])).alias("c")).first()
    assert [(x["key"], x["value"]) for x in row["c"]] == [("k7", " x ")]


def test_cover_density_equals_an_enumeration(spark):
    r = random.Random(5)
    rows = []
    for n_terms in (1, 2, 3):
        for _ in range(40):
            at = sorted(r.sample(range(40), r.randrange(n_terms, 14)))
            terms = [*range(n_terms), *(r.randrange(n_terms) for _ in at[n_terms:])]
            r.shuffle(terms)
            rows.append((len(rows), n_terms, [{"place": p, "term": t} for p, t in zip(at, terms, strict=True)]))
    frame = spark.createDataFrame(rows, "i int, n int, at array<struct<place:int,term:int>>")
    got = {x["i"]: x["s"] for x in frame.select("i", retrieval.cover_density(F.col("at"), F.col("n")).alias("s")).collect()}
    for i, n, at in rows:
        spans = [(at[a]["place"], at[b]["place"], b - a + 1) for a, b in itertools.combinations_with_replacement(range(len(at)), 2) if len({x["term"] for x in at[a : b + 1]}) == n]
        least = [(a, b, k) for a, b, k in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d, _ in spans)]
        assert got[i] == pytest.approx(sum(0.1 / (1 + (b - a + 1) - k) for a, b, k in least))


def test_retrieve_rejects_and_filters(spark):
    chunks = spark.createDataFrame([("c", 1, "red shoe", "x", [1.0, 0.0]), ("c", 2, "red hat", "y", [0.0, 1.0]), ("d", 3, "red shoe", "x", [1.0, 0.0]), ("c", 4, "blue", None, None)], "client_id string, id long, content string, brand string, embedding array<float>")
    config = spark.createDataFrame([("c", ["brand"], 2)], "client_id string, allowed_metadata_keys array<string>, retrieval_top_k int")
    ask = [(1, "c", "red shoe", [1.0, 0.0], {}), (2, "c", "red", [1.0, 0.0], {"brand": "y"}), (3, "z", "red", [1.0, 0.0], {}), (4, "c", "red", [1.0, 0.0], {"size": "1"}), (5, "c", "red", [1.0, 0.0], {"brand": "none"})]
    requests = spark.createDataFrame(ask, "query_id int, client_id string, query_text string, vector array<float>, filters map<string,string>")
    found, rejected = retrieval.retrieve(requests, chunks, config)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2)]
    assert {r["query_id"]: r["error"] for r in rejected.collect()} == {3: "unknown client z", 4: "filter keys not allowed: size"}
    best, _ = retrieval.retrieve(requests.where("query_id = 1"), chunks, config, retrieval.lexical_overlap)
    assert [r["id"] for r in best.orderBy("rank").collect()] == [1, 2]


def test_variants_of_one_name_are_asked_about(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 0.9, "laser small", "laser"), (1, 2, 2, 0.8, "laser large", "laser"), (2, 1, 1, 0.9, "laser small", "laser"), (2, 2, 2, 0.8, "laser large", "laser"), (3, 1, 1, 0.9, "laser small", "laser")], "query_id int, rank int, id int, score double, name string, category string")
    queries = spark.createDataFrame([(1, "price of laser"), (2, "price of laser small"), (3, "laser")], "query_id int, resolved_query string")
    out = {r["query_id"]: r["options"] for r in decisions.ambiguity(ranked, queries).collect()}
    assert out == {1: ["laser small", "laser large"]}
    notes = spark.createDataFrame([("price", "price of laser"), ("price", " price "), ("price", "")], "t string, r string").select(decisions.specificity_note(F.col("t"), F.col("r")).alias("n")).collect()
    assert [r["n"] for r in notes] == ["price of laser", None, None]


def test_failures_are_classified(spark):
    apology = evaluation.APOLOGIES[0]
    records = spark.createDataFrame([("q1", "blue shoes", f"so {apology}", None), ("q2", "blue shoes", "fine", '{"a": "1"}'), ("q3", "blue shoes", "fine", '{"a": "1"}'), ("q4", "blue shoes", "fine", '{"a": "1"}')], "patient_query string, expected_fact string, actual_reply string, debug_json string")
    blocks = spark.createDataFrame([("q2", 1, "green hats"), ("q3", 1, f"hats {evaluation.GENERIC_TERMS[0]}"), ("q3 ", 2, "other"), ("q4", 1, "old"), ("q4", 2, "blue shoes")], "query string, seq int, block string")
    out = {r["patient_query"]: list(r["failure_reasons"]) for r in evaluation.classify_failures(records, blocks).collect()}
    assert out == {"q1": ["EMPTY_OR_APOLOGY"], "q2": ["CONTEXT_TOPIC_MISMATCH"], "q3": ["KEYWORD_COLLISION_SUSPECTED"]}


def test_hypotheses_requests_and_resolved_ids(spark):
    h = spark.createDataFrame([("a", 1, {"k": "v"}), ("b", 1, {"k": "v"}), ("c", 1, {"k": "v"}), ("d", 1, {"k": "v"}), ("e", 1, {"z": "v"})], "custom_id string, source_id int, answer map<string,string>")
    top = spark.createDataFrame([("a", 1, {"k": "w"}), ("b", 2, {"k": " v "}), ("c", 2, {"k": "w"}), ("e", 2, {"k": "v"})], "custom_id string, id int, fields map<string,string>")
    assert {r["custom_id"]: r["decision"] for r in curation.classify_hypotheses(h, top).collect()} == {"a": "confirmed", "b": "reattributed", "c": "needs_correction", "d": "discarded", "e": "discarded"}
    results = spark.createDataFrame([("a", "r1"), ("x", "r2")], "custom_id string, text string")
    assert [tuple(r) for r in curation.with_requests(results, h.select("custom_id", "source_id")).collect()] == [("a", "r1", 1)]
    files = [spark.createDataFrame(x, "custom_id string, source_hypothesis_custom_id string") for x in ([("1", None)], [("2", "1"), ("3", "4")])]
    assert sorted(r["custom_id"] for r in curation.resolved_ids(*files).collect()) == ["1", "4"]


def test_passes_keep_their_promises(spark):
    field = lambda i: [{"key": "name", "value": f"n{i}"}, {"key": "size", "value": str(i)}, {"key": "flag", "value": "yes"}]
    chunks = spark.createDataFrame([("c", i, "s", "b", field(i)) for i in range(100)], "client_id string, id long, sheet_name string, brand string, fields array<struct<key:string,value:string>>")
    none = spark.createDataFrame([], "custom_id string")
    narrow = curation.narrow_pass(chunks, none).collect()
    assert len(narrow) == 6 and all("flag" not in r["labels"] for r in narrow) and len({r["custom_id"] for r in narrow}) == 6
    done = spark.createDataFrame([(narrow[0]["custom_id"],)], "custom_id string")
    assert {r["custom_id"] for r in curation.narrow_pass(chunks, done).collect()} == {r["custom_id"] for r in narrow[1:]}
    asked = chunks.select("client_id", F.col("id").alias("question_id"), F.col("id").alias("source_id"))
    pairs = curation.absence_pass(asked, chunks, none).collect()
    assert len(pairs) == 60 and all(r["id"] != r["question_id"] for r in pairs)
    assert len({r["question_id"] for r in pairs}) == len({r["id"] for r in pairs}) == 60


@pytest.mark.parametrize(
    ("text", "clean"),
    [(": a", "a"), ("x(y)z", "x (y) z"), ("( a )", "(a)"), ("((a))", "(a)"), ("(a(b)", "a(b)".replace("a(", "a (")), ("( - a - )", "(a)"), ("- a -", "a"), ("a  \t b", "a b"), ("(a).", "(a).")],
)
def test_punctuation_rules(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(bidi.normalize_punctuation(F.col("t"))).first()[0] == clean


def test_latin_runs_are_isolated(spark):
    out = spark.createDataFrame([("سعر ABC-1 (x) هنا 5%.",)], "t string").select(bidi.isolate_latin(F.col("t"))).first()[0]
    assert out == "سعر \u2066ABC-1 (x)\u2069 هنا \u20665%\u2069."


def test_session_stream_keeps_the_filter_and_expires(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "client_id string, session_id string, ts timestamp, role string, content string, brand_filter string"
    for n, rows in enumerate([[("c", "s", at(0), "user", "q1", "x"), ("c", "s", at(1), "assistant", "a1", None)], [("c", "s", at(2), "user", "q2", "all")], [("c", "t", at(60), "user", "late", None)], [("c", "t", at(61), "user", "later", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = sessions.session_state(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = [r for r in spark.table("states").collect() if r["session_id"] == "s"]
    live = sorted((r for r in out if not r["expired"]), key=lambda r: r["ts"])
    assert [(r["brand_filter"], [t["content"] for t in r["history"]]) for r in live] == [("x", ["q1", "a1"]), (None, ["q1", "a1", "q2"])]
    assert sum(r["expired"] for r in out) == 1


def test_turns_are_appended_once_and_hydrate(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "message_id string, ts timestamp, client_id string, session_id string, question string, reply string"
    rows = [("m1", at, "c", "s", "q1", "a1"), ("m1", at, "c", "s", "q1", "a1"), ("m2", at + datetime.timedelta(minutes=1), "c", "s", "q2", "a2")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    sessions.append_turns(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(120)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 4
    ordered = log.withColumn("ord", F.struct("ts", "nth"))
    wanted = spark.createDataFrame([("c", "s"), ("c", "new")], "client_id string, session_id string")
    out = {r["session_id"]: [t["content"] for t in r["history"]] for r in sessions.hydrated(wanted, ordered, 3).collect()}
    assert out == {"s": ["a1", "q2", "a2"], "new": []}


def _workbook(path, rows):
    cell = lambda ref, v: "" if v is None else f'<c r="{ref}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{n}">{"".join(cell(f"{chr(65 + i)}{n}", v) for i, v in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_columns_without_or_with_the_same_header(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["k", None, "k"], ["1", "2", "3"], [None, None, None], [True, "NA", "x"]])
    (tmp_path / "b.XLSX").write_bytes(b"not read")
    rows = workbook.read_workbooks(workbook.workbook_files(spark, str(tmp_path))).orderBy("ord").collect()
    got = [[(f["key"], f["value"]) for f in r["fields"]] for r in rows]
    assert got == [[("k", "1"), ("Unnamed: 1", "2"), ("k.1", "3"), ("sheet_name", "S")], [("k", "True"), ("Unnamed: 1", None), ("k.1", "x"), ("sheet_name", "S")]]
    assert {r["source_file"] for r in rows} == {"a.xlsx"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", "f1", 1), ("c", "f2", 2)], "client_id string, source_file string, id int")
    sinks.append(rows, f"{tmp_path}/a", "id")
    sinks.append(rows.union(spark.createDataFrame([("c", "f3", 3)], rows.schema)), f"{tmp_path}/a", "id")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/a").collect()) == [1, 2, 3]
    sinks.replace_partitions(rows, f"{tmp_path}/b")
    sinks.replace_partitions(rows.where("id = 1").withColumn("id", F.lit(9)), f"{tmp_path}/b")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/b").collect()) == [2, 9]
    entries = sinks.write_datasets(rows.withColumn("split", F.when(F.col("id") == 1, "val").otherwise("train")), f"{tmp_path}/c")
    assert set(entries) == {"dataset_train", "dataset_val"} and spark.read.json(f"{tmp_path}/c/train").first()["id"] == 2
    sinks.merge_registry(spark, f"{tmp_path}/d", {"x": 1})
    sinks.merge_registry(spark, f"{tmp_path}/d", {"y": 2})
    assert json.loads(spark.read.text(f"{tmp_path}/d", wholetext=True).first()[0]) == {"x": 1, "y": 2}
