"""Grounding gates: replies and training records whose claims their sources don't hold are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

#: Rejections that concern the form of a record, not its grounding.
STRUCTURAL = ("output_json_not_a_dict", "broad_output_not_a_list")


def unverified_number(parts: Column, allowed: Column) -> Column:
    """struct<sentence, number> of the first number that isn't allowed; null if all are."""
    found = F.flatten(F.transform(parts, lambda s: F.transform(F.filter(tx.numbers(s), lambda n: ~F.array_contains(allowed, n)), lambda n: F.struct(s.alias("sentence"), n.alias("number")))))
    return F.get(found, 0)


def verify_replies(replies: DataFrame, fallback: str) -> DataFrame:
    """Replies with safe_text, rejection_reason and rejection_detail.

    replies: phrasing, json_block (text or null), context_block, patient_message, required_phrase.
    A missing required phrase rejects first; without JSON the reply passes; any number of a clause
    (questions aside) must stand in the JSON's values, the context or the patient's message.
    """
    text = F.concat_ws(" ", tx.json_values(F.col("json_block")), "context_block")
    allowed = F.array_union(tx.numbers(text), tx.numbers(F.col("patient_message")))
    missing = F.coalesce((F.col("required_phrase") != "") & ~F.contains("phrasing", "required_phrase"), F.lit(False))
    x = replies.withColumn("_bad", F.when(F.col("json_block").isNotNull(), unverified_number(tx.reply_clauses(F.col("phrasing")), allowed)))
    reason = F.when(missing, "missing_required_phrase").when(F.col("_bad").isNotNull(), "unverified_numeric_claim")
    detail = F.when(missing, F.to_json(F.struct("required_phrase"))).when(F.col("_bad").isNotNull(), F.to_json(F.col("_bad")))
    return x.withColumns({"rejection_reason": reason, "rejection_detail": detail, "safe_text": F.when(reason.isNull(), F.col("phrasing")).otherwise(fallback)}).drop("_bad")


def handoff_rows(verified: DataFrame) -> DataFrame:
    """Rows of the hand-off queue for the rejected replies."""
    return verified.where("rejection_reason is not null").select("client_id", "session_id", "patient_message", F.col("phrasing").alias("draft_reply"), "rejection_reason", "rejection_detail", F.lit("open").alias("status"))


def key_value_violation(output: Column, source: Column) -> Column:
    """Reason of the first entry of `output` that isn't an entry of `source`; null if all are."""
    trimmed = lambda x: tx.stripped(F.coalesce(x, F.lit("None")))
    bad = F.filter(F.map_entries(output), lambda e: ~F.map_contains_key(source, e["key"]) | (trimmed(F.try_element_at(source, e["key"])) != trimmed(e["value"])))
    return F.when(F.size(bad) > 0, F.when(F.map_contains_key(source, F.get(bad, 0)["key"]), "value_mismatch").otherwise("invented_key"))


def check_records(records: DataFrame) -> DataFrame:
    """Training records with accepted, rejection_reason and rejection_stage.

    records: grounding_type, output_json (text), output_phrasing, field_data map, sources
    array<map>, target_field, conflicting_values array.
    """
    json, phrasing = F.col("output_json"), F.coalesce("output_phrasing", F.lit(""))
    output, entries = F.from_json(json, "map<string,string>"), F.from_json(json, tx.ENTRIES)
    numeric = lambda text: F.when(unverified_number(tx.sentences(phrasing), tx.numbers(text)).isNotNull(), "unverified_numeric_claim")
    no_text = F.lit("")
    values = F.array_join(F.transform(F.map_values(output), lambda v: tx.stripped(v)), " ")
    narrow = F.when(~tx.is_object(json), "output_json_not_a_dict").otherwise(F.coalesce(key_value_violation(output, F.col("field_data")), numeric(values)))
    declared = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["source"])))
    n = F.size("sources")
    expected = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    wrong = F.exists(entries, lambda e: key_value_violation(F.coalesce(e["fields"], F.create_map().cast("map<string,string>")), F.get(F.col("sources"), e["source"] - 1)).isNotNull())
    all_values = F.array_join(F.flatten(F.transform(entries, lambda e: F.coalesce(F.map_values(e["fields"]), F.array().cast("array<string>")))), " ")
    broad = F.when(~tx.is_list(json), "broad_output_not_a_list").when(~declared.eqNullSafe(expected), "source_count_mismatch").when(wrong, "wrong_source_attribution").otherwise(numeric(all_values))
    nothing = F.coalesce(F.regexp_replace(json, r"\s", "").isin("{}", "[]"), F.lit(False))  # no JSON isn't an empty one
    absence = F.when(~nothing, "non_empty_json_for_absence").otherwise(numeric(no_text))
    invented = tx.is_object(json) & (tx.stripped(F.coalesce(F.try_element_at(output, F.col("target_field")), F.lit(""))) != "")
    direct = F.when(invented, "invented_value_for_missing_field").otherwise(numeric(no_text))
    cross = F.when(~nothing, "non_empty_json_for_ambiguous").when(F.size(F.array_distinct("conflicting_values")) < 2, "ambiguous_premise_invalid").otherwise(numeric(no_text))
    kind = F.col("grounding_type")
    reason = F.when(kind == "narrow", narrow).when(kind == "broad", broad).when(kind == "absence", absence).when(kind == "ambiguous_direct", direct).when(kind == "ambiguous_cross_chunk", cross).otherwise("unknown_grounding_type")
    out = records.withColumn("rejection_reason", reason)
    stage = F.when(F.col("rejection_reason").isin(*STRUCTURAL), "structural").when(F.col("rejection_reason").isNotNull(), "grounding")
    return out.withColumns({"accepted": F.col("rejection_reason").isNull(), "rejection_stage": stage})


def label_match(label: Column, entries: Column) -> Column:
    """The first entry whose label contains `label` or is contained in it; null if none."""
    return F.get(F.filter(entries, lambda e: F.contains(e["key"], label) | F.contains(label, e["key"])), 0)


def grade(cases: DataFrame) -> DataFrame:
    """Golden cases with a verdict; cases: expected_fact (chunk-like text), debug_json (text or null).

    FAIL if a matched label has another value, PASS if every pair matches, else NEEDS_REVIEW.
    """
    clean = lambda e: F.struct(tx.collapsed(e["key"]).alias("key"), tx.collapsed(e["value"]).alias("value"))
    actual = F.transform(F.coalesce(F.map_entries(tx.flattened(F.col("debug_json"))), F.array().cast(tx.FIELDS)), clean)
    x = cases.withColumns({"_want": F.transform(tx.parse_chunk(F.col("expected_fact")), clean), "_have": actual})
    x = x.withColumn("_pairs", F.transform("_want", lambda w: F.struct(w["value"].alias("want"), label_match(w["key"], F.col("_have"))["value"].alias("have"))))
    wrong = F.exists("_pairs", lambda p: p["have"].isNotNull() & (p["have"] != p["want"]))
    right = (F.size("_pairs") > 0) & F.forall("_pairs", lambda p: p["have"].eqNullSafe(p["want"]) & p["have"].isNotNull())
    return x.withColumn("verdict", F.when(wrong, "FAIL").when(right, "PASS").otherwise("NEEDS_REVIEW")).drop("_want", "_have", "_pairs")


def json_accuracy(rows: DataFrame) -> DataFrame:
    """Share of rows whose fenced JSON equals the expected one; no block counts as {}, a broken one is wrong."""
    side = lambda c: F.when(F.col(c).rlike(tx.FENCED_JSON), tx.fenced_json(F.col(c))).otherwise("{}")
    same = F.coalesce(tx.canonical_json(side("output")) == tx.canonical_json(side("expected")), F.lit(False))
    return rows.agg(F.avg(same.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
