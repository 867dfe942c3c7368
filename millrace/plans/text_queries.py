"""Queries of the text functions over documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import bidi
from millrace.functions import text as tx
from millrace.operators import decisions, grounding, retrieval
from millrace.plans.registry import query
from millrace.tables import PART_SQL, dense_queries, part_chunks, table, vectors

_SPLIT = "string_split(trim(regexp_replace(%s, '\\s+', ' ', 'g')), ' ')"


@query("h1_chunk_text", f"WITH {PART_SQL} SELECT id, '[Document: catalog.v2] ' || string_agg(label || ': ' || value, '. ' ORDER BY ord) AS content FROM fields GROUP BY id")
def chunk_text(spark, sf_dir):
    return part_chunks(spark, sf_dir).select("id", tx.chunk_text(F.col("fields"), F.lit("in/catalog.v2.xlsx")).alias("content"))


@query("h2_parse_chunk", f"WITH {PART_SQL} SELECT id, string_agg(trim(label) || '=' || trim(value), '|' ORDER BY ord) AS fields FROM fields GROUP BY id")
def parse_chunk(spark, sf_dir):
    content = tx.chunk_text(F.col("fields"), F.lit("catalog.xlsx"))
    parsed = tx.parse_chunk(content)
    return part_chunks(spark, sf_dir).select("id", F.array_join(F.transform(parsed, lambda f: F.concat_ws("=", f["key"], f["value"])), "|").alias("fields"))


@query("h3_display", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS shown FROM documents")
def display(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.display(F.col("text"))).alias("shown"))


@query("h4_tokens", r"""WITH t AS (SELECT item_id, list_distinct(string_split(lower(trim(regexp_replace(regexp_replace(text, '[؟،؛!.,()\[\]{}"''/\\-]', ' ', 'g'), '\s+', ' ', 'g'))), ' ')) AS w FROM benchmark)
 SELECT item_id, array_to_string(list_sort(list_filter(w, lambda x: len(x) >= 2 OR regexp_matches(x, '^[0-9]+$'))), ',') AS tokens FROM t""")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(tx.tokens(F.col("text"))), ",").alias("tokens"))


@query("h5_common_prefix", """WITH w AS (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS t FROM part), one AS (SELECT p_brand, min_by(t, p_partkey) AS f FROM w GROUP BY p_brand),
 pos AS (SELECT p_brand, unnest(range(1, len(f) + 1)) AS i, f FROM one), bad AS (SELECT p.p_brand, min(p.i) AS i FROM pos p JOIN w USING (p_brand) WHERE w.t[p.i] IS DISTINCT FROM p.f[p.i] GROUP BY p.p_brand)
 SELECT o.p_brand AS brand, array_to_string(CASE WHEN b.i IS NULL THEN o.f ELSE list_slice(o.f, 1, b.i - 1) END, ' ') AS prefix FROM one o LEFT JOIN bad b USING (p_brand)""")
def common_prefix(spark, sf_dir):
    """Each brand's first list, cut at the first place where any other differs; no brand's lists meet in one row."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.split("p_name", " ").alias("t"))
    one = rows.where("t is not null").groupBy("brand").agg(F.min_by("t", "p_partkey").alias("f"))
    pairs = rows.join(F.broadcast(one.withColumnRenamed("brand", "own")), F.col("brand").eqNullSafe(F.col("own")), "left")
    differs = F.coalesce(tx.first_difference(F.col("f"), F.col("t")), F.lit(1))
    cut = pairs.groupBy("brand").agg(F.first("f").alias("f"), F.min(F.when(differs > 0, differs)).alias("i"))
    return cut.select("brand", F.array_join(F.slice("f", 1, F.coalesce(F.col("i") - 1, F.size("f")).cast("int")), " ").alias("prefix"))


@query("h6_significant_tokens", r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\p{L}+'), lambda x: len(x) >= 3))), ',') AS tokens FROM benchmark")
def significant(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(tx.significant_tokens(F.col("text"))), ",").alias("tokens"))


@query("h8_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[:.,][0-9]+)*'), '|') AS numbers FROM documents")
def numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.numbers(F.col("text")), "|").alias("numbers"))


@query("h10_sentences", r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
 k AS (SELECT doc_id, list_filter(list_transform(s, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT suffix(x, '?')) AS s FROM t)
 SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM k""")
def sentences(spark, sf_dir):
    s = tx.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("h20_paragraphs", r"SELECT item_id, CASE WHEN contains(text, chr(10)) THEN text ELSE regexp_replace(text, '([.!])[ \t]+(\S)', '\1' || chr(10) || chr(10) || '\2', 'g') END AS shown FROM benchmark")
def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", bidi.paragraph_spacing(F.col("text")).alias("shown"))


@query("h22_sanitize")
def sanitize(spark, sf_dir):
    """All rewrites; tests state each rule on literal texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", bidi.sanitize(F.col("text")).alias("shown"))


@query("h23_stable_id", "SELECT doc_id, 'doc-' || substr(sha1(source || '|' || doc_id), 1, 20) AS custom_id FROM documents")
def stable_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.stable_id("doc", F.col("source"), F.col("doc_id").cast("string")).alias("custom_id"))


@query("h28_fenced_json", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN props END AS block, CASE WHEN event_id % 3 = 0 THEN 'plain ' || props ELSE 'after' END AS phrasing FROM events WHERE props IS NOT NULL""")
def fenced(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props is not null")
    raw = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("x ```json\n"), "props", F.lit("\n```\n after "))).otherwise(F.concat(F.lit("plain "), "props"))
    return e.select("event_id", tx.fenced_json(raw).alias("block"), tx.phrasing(raw).alias("phrasing"))


@query("h38_dot", "SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dot FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def dots(spark, sf_dir):
    # a missing vector has a row too: nothing is as long as an empty one, so its score is null
    rows = vectors(spark, sf_dir).withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
    pairs = retrieval.dense_scores(dense_queries(spark, sf_dir), rows)
    return pairs.select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("dot"))


@query("d7_placeholder", f"""WITH {PART_SQL} SELECT id, round(count(DISTINCT value)::DOUBLE / count(*), 9) AS ratio, count(*) >= 5 AND count(DISTINCT value)::DOUBLE / count(*) <= 0.4 AS placeholder
 FROM (SELECT id, value FROM fields UNION ALL SELECT id, unnest(CASE WHEN id % 5 = 0 THEN ['yes', 'yes', 'yes', 'yes', 'yes', 'yes', 'yes'] ELSE ['a'] END) FROM (SELECT p_partkey AS id FROM part)) GROUP BY id""")
def placeholder(spark, sf_dir):
    extra = F.when(F.col("id") % 5 == 0, F.array_repeat(F.lit("yes"), 7)).otherwise(F.array(F.lit("a")))
    rows = part_chunks(spark, sf_dir).select("id", F.concat(F.transform("fields", lambda f: f["value"]), extra).alias("v"))
    return rows.select("id", F.round(decisions.distinct_ratio(F.col("v")), 9).alias("ratio"), decisions.is_placeholder(F.col("v"), 0.4).alias("placeholder"))


@query("d8_mode_share", f"WITH {PART_SQL}, c AS (SELECT id, value, count(*) AS n FROM fields GROUP BY id, value) SELECT id, round(max(n)::DOUBLE / sum(n), 9) AS share FROM c GROUP BY id")
def mode_share(spark, sf_dir):
    return part_chunks(spark, sf_dir).select("id", F.round(decisions.mode_share(F.transform("fields", lambda f: f["value"])), 9).alias("share"))


@query("k10_reply_gate", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing_required_phrase' WHEN event_id % 4 = 2 THEN 'unverified_numeric_claim' END AS rejection_reason,
 CASE WHEN event_id % 2 = 1 THEN 'it costs ' || json_extract_string(props, '$.k') || ' today. is it 7777?' ELSE 'a colleague answers' END AS safe_text FROM events WHERE props IS NOT NULL""")
def reply_gate(spark, sf_dir):
    """Odd events state their own number; of the others half state a wrong one, half lack a phrase."""
    k = F.get_json_object("props", "$.k")
    number = F.when(F.col("event_id") % 4 == 2, F.lit("99999")).otherwise(k)
    rows = table(spark, sf_dir, "events").where("props is not null").select(
        "event_id", F.concat(F.lit("it costs "), number, F.lit(" today. is it 7777?")).alias("phrasing"), F.col("props").alias("json_block"),
        F.lit("").alias("context_block"), F.lit("").alias("patient_message"), F.when(F.col("event_id") % 4 == 0, "brand").alias("required_phrase"),
    )
    return grounding.verify_replies(rows, "a colleague answers").select("event_id", "rejection_reason", "safe_text")
