"""Queries over single rows and keys: lookups, updates by key, log lines, texts of replies and ports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import ports
from millrace.functions import text as tx
from millrace.operators import analytics, curation, decisions, history, ingest, retrieval
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import _DENSE, _dense
from millrace.sources import workbook
from millrace.tables import PART_SQL, messages, part_chunks, table, vectors


@query("a6_tenant_of_key", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' ELSE n_name END AS api_key, CASE WHEN c_custkey % 9 <> 0 THEN 'c' || n_nationkey END AS client_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tenant_of_key(spark, sf_dir):
    """Nations are tenants whose name is their key; every ninth customer's key is unknown."""
    nation = table(spark, sf_dir, "nation")
    config = nation.select(F.col("n_name").alias("admin_api_key"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("client_id"))
    asked = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return ingest.tenant_of_key(asked.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "unknown").otherwise(F.col("n_name")).alias("api_key")), config).select("c_custkey", "api_key", "client_id")


def _chunks(spark, sf_dir):
    """Documents as chunks with the vector of their id, if there is one."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("client_id"), F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("text").alias("content"))
    return docs.join(vectors(spark, sf_dir).select("id", "embedding"), "id", "left")


@query("a7_without_embedding", "SELECT doc_id AS id FROM documents WHERE source = 'src3' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def without_embedding(spark, sf_dir):
    return ingest.without_embedding(_chunks(spark, sf_dir), "src3").select("id")


@query("a13_deleted_counts", "WITH k AS (SELECT l AS client_id, s AS source_file FROM (SELECT DISTINCT lang AS l FROM documents), (SELECT unnest(['src1', 'src2', 'nowhere']) AS s)) SELECT client_id, source_file, count(d.doc_id) AS n FROM k LEFT JOIN documents d ON d.lang = client_id AND d.source = source_file GROUP BY ALL")
def deleted_counts(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.col("lang").alias("client_id")).distinct().withColumn("source_file", F.explode(F.array(*[F.lit(s) for s in ("src1", "src2", "nowhere")])))
    return ingest.deleted_counts(_chunks(spark, sf_dir), keys)


@query("a15_with_embeddings", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN [doc_id::FLOAT] ELSE embedding END AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def with_embeddings(spark, sf_dir):
    """Every third chunk is embedded anew; the new vectors of odd ones belong to another tenant."""
    c = _chunks(spark, sf_dir)
    new = c.where("id % 3 = 0").select(F.when(F.col("id") % 2 == 0, F.col("client_id")).otherwise("other").alias("client_id"), "id", F.array(F.col("id").cast("float")).alias("embedding"))
    return ingest.with_embeddings(c, new).select("id", "embedding")


@query("i7_embed_missing", "SELECT doc_id AS id, coalesce(embedding, [len(text)::FLOAT]) AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embed_missing(spark, sf_dir):
    """The model gives a text's length; only chunks without a vector reach it."""
    return ports.embed_missing(_chunks(spark, sf_dir), lambda c: F.array(F.length(c).cast("float"))).select("id", "embedding")


@query("e9_context_blocks", """WITH l AS (SELECT user_id % 5 AS f, event_id AS no, CASE event_type WHEN 'click' THEN 'h' WHEN 'error' THEN 's' ELSE 'b' END AS kind, user_id, event_type || ' ' || event_id AS body FROM events),
 g AS (SELECT *, sum(CASE WHEN kind <> 'b' THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY no ROWS UNBOUNDED PRECEDING) AS seq FROM l)
 SELECT 'f' || f AS file, seq, max(CASE WHEN kind = 'h' THEN 'q' || user_id END) AS query, coalesce(string_agg(CASE WHEN kind = 'b' THEN body END, chr(10) ORDER BY no), '') AS block FROM g GROUP BY f, seq HAVING max(CASE WHEN kind = 'h' THEN 1 ELSE 0 END) = 1""")
def context_blocks(spark, sf_dir):
    """Events as log lines: clicks are headers, errors stamped lines, all others stand in blocks."""
    e = table(spark, sf_dir, "events")
    head = F.concat(F.lit("2024-01-01 10:00:00 [context] query='q"), F.col("user_id").cast("string"), F.lit("' full_context_block="))
    body = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    text = F.when(F.col("event_type") == "click", head).when(F.col("event_type") == "error", F.concat(F.lit("2024-01-01 10:00:00 "), body)).otherwise(body)
    return workbook.context_blocks(e.select(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("file"), F.col("event_id").alias("line_no"), text.alias("text")))


@query("h12_clarifications", "SELECT conv_id, turn, ends_with(coalesce(text, ''), 'e.') AS asks, contains(coalesce(text, ''), 'the') OR contains(coalesce(text, ''), 'que') AS declines FROM conversations")
def clarifications(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", history.is_clarification(text, "e.").alias("asks"), history.is_decline(text, ("the", "que")).alias("declines"))


@query("h13_clarification_text", "SELECT p_brand AS brand, 'متاح لدينا أكتر من نوع من ' || p_brand || '، منها:' || chr(10) || string_agg(DISTINCT '- ' || p_type, chr(10) ORDER BY '- ' || p_type) || chr(10) || 'تحب أي نوع فيهم؟' AS reply FROM part GROUP BY p_brand")
def clarification_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("options"))
    return p.select("brand", tx.clarification(F.col("brand"), F.col("options")).alias("reply"))


@query("h15_history_text", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM r WHERE n <= 4 GROUP BY conv_id")
def history_text(spark, sf_dir):
    """Of the last eight messages the last four are shown."""
    return history.last_messages(messages(spark, sf_dir), 8).select("session_id", tx.history_text(F.col("history"), 4).alias("history"))


@query("h16_truncated", "SELECT doc_id, CASE WHEN len(text) <= 200 THEN text ELSE left(text, 200) || '…' END AS text FROM documents")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 200).alias("text"))


@query("h25_first_field", f"WITH {PART_SQL}, f AS (SELECT id, min_by(value, ord) FILTER (WHERE label LIKE 's%' OR label LIKE 'c%') AS value FROM fields GROUP BY id) SELECT id, value FROM f")
def first_field(spark, sf_dir):
    """The size, or for the rows that lack it the code, which alone has a tatweel in its label."""
    c = part_chunks(spark, sf_dir).select("id", F.transform("fields", lambda f: F.struct(F.when(f["key"] == "code", F.lit("sـcode")).otherwise(f["key"]).alias("key"), F.concat(F.lit(" "), f["value"]).alias("value"))).alias("fields"))
    return c.select("id", tx.first_field(F.col("fields"), "s").alias("value"))


@query("h27_flattened", "SELECT p_partkey AS id, 'brand=' || p_brand || '|size=' || (p_size + 1) || '|type=' || p_type AS fields FROM part")
def flattened(spark, sf_dir):
    """Two sources name a part's fields; the second one's size counts."""
    p = table(spark, sf_dir, "part")
    source = lambda n, **fields: F.struct(F.lit(n).alias("source"), F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("fields"))
    json = F.to_json(F.array(source(1, size=F.col("p_size").cast("string"), type=F.col("p_type")), source(2, brand=F.col("p_brand"), size=(F.col("p_size") + 1).cast("string"))))
    entries = F.array_sort(F.transform(F.map_entries(tx.flattened(json)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(entries, "|").alias("fields"))


@query("c12_disclaimers", f"""WITH {PART_SQL}, v AS (SELECT id, value, count(*) AS n FROM (SELECT id, trim(value) AS value FROM fields) GROUP BY ALL), s AS (SELECT id, max(n) / sum(n) AS share FROM v GROUP BY id HAVING max(n)::DOUBLE / sum(n) >= 0.25),
 k AS (SELECT DISTINCT s.id, f.brand, f.sheet_name FROM s JOIN fields f USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY brand, sheet_name ORDER BY sha1('1|' || id), id) AS n FROM k) SELECT id, brand, sheet_name FROM r WHERE n <= 3""")
def disclaimers(spark, sf_dir):
    """A quarter of a row's values must be equal, which few rows of five have."""
    return curation.disclaimer_seeds(part_chunks(spark, sf_dir), 0.25).select("id", "brand", "sheet_name")


@query("d11_unmatched", f"WITH {PART_SQL}, h AS (SELECT id, bool_or(label LIKE 'si%' AND trim(value) <> '') AS has FROM fields GROUP BY id) SELECT 'c0' AS client_id, count(*) FILTER (WHERE NOT has) AS n FROM h")
def unmatched(spark, sf_dir):
    return curation.unmatched(part_chunks(spark, sf_dir), "si")


@query("k22_window_report", f"""WITH {_DENSE}, t AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2 FROM dense WHERE rank <= 2 GROUP BY query_id),
 b AS (SELECT query_id, CASE WHEN s2 IS NULL OR (s1 >= 0.0 AND s1 - s2 >= 0.3) THEN 'narrow' ELSE 'broad' END AS breadth FROM t)
 SELECT d.query_id, d.id, d.rank, b.breadth, b.breadth <> 'narrow' OR d.rank <= 1 AS in_first FROM dense d JOIN b USING (query_id) WHERE d.rank <= 5""")
def window_report(spark, sf_dir):
    ranked = _dense(spark, sf_dir, 5)
    return retrieval.window_report(ranked, decisions.breadth(ranked)).select("query_id", "id", "rank", "breadth", "in_first")


@query("j4_keyword_intent", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'that') THEN 'price' WHEN contains(lower(text), 'que') THEN 'booking' ELSE 'inquiry' END AS intent FROM conversations")
def keyword_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ports.keyword_intent(F.col("text"), {"price": ("the", "that"), "booking": ("que",)}).alias("intent"))


@query("h36_default_period", "SELECT count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-25 12:00:00'")
def default_period(spark, sf_dir):
    """The period that ends at a fixed now."""
    start, end = analytics.default_period(F.lit("2024-01-25 12:00:00").cast("timestamp_ntz"))
    rows = analytics.in_period(table(spark, sf_dir, "events"), start, end, "ts")
    return rows.agg(F.count(F.lit(1)).alias("n"))
