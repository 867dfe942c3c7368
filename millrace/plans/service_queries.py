"""Queries over whole turns of the service: retrieval with settings, mirroring, decisions, routing and session states."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import stored
from millrace.functions import text as tx
from millrace.operators import analytics, curation, decisions, evaluation, grounding, ingest, retrieval
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import _DENSE, _WORD, _dense
from millrace.streaming import stateful
from millrace.tables import part_chunks, table, vectors

# --- retrieval ------------------------------------------------------------------------------------

_REQUESTS = """n AS (SELECT e.vec_id AS query_id, e.vec_id // 100 AS n, e.embedding AS v, b.text AS t FROM embeddings e LEFT JOIN benchmark b ON b.item_id = e.vec_id // 100 WHERE e.vec_id % 100 = 0),
r AS (SELECT *, 'c' || (n % 3) AS client_id, CASE WHEN n % 4 = 1 THEN 'en' END AS brand, n % 4 = 2 AS secret, CASE n % 3 WHEN 0 THEN 5 ELSE 3 END AS k, CASE n % 3 WHEN 0 THEN 60 ELSE 10 END AS rrf FROM n)"""
_HYBRID = f"""{_REQUESTS}, g AS (SELECT * FROM r WHERE n % 3 <> 2 AND NOT secret),
c AS (SELECT doc_id AS id, text, lang AS brand, 'c' || (doc_id % 2) AS client_id, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
ds AS (SELECT g.query_id, c.id, round(list_inner_product(g.v::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM g JOIN c ON c.client_id = g.client_id AND (g.brand IS NULL OR g.brand = c.brand) WHERE c.embedding IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds),
terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(t), '{_WORD}'))) AS term FROM g),
wanted AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY query_id),
freq AS (SELECT id, term, count(*) AS f FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM c) GROUP BY id, term),
hits AS (SELECT t.query_id, f.id, count(*) AS n, sum(f.f)::DOUBLE AS score FROM terms t JOIN freq f USING (term) GROUP BY t.query_id, f.id),
own AS (SELECT h.query_id, h.id, h.score FROM hits h JOIN wanted w USING (query_id) JOIN g USING (query_id) JOIN c ON c.id = h.id AND c.client_id = g.client_id AND (g.brand IS NULL OR g.brand = c.brand) WHERE h.n = w.n_terms),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM own),
legs AS (SELECT query_id, id, rank AS d, NULL::INTEGER AS s FROM d WHERE rank <= 20 UNION ALL SELECT query_id, id, NULL, rank FROM s WHERE rank <= 20),
fused AS (SELECT query_id, id, CAST(min(d) AS INTEGER) AS dense_rank, CAST(min(s) AS INTEGER) AS sparse_rank FROM legs GROUP BY query_id, id),
scored AS (SELECT f.*, g.k, g.t, round(coalesce(1.0::DOUBLE / (g.rrf + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (g.rrf + sparse_rank), 0.0), 9) AS score FROM fused f JOIN g USING (query_id)),
pool AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS INTEGER) AS rank FROM scored)"""


def _retrieved(spark, sf_dir, rerank=None):
    """Vectors whose id is divisible by 100 ask with a benchmark item's text; texts of documents are the chunks of two tenants."""
    n = F.expr("vec_id div 100")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").withColumn("n", n).join(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "query_text"), F.col("n") == F.col("item_id"), "left")
    filters = F.when(F.col("n") % 4 == 1, F.create_map(F.lit("brand"), F.lit("en"))).when(F.col("n") % 4 == 2, F.create_map(F.lit("secret"), F.lit("x")))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("c"), (F.col("n") % 3).cast("string")).alias("client_id"), "query_text", F.col("embedding").alias("vector"), filters.alias("filters"))
    docs, stored_vectors = table(spark, sf_dir, "documents"), vectors(spark, sf_dir).select("id", "embedding")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("brand"), F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string")).alias("client_id")).join(stored_vectors, "id", "left")
    config = spark.createDataFrame([("c0", ["brand"], 5, 60), ("c1", ["brand"], 3, 10)], "client_id string, allowed_metadata_keys array<string>, retrieval_top_k int, rrf_k int")
    return retrieval.retrieve(asked, chunks, config, rerank)


@query("k3_retrieve", f"WITH {_HYBRID} SELECT query_id, id, score, dense_rank, sparse_rank, rank FROM pool WHERE rank <= k")
def retrieve(spark, sf_dir):
    return _retrieved(spark, sf_dir)[0]


@query("k3_rejected", f"WITH {_REQUESTS} SELECT query_id, CASE WHEN n % 3 = 2 THEN 'unknown client ' || client_id ELSE 'filter keys not allowed: secret' END AS error FROM r WHERE n % 3 = 2 OR secret")
def rejected(spark, sf_dir):
    return _retrieved(spark, sf_dir)[1]


@query("f4_rerank", f"""WITH {_HYBRID}, again AS (SELECT p.*, len(c.text)::DOUBLE AS new, CAST(row_number() OVER (PARTITION BY query_id ORDER BY len(c.text) DESC, p.rank) AS INTEGER) AS place FROM pool p JOIN c USING (id) WHERE p.rank <= 20)
 SELECT query_id, id, new AS score, dense_rank, sparse_rank, rank AS original_index, place AS rank FROM again WHERE place <= k""")
def reranked(spark, sf_dir):
    """Longer texts score higher; the whole pool of candidates is re-ranked."""
    return _retrieved(spark, sf_dir, lambda _, content: F.length(content).cast("double"))[0].select("query_id", "id", "score", "dense_rank", "sparse_rank", "original_index", "rank")


@query("b2_metadata_filter", """SELECT p_partkey AS id FROM part WHERE CASE p_partkey % 3 WHEN 0 THEN p_brand = 'Brand#11' WHEN 1 THEN p_size > 25 AND p_brand LIKE 'Brand#2%' ELSE TRUE END""")
def metadata_filter(spark, sf_dir):
    """Rows whose metadata hold all entries of their filter: one, two (the second for half of the brands) or none."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    held = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("large"), (F.col("p_size") > 25).cast("string"), F.lit("tens"), F.substring("p_brand", 7, 1), F.lit("none"), F.lit(None).cast("string"))
    asked = F.when(i == 0, F.create_map(F.lit("brand"), F.lit("Brand#11"))).when(i == 1, F.create_map(F.lit("large"), F.lit("true"), F.lit("tens"), F.lit("2")))
    return p.where(retrieval.holds_metadata(held, asked)).select(F.col("p_partkey").alias("id"))


# --- mirroring and counts -------------------------------------------------------------------------


@query("k2_mirror_sync", """WITH p AS (SELECT p_partkey AS id, p_brand AS sheet_name, p_partkey % 10 AS f, p_partkey % 5 = 0 AS special FROM part),
 bad AS (SELECT f FROM p WHERE f BETWEEN 3 AND 7 AND sheet_name = 'Brand#11' GROUP BY f HAVING NOT bool_or(special)),
 good AS (SELECT * FROM p WHERE f BETWEEN 3 AND 7 AND f NOT IN (SELECT f FROM bad)),
 kept AS (SELECT * FROM p WHERE f <= 4 AND f <> 1 AND f NOT IN (SELECT DISTINCT f FROM good))
 SELECT 'f' || f AS source_file, sheet_name, id + 1000000 AS ord FROM good UNION ALL SELECT 'f' || f, sheet_name, id FROM kept""")
def mirror_sync(spark, sf_dir):
    """Ten files of part rows: 0 to 4 are stored, 3 to 7 arrive, 1 is no longer listed; one sheet must have a field that few rows have."""
    p = part_chunks(spark, sf_dir)
    special = F.when(F.col("id") % 5 == 0, F.array(F.struct(F.lit("special").alias("key"), F.lit("x").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    rows = p.select("client_id", F.concat(F.lit("f"), (F.col("id") % 10).cast("string")).alias("source_file"), "sheet_name", F.col("id").alias("ord"), F.concat("fields", special).alias("fields"))
    old, new = rows.where("ord % 10 <= 4"), rows.where("ord % 10 between 3 and 7").withColumn("ord", F.col("ord") + 1000000)
    registry = spark.createDataFrame([("c0", "Brand#11", None, ["special"])], "client_id string, sheet_name string, columns array<string>, mandatory_fields array<string>")
    config = spark.createDataFrame([("c0", {"yes": "Y"})], "client_id string, brand_value_aliases map<string,string>")
    listed = rows.select("client_id", "source_file").distinct().where("source_file <> 'f1'")
    return ingest.mirror_sync(new, listed, old, ingest.chunk_rows(old, registry, config), registry, config)[0].select("source_file", "sheet_name", "ord")


@query("d4_row_counts", "SELECT 'chunks' AS name, lang AS client_id, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'staging', p_brand, count(*) FROM part GROUP BY p_brand")
def row_counts(spark, sf_dir):
    """Documents stand for chunks, parts for staged rows."""
    return analytics.row_counts("client_id", chunks=table(spark, sf_dir, "documents").withColumnRenamed("lang", "client_id"), staging=table(spark, sf_dir, "part").withColumnRenamed("p_brand", "client_id"))


# --- reports --------------------------------------------------------------------------------------


@query("d13_verdict_counts", "SELECT CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 1 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS verdict, count(*) AS n FROM labels GROUP BY 1")
def verdict_counts(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 1, "PASS").otherwise("NEEDS_REVIEW")
    return analytics.verdict_counts(table(spark, sf_dir, "labels").select(verdict.alias("verdict")))


@query("d14_reason_counts", "SELECT count(*) FILTER (WHERE contains(text, 'the')) AS empty_or_apology, count(*) FILTER (WHERE contains(text, 'que')) AS context_topic_mismatch, count(*) FILTER (WHERE NOT coalesce(n_chars > 1000, FALSE)) AS no_context FROM documents")
def reason_counts(spark, sf_dir):
    """Words of the texts stand for the reasons of a failure; short texts had no context."""
    d = table(spark, sf_dir, "documents")
    reasons = F.filter(F.array(F.when(F.contains("text", F.lit("the")), F.lit("EMPTY_OR_APOLOGY: x")), F.when(F.contains("text", F.lit("que")), F.lit("CONTEXT_TOPIC_MISMATCH"))), lambda r: r.isNotNull())
    return analytics.reason_counts(d.select(reasons.alias("failure_reasons"), F.coalesce(F.col("n_chars") > 1000, F.lit(False)).alias("context_available")), "EMPTY_OR_APOLOGY", "CONTEXT_TOPIC_MISMATCH")


@query("d16_json_accuracy", "SELECT round(avg(CASE WHEN role = 'user' OR (turn % 2 = 0 AND role <> 'system') THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM conversations")
def json_accuracy(spark, sf_dir):
    """Users' blocks have their keys in another order, assistants' odd turns another number, and a system turn's block is broken."""
    c = table(spark, sf_dir, "conversations")
    fenced = lambda body: F.concat(F.lit("so\n```json\n"), body, F.lit("\n```\nok"))
    expected = F.to_json(F.struct(F.struct("role", "turn").alias("x"), F.col("conv_id").alias("y")))
    swapped = F.to_json(F.struct(F.col("conv_id").alias("y"), F.struct("turn", "role").alias("x")))
    other = F.to_json(F.struct(F.struct("role", (F.col("turn") - F.col("turn") % 2).alias("turn")).alias("x"), F.col("conv_id").alias("y")))
    output = F.when(F.col("role") == "user", swapped).when(F.col("role") == "system", F.concat(expected, F.lit("}"))).otherwise(other)
    return grounding.json_accuracy(c.select(fenced(output).alias("output"), fenced(expected).alias("expected"))).withColumn("accuracy", F.round("accuracy", 9))


# --- decisions ------------------------------------------------------------------------------------


@query("k7_ambiguity", f"""WITH {_DENSE}, near AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM dense WHERE rank <= 20),
 named AS (SELECT query_id, query_label, label, min(rank) AS rank FROM near WHERE top - score <= 0.3 GROUP BY ALL),
 g AS (SELECT query_id, any_value(query_label) AS asked, count(*) AS n, string_agg('scan ' || label, '|' ORDER BY rank) AS options, bool_or(label = query_label) AS singled FROM named GROUP BY query_id)
 SELECT query_id, 'scan' AS category, options FROM g WHERE n >= 2 AND NOT (query_id % 200 = 0 AND singled)""")
def ambiguity(spark, sf_dir):
    """Labels stand for variants of a scan; every other query names its own label, which singles it out if it is an option."""
    named = _dense(spark, sf_dir, 20).join(vectors(spark, sf_dir).select("id", F.concat(F.lit("scan "), F.col("label").cast("string")).alias("name")), "id").withColumn("category", F.lit("scan"))
    asks = F.when(F.col("vec_id") % 200 == 0, F.concat(F.lit("price of scan "), F.col("label").cast("string"))).otherwise("price of a scan")
    q = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), asks.alias("resolved_query"))
    return decisions.ambiguity(named, q, 0.3).select("query_id", "category", F.array_join("options", "|").alias("options"))


@query("k8_specificity", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+$', '')) || ' zzyzx' END AS note FROM conversations WHERE text IS NOT NULL")
def specificity(spark, sf_dir):
    """Even turns were resolved to a text with a word more, odd ones to the same text."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    resolved = F.when(F.col("turn") % 2 == 0, F.concat(tx.stripped("text"), F.lit(" zzyzx"))).otherwise(F.concat(F.lit(" "), F.col("text")))
    return c.select("conv_id", "turn", decisions.specificity_note(F.col("text"), resolved).alias("note"))


@query("k24_outcomes", """WITH e AS (SELECT event_id, event_type, user_id, value FROM events)
 SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'text_pipeline' WHEN event_type = 'purchase' THEN 'booking' ELSE 'text_pipeline' END AS target,
  CASE WHEN event_type = 'purchase' THEN 'not_implemented' ELSE 'ai_handled' END AS routing_outcome,
  CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'inquiry' END AS intent,
  CASE WHEN user_id % 5 = 0 THEN 'clarification_requested' WHEN user_id % 5 = 1 THEN 'not_found' WHEN value < 10 THEN 'technical_error' WHEN user_id % 2 = 0 THEN 'escalated_verification' ELSE 'answered' END AS outcome_status,
  CASE WHEN user_id % 7 = 0 THEN 'fixed' WHEN event_type <> 'error' AND user_id % 3 <> 0 THEN 'k' || (user_id % 3) END AS topic FROM e""")
def outcomes(spark, sf_dir):
    """Event types stand for intents; a topic override wins over classification, which needs an outcome and a text."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    target = decisions.route(F.col("event_type"), {"view": "text_pipeline", "purchase": "booking"})
    kind = F.when(user % 5 == 1, "unavailable_everywhere").otherwise("normal")
    outcome = decisions.outcome_status(kind, user % 5 == 0, F.coalesce(F.col("value") >= 10, F.lit(True)), user % 2 != 0)
    topic = decisions.topic_of(F.when(user % 7 == 0, "fixed"), F.when(F.col("event_type") != "error", outcome), F.when(user % 3 == 0, " ").otherwise("text"), F.concat(F.lit("k"), (user % 3).cast("string")))
    return e.select("event_id", target.alias("target"), decisions.routing_outcome(target).alias("routing_outcome"), decisions.in_closed_set(F.col("event_type"), F.array(F.lit("click"), F.lit("view")), "inquiry").alias("intent"), outcome.alias("outcome_status"), topic.alias("topic"))


@query("k20_failures", r"""WITH n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT benchmark.text AS query, d.doc_id AS seq, d.text AS block FROM benchmark JOIN (SELECT doc_id, text, doc_id % n AS i FROM documents, n) d ON d.i = item_id WHERE item_id % 4 <> 3),
 last AS (SELECT query, max_by(block, seq) AS block, count(*) AS n FROM b GROUP BY query),
 r AS (SELECT item_id, text, item_id % 3 = 0 AND item_id % 2 = 0 AS apology, l.block, coalesce(l.n, 0) AS n,
   list_distinct(list_filter(regexp_extract_all(benchmark.text, '\p{L}+'), lambda t: len(t) >= 3)) AS wanted, list_filter(regexp_extract_all(coalesce(l.block, ''), '\p{L}+'), lambda t: len(t) >= 3) AS held
  FROM benchmark LEFT JOIN last l ON l.query = benchmark.text),
 x AS (SELECT *, block IS NOT NULL AND len(wanted) > 0 AND NOT list_has_any(wanted, held) AS unrelated FROM r)
 SELECT item_id, concat_ws(',', CASE WHEN apology THEN 'EMPTY_OR_APOLOGY' END, CASE WHEN unrelated THEN CASE WHEN contains(block, 'que') THEN 'KEYWORD_COLLISION_SUSPECTED' ELSE 'CONTEXT_TOPIC_MISMATCH' END END) AS failure_reasons,
  block IS NOT NULL AS context_available, CAST(n AS INTEGER) AS context_match_count, left(block, 1500) AS retrieved_context_snippet FROM x WHERE apology OR unrelated""")
def failures(spark, sf_dir):
    """Items ask, documents dealt to them are the logged contexts; every fourth item has none."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    dealt = docs.crossJoin(F.broadcast(n)).withColumn("i", F.col("doc_id") % F.col("n")).select("i", F.col("doc_id").alias("seq"), F.col("text").alias("block"))
    blocks = items.where("item_id % 4 <> 3").join(dealt, F.col("item_id") == F.col("i")).select(F.col("text").alias("query"), "seq", "block")
    records = items.select("item_id", F.col("text").alias("patient_query"), F.col("text").alias("expected_fact"), F.when(F.col("item_id") % 3 == 0, "{ }").otherwise('{"a": 1}').alias("debug_json"), F.when(F.col("item_id") % 2 == 0, evaluation.APOLOGIES[2]).otherwise("ok").alias("actual_reply"))
    out = evaluation.classify_failures(records, blocks, ("que",))
    return out.select("item_id", F.array_join("failure_reasons", ",").alias("failure_reasons"), "context_available", "context_match_count", "retrieved_context_snippet")


@query("k11_broad_gate", """WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag FROM lineitem),
 o AS (SELECT id, count(*) AS lines, count(DISTINCT flag) AS flags, list(qty) AS qtys FROM l GROUP BY id),
 x AS (SELECT id, lines > 4 AS short, flags > 1 AS differ, o_orderkey % 2 = 1 AND NOT list_contains(qtys, o_custkey) AS unheard FROM o JOIN orders ON o_orderkey = id)
 SELECT id, CASE WHEN short THEN 'source_count_mismatch' WHEN differ THEN 'wrong_source_attribution' WHEN unheard THEN 'unverified_numeric_claim' END AS rejection_reason, CASE WHEN short OR differ OR unheard THEN 'grounding' END AS rejection_stage, NOT (short OR differ OR unheard) AS accepted FROM x""")
def broad_gate(spark, sf_dir):
    """Orders answer from their lines: at most four are named, all with the first one's flag; odd orders also claim the customer's number."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    line = F.struct(F.row_number().over(w).alias("n"), F.col("l_quantity").cast("long").cast("string").alias("qty"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), line.alias("l")).groupBy("id").agg(F.sort_array(F.collect_list("l")).alias("l"))
    fields = lambda l, flag: F.create_map(F.lit("qty"), l["qty"], F.lit("flag"), flag)  # noqa: E731, E741
    sources = F.transform("l", lambda l: fields(l, l["flag"]))  # noqa: E741
    said = F.transform(F.slice("l", 1, 4), lambda l: F.struct(l["n"].alias("source"), fields(l, F.col("l")[0]["flag"]).alias("fields")))  # noqa: E741
    claim = F.when(F.col("id") % 2 == 1, F.concat(F.lit("It is "), F.col("o_custkey").cast("string"), F.lit("."))).otherwise("Yes.")
    records = lines.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("id")).select(
        "id", F.lit("broad").alias("grounding_type"), F.to_json(said).alias("output_json"), claim.alias("output_phrasing"), F.lit(None).cast("map<string,string>").alias("field_data"), sources.alias("sources"), F.lit(None).cast("string").alias("target_field"), F.lit(None).cast("array<string>").alias("conflicting_values"),
    )
    return grounding.check_records(records).select("id", "rejection_reason", "rejection_stage", "accepted")


@query("k11_negative_gates", """WITH x AS (SELECT conv_id, turn, role, turn % 3 = 2 AS told, conv_id % 2 = 1 AS claims, role = text AS same FROM conversations),
 r AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN told THEN 'non_empty_json_for_absence' WHEN claims THEN 'unverified_numeric_claim' END
  WHEN 'assistant' THEN CASE WHEN told THEN 'invented_value_for_missing_field' WHEN claims THEN 'unverified_numeric_claim' END
  WHEN 'system' THEN CASE WHEN told THEN 'non_empty_json_for_ambiguous' WHEN same THEN 'ambiguous_premise_invalid' WHEN claims THEN 'unverified_numeric_claim' END ELSE 'unknown_grounding_type' END AS rejection_reason FROM x)
 SELECT conv_id, turn, rejection_reason, rejection_reason IS NULL AS accepted FROM r""")
def negative_gates(spark, sf_dir):
    """Roles stand for the kinds of records that must not answer; every third turn answers, odd conversations claim a number."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "absence").when(F.col("role") == "assistant", "ambiguous_direct").when(F.col("role") == "system", "ambiguous_cross_chunk").otherwise("other")
    json = F.when(F.col("turn") % 3 == 2, '{"price": "7"}').when((F.col("turn") % 3 == 1) & (F.col("role") != "assistant"), "[ ]").otherwise("{}")
    records = c.select(
        "conv_id", "turn", kind.alias("grounding_type"), json.alias("output_json"), F.when(F.col("conv_id") % 2 == 1, "It costs 4321.").otherwise("We don't know.").alias("output_phrasing"), F.lit(None).cast("map<string,string>").alias("field_data"),
        F.lit(None).cast("array<map<string,string>>").alias("sources"), F.lit("price").alias("target_field"), F.array("role", "text").alias("conflicting_values"),
    )
    return grounding.check_records(records).select("conv_id", "turn", "rejection_reason", "accepted")


# --- curation -------------------------------------------------------------------------------------


@query("c6_resolved_ids", "SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_orderkey END AS custom_id FROM lineitem UNION SELECT o_custkey FROM orders")
def resolved_ids(spark, sf_dir):
    """Lines with an even number name the hypothesis that they come from."""
    a = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("source_hypothesis_custom_id"), F.col("l_orderkey").alias("custom_id"))
    b = table(spark, sf_dir, "orders").select(F.lit(None).cast("long").alias("source_hypothesis_custom_id"), F.col("o_custkey").alias("custom_id"))
    return curation.resolved_ids(a, b)


@query("c7_hypotheses", """WITH h AS (SELECT p_partkey AS id, p_type AS type, p_size AS size, p_partkey + p_partkey % 4 AS top FROM part),
 x AS (SELECT h.id, t.p_partkey AS top, h.type = t.p_type AS same_type, h.size = t.p_size AS same_size, h.id % 5 = 0 AS with_size, t.p_partkey % 7 = 0 AS lacks FROM h LEFT JOIN part t ON t.p_partkey = h.top)
 SELECT id AS custom_id, CASE WHEN top IS NULL THEN 'discarded' WHEN top = id THEN 'confirmed' WHEN same_type AND (NOT with_size OR (NOT lacks AND same_size)) THEN 'reattributed' WHEN NOT with_size OR NOT lacks THEN 'needs_correction' ELSE 'discarded' END AS decision FROM x""")
def hypotheses(spark, sf_dir):
    """A part's fields are an answer, and the part up to three places on is what retrieval found first."""
    p = part_chunks(spark, sf_dir).withColumn("all", F.map_from_entries("fields"))
    whole = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size"))
    answer = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("type"), F.col("all")["type"], F.lit("size"), F.col("size"))).otherwise(F.create_map(F.lit("type"), F.concat(F.lit(" "), F.col("all")["type"])))
    asked = p.join(whole, "id").select(F.col("id").alias("custom_id"), F.col("id").alias("source_id"), answer.alias("answer"))
    found = asked.select("custom_id", (F.col("source_id") + F.col("source_id") % 4).alias("id"))
    top = found.join(p.select("id", F.col("all").alias("fields")), "id").select("custom_id", "id", "fields")
    return curation.classify_hypotheses(asked, top).select("custom_id", "decision")


@query("c8_with_requests", "SELECT l_orderkey AS custom_id, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0")
def with_requests(spark, sf_dir):
    """Lines are results, orders requests; every third order's request is unknown."""
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("custom_id"), "l_linenumber")
    return curation.with_requests(results, table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("custom_id"), "o_orderpriority"))


# --- mixed replies of models ----------------------------------------------------------------------

_REPLY = """SELECT conv_id, turn, role, text, '{"r": "' || role || ' }", "n": ' || turn || '}' AS json FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '[{}\\[\\]`#]')"""


def _replies(spark, sf_dir):
    """Conversation texts without brackets, each with an object that holds a closing bracket in a string."""
    json = F.concat(F.lit('{"r": "'), F.col("role"), F.lit(' }", "n": '), F.col("turn").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "conversations").where("text is not null").where(~F.col("text").rlike(r"[{}\[\]`#]")).withColumn("json", json)


@query("h29_first_json", f"WITH r AS ({_REPLY}) SELECT conv_id, turn, json, CAST(CASE WHEN turn % 2 = 0 THEN len(text) + len(json) ELSE len(text) + len('```json') + len(json) + 2 + len('```') END AS INTEGER) AS json_end FROM r")
def first_json(spark, sf_dir):
    """Even turns have a bare object behind their text, odd ones a fenced one."""
    r = _replies(spark, sf_dir)
    reply = F.when(F.col("turn") % 2 == 0, F.concat("text", "json", F.lit(" ]{ tail"))).otherwise(F.concat("text", F.lit("```json\n"), "json", F.lit("\n```"), F.lit("{}")))
    return r.withColumn("f", tx.first_json(reply)).select("conv_id", "turn", F.col("f.json").alias("json"), F.col("f.end").alias("json_end"))


@query("h30_sections", f"WITH r AS ({_REPLY}) SELECT conv_id, turn, regexp_replace(text, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g') AS question, json FROM r")
def sections(spark, sf_dir):
    r = _replies(spark, sf_dir)
    whole = F.concat(F.lit("x\n## PATIENT QUESTION:\n"), "text", F.lit("\n## JSON: "), "json", F.lit("\n"))
    return r.select("conv_id", "turn", tx.section(whole, "PATIENT QUESTION").alias("question"), tx.section(whole, "JSON").alias("json"))


@query("h31_last_object", f"WITH r AS ({_REPLY}) SELECT conv_id, turn, CAST(turn AS VARCHAR) AS n FROM r")
def last_object(spark, sf_dir):
    """Of two flat objects the last counts."""
    r = _replies(spark, sf_dir)
    flat = F.concat("text", F.lit('{"n": -1} and {"n": '), F.col("turn").cast("string"), F.lit("} so"))
    return r.select("conv_id", "turn", F.try_element_at(tx.last_object(flat), F.lit("n")).alias("n"))


@query("h32_empty_json", "SELECT conv_id, turn, turn % 5 IN (0, 1, 2) AS is_empty FROM conversations")
def empty_json(spark, sf_dir):
    json = F.when(F.col("turn") % 5 == 0, "{}").when(F.col("turn") % 5 == 1, "[]").when(F.col("turn") % 5 == 2, '[{"source": 1, "fields": {}}]').when(F.col("turn") % 5 == 3, '[{"source": 1, "fields": {"a": "b"}}]')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.json_is_empty(json).alias("is_empty"))


# --- session states -------------------------------------------------------------------------------

_STATES = """WITH m AS (SELECT 'c' || (user_id % 3) AS client_id, CAST(user_id AS VARCHAR) AS session_id, ts, event_id AS ord, event_type AS content, CASE event_type WHEN 'click' THEN 'all' WHEN 'purchase' THEN 'a' WHEN 'signup' THEN 'b' END AS f FROM events),
 g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY client_id, session_id ORDER BY ts, ord) >= 86400 THEN 1 ELSE 0 END AS gap FROM m),
 k AS (SELECT *, sum(gap) OVER (PARTITION BY client_id, session_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS k FROM g),
 l AS (SELECT *, row_number() OVER (PARTITION BY client_id, session_id ORDER BY ts DESC, ord DESC) AS nth, max(k) OVER (PARTITION BY client_id, session_id) AS last FROM k)
 SELECT client_id, session_id, max(ts) AS ts, nullif(arg_max(f, (ts, ord)) FILTER (WHERE f IS NOT NULL), 'all') AS brand_filter, string_agg(ord || '=' || content, '|' ORDER BY ts, ord) FILTER (WHERE nth <= 6) AS turns
 FROM l WHERE k = last GROUP BY client_id, session_id"""


def _messages(events):
    kind = F.col("event_type")
    brand = F.when(kind == "click", "all").when(kind == "purchase", "a").when(kind == "signup", "b")
    return events.select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), F.lit("user").alias("role"), kind.alias("content"), brand.alias("brand_filter"))


def _told(states):
    turns = F.array_join(F.transform("turns", lambda t: F.concat_ws("=", t["ord"].cast("string"), t["content"])), "|")
    return states.select("client_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "brand_filter", turns.alias("turns"))


@query("i1_session_states", _STATES)
def session_states(spark, sf_dir):
    return _told(stateful.session_fold(_messages(table(spark, sf_dir, "events"))))


@query("i1_session_stream", _STATES)
def session_stream(spark, sf_dir):
    """The same states, kept by a stream that reads the events and ends; of a session's rows the last before its end counts."""
    folder = stored.fresh(spark, "session-stream")
    events = table(spark, sf_dir, "events")
    states = stateful.session_states(_messages(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")))  # a pattern, as a stream takes no single file
    stateful.started(states, lambda batch, n: batch.where("not expired").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint", partitions=max(8, events.count() // 100_000)).awaitTermination()
    rows = spark.read.option("mergeSchema", "false").schema("client_id string, session_id string, ts timestamp, brand_filter string, turns array<struct<at:timestamp,ord:long,role:string,content:string>>, expired boolean, batch int").parquet(f"{folder}/out")
    last = F.max_by(F.struct("ts", "brand_filter", "turns"), F.struct("batch", "ts")).alias("s")
    return _told(rows.groupBy("client_id", "session_id").agg(last).select("client_id", "session_id", "s.*"))
