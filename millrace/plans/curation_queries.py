"""Queries of ingest and dataset curation over parts, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import analytics, curation, grounding, ingest, retrieval
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import _DENSE
from millrace.tables import PART_SQL, dense_queries, part_chunks, table, vectors

_ALIAS = "CASE WHEN lower(trim(value)) = 'yes' THEN 'Y' END"


def _staging(spark, sf_dir):
    return part_chunks(spark, sf_dir).select("client_id", F.lit("catalog.xlsx").alias("source_file"), "sheet_name", F.col("id").alias("ord"), "fields")


@query("k1_chunk_rows", f"""WITH {PART_SQL}, cols AS (SELECT sheet_name, label, min(id * 10 + ord) AS place FROM fields GROUP BY ALL),
 kept AS (SELECT f.*, c.place FROM fields f JOIN cols c USING (sheet_name, label) WHERE trim(f.value) <> '')
 SELECT 'chunk-' || substr(sha1('c0|catalog.xlsx|' || sheet_name || '|' || id), 1, 20) AS id, '[Document: catalog] ' || string_agg(label || ': ' || value, '. ' ORDER BY place) AS content, sheet_name AS chunk_type, max({_ALIAS}) AS brand
 FROM kept GROUP BY sheet_name, kept.id""")
def chunk_rows(spark, sf_dir):
    staging = _staging(spark, sf_dir)
    registry = spark.createDataFrame([], "client_id string, sheet_name string, columns array<string>, mandatory_fields array<string>")
    config = spark.createDataFrame([("c0", {"YES ": "Y"})], "client_id string, brand_value_aliases map<string,string>")
    return ingest.chunk_rows(staging, registry, config).select("id", "content", "chunk_type", F.col("metadata.brand").alias("brand"))


@query("k1_registered_rows", f"""WITH {PART_SQL}, c AS (SELECT sheet_name, label, CASE WHEN sheet_name LIKE 'Brand#1%' THEN CASE label WHEN 'code' THEN 1 WHEN 'size' THEN 2 WHEN 'name' THEN 3 END ELSE min(id * 10 + ord) END AS place FROM fields GROUP BY sheet_name, label)
 SELECT 'c0' AS client_id, sheet_name AS chunk_type, '[Document: catalog] ' || string_agg(label || ': ' || value, '. ' ORDER BY place) AS content FROM fields JOIN c USING (sheet_name, label) WHERE place IS NOT NULL GROUP BY sheet_name, fields.id""")
def registered_rows(spark, sf_dir):
    """Sheets of one kind have registered columns, in another order, one of which no row has; the others' are inferred."""
    staging = _staging(spark, sf_dir)
    registry = staging.where("sheet_name like 'Brand#1%'").select("client_id", "sheet_name").distinct().select("*", F.array(*[F.lit(c) for c in ("code", "size", "nowhere", "name")]).alias("columns"), F.lit(None).cast("array<string>").alias("mandatory_fields"))
    config = spark.createDataFrame([], "client_id string, brand_value_aliases map<string,string>")
    return ingest.chunk_rows(staging, registry, config).select("client_id", "chunk_type", "content")


@query("b8_inferred_columns", f"WITH {PART_SQL}, c AS (SELECT sheet_name, label, min(id * 10 + ord) AS place FROM fields GROUP BY ALL) SELECT 'c0' AS client_id, sheet_name, string_agg(label, ',' ORDER BY place) AS columns FROM c GROUP BY sheet_name")
def inferred(spark, sf_dir):
    return ingest.inferred_columns(_staging(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


@query("b5_missing_mandatory", f"WITH {PART_SQL}, s AS (SELECT DISTINCT sheet_name, id FROM fields), h AS (SELECT s.id, s.sheet_name FROM s WHERE id % 7 = 0) SELECT 'c0' AS client_id, CAST(id AS VARCHAR) AS source_file, sheet_name, 'size' AS missing FROM h")
def missing_mandatory(spark, sf_dir):
    """Each part is a one-row sheet of its own file; size is mandatory."""
    sheets = part_chunks(spark, sf_dir).select("client_id", F.col("id").cast("string").alias("source_file"), "sheet_name", F.transform("fields", lambda f: f["key"]).alias("columns"))
    registry = sheets.select("client_id", "sheet_name").distinct().withColumn("mandatory_fields", F.array(F.lit("name"), F.lit("size")))
    return ingest.missing_mandatory(sheets, registry).withColumn("missing", F.array_join("missing", ","))


@query("a12_upsert", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.5")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return ingest.upserted(old, new.union(spark.createDataFrame([(-1, "new", 1.5)], new.schema)), "c_custkey")


@query("a14_replace", "SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id + 1000000, source, 0 FROM documents WHERE source = 'src1'")
def replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = d.where("source = 'src1'").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "source", F.lit(0).cast("long").alias("n_chars"))
    return ingest.replaced(d, new, ("source",))


@query("a16_stale_files", "SELECT DISTINCT lang AS client_id, source AS source_file FROM documents WHERE source NOT IN ('src1', 'src2')")
def stale(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("client_id"), F.col("source").alias("source_file"))
    return ingest.stale_files([d, d], d.where("source_file in ('src1', 'src2')").distinct())


@query("d5_source_files", "SELECT DISTINCT lang AS client_id, source AS source_file FROM documents WHERE source IS NOT NULL")
def files(spark, sf_dir):
    return ingest.source_files(table(spark, sf_dir, "documents").select(F.col("lang").alias("client_id"), F.col("source").alias("source_file")))


@query("d9_boilerplate_labels", f"WITH {PART_SQL} SELECT 'c0' AS client_id, label, count(*) AS n, round(count(DISTINCT value)::DOUBLE / count(*), 9) AS distinct_ratio FROM fields GROUP BY label HAVING count(*) >= 20 AND count(DISTINCT value)::DOUBLE / count(*) <= 0.08")
def boilerplate(spark, sf_dir):
    return curation.boilerplate_labels(part_chunks(spark, sf_dir)).withColumn("distinct_ratio", F.round("distinct_ratio", 9))


@query("d10_conflicts", f"""WITH {PART_SQL}, v AS (SELECT label, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value, min(id) AS id FROM fields GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id, value) AS n FROM v)
 SELECT label, string_agg(value, '|' ORDER BY n) AS values, string_agg(CAST(id AS VARCHAR), '|' ORDER BY n) AS ids FROM r WHERE n <= 2 GROUP BY label HAVING count(*) = 2""")
def conflicts(spark, sf_dir):
    x = curation.conflicts(part_chunks(spark, sf_dir))
    return x.select("label", F.array_join("values", "|").alias("values"), F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"))


@query("d11_taxonomy", f"WITH {PART_SQL} SELECT DISTINCT 'c0' AS client_id, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS topic FROM fields WHERE label LIKE 'na%' AND trim(value) <> ''")
def taxonomy(spark, sf_dir):
    return curation.taxonomy(part_chunks(spark, sf_dir), "na")


@query("c13_missing_fields", f"WITH {PART_SQL}, m AS (SELECT p_partkey AS id, 'size' AS label FROM part WHERE p_partkey % 7 = 0 AND p_brand IN (SELECT sheet_name FROM fields WHERE label = 'size')) SELECT 'c0' AS client_id, id, label FROM m")
def missing_fields(spark, sf_dir):
    return curation.missing_fields(part_chunks(spark, sf_dir))


@query("e7_per_group", "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha1('1|' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, lang, source FROM r WHERE n <= 3")
def per_group(spark, sf_dir):
    return curation.per_group(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 3, 1, "lang", "source", id_col="doc_id")


_RECORDS = "records AS (SELECT doc_id AS ord, lang AS pass, 'q' || (doc_id % 50) AS instruction, source AS input, '{\"a\": \"' || (doc_id % 3) || '\", \"b\": \"' || (doc_id % 2) || '\"}' AS output_json, 'p' || (doc_id % 4) AS output_phrasing FROM documents)"


def _records(spark, sf_dir):
    """documents as training records; key order of the JSON varies."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    a, b = F.concat(F.lit('"a": "'), (i % 3).cast("string"), F.lit('"')), F.concat(F.lit('"b": "'), (i % 2).cast("string"), F.lit('"'))
    json = F.concat(F.lit("{"), F.when(i % 5 == 0, F.concat_ws(", ", b, a)).otherwise(F.concat_ws(", ", a, b)), F.lit("}"))
    return d.select(i.alias("ord"), F.col("lang").alias("pass"), F.concat(F.lit("q"), (i % 50).cast("string")).alias("instruction"), F.col("source").alias("input"), json.alias("output_json"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("output_phrasing"))


@query("k12_dedup", f"WITH {_RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY instruction, input ORDER BY ord) AS n FROM records) SELECT ord, pass, instruction, input FROM r WHERE n = 1")
def dedup(spark, sf_dir):
    return curation.dedup_records(_records(spark, sf_dir)).select("ord", "pass", "instruction", "input")


@query("k12_dedup_report", f"""WITH {_RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY instruction, input ORDER BY ord) AS p, row_number() OVER (PARTITION BY instruction, input, output_json, output_phrasing ORDER BY ord) AS e FROM records)
 SELECT count(*) AS input, count(*) FILTER (WHERE e > 1) AS exact_duplicates_dropped, count(*) FILTER (WHERE e = 1 AND p > 1) AS near_twin_duplicates_dropped, count(*) FILTER (WHERE p = 1) AS output FROM r""")
def dedup_report(spark, sf_dir):
    return curation.dedup_report(_records(spark, sf_dir))


@query("k13_split", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('101|' || doc_id), doc_id) AS k FROM documents)
 SELECT doc_id, lang, CASE WHEN k <= CASE WHEN n >= 20 THEN round_even(n * 0.05, 0) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM r JOIN n USING (lang)""")
def split(spark, sf_dir):
    return curation.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("k14_alpaca", f"""WITH {_RECORDS}, j AS (SELECT *, '"a": "' || (ord % 3) || '"' AS a, '"b": "' || (ord % 2) || '"' AS b FROM records)
 SELECT 's' AS system, 'CONTEXT:' || chr(10) || input AS instruction, 'PATIENT MESSAGE:' || chr(10) || instruction AS input,
  '```json' || chr(10) || '{{' || CASE WHEN ord % 5 = 0 THEN b || ', ' || a ELSE a || ', ' || b END || '}}' || chr(10) || '```' || chr(10) || chr(10) || 'p' || (ord % 4) AS output, 0 AS n_history, 'p' || (ord % 4) AS phrasing FROM j""")
def alpaca(spark, sf_dir):
    """Records in the instruction format, and the phrasing as it is read back from the output."""
    out = curation.alpaca(_records(spark, sf_dir), "s")
    return out.select("system", "instruction", "input", "output", F.size("history").alias("n_history"), tx.phrasing(F.col("output")).alias("phrasing"))


@query("k11_record_gate", f"""WITH {PART_SQL}, one AS (SELECT p_partkey AS id, p_size, p_type FROM part)
 SELECT id, CASE WHEN id % 5 = 0 THEN 'invented_key' WHEN id % 5 = 1 THEN 'value_mismatch' WHEN id % 5 = 2 THEN 'unverified_numeric_claim' WHEN id % 5 = 3 THEN 'output_json_not_a_dict' END AS rejection_reason,
  CASE WHEN id % 5 = 3 THEN 'structural' WHEN id % 5 < 3 THEN 'grounding' END AS rejection_stage, id % 5 = 4 AS accepted FROM one""")
def record_gate(spark, sf_dir):
    return grounding.check_records(_narrow(spark, sf_dir)).select("id", "rejection_reason", "rejection_stage", "accepted")


def _narrow(spark, sf_dir):
    """Narrow training records over part, one of each verdict in five."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    case = lambda *v: F.element_at(F.array(*v), (i % 5 + 1).cast("int"))
    pair = lambda k, v: F.concat(F.lit(f'{{"{k}": "'), v, F.lit('"}'))
    size = F.col("p_size").cast("string")
    empty = F.lit(None)
    return p.select(
        i.alias("id"), F.when(i % 2 == 0, "even").otherwise("odd").alias("pass"), F.lit("narrow").alias("grounding_type"),
        case(pair("colour", size), pair("size", F.lit("none")), pair("size", size), F.lit("[]"), pair("size", size)).alias("output_json"),
        case(F.lit("x"), F.lit("x"), F.lit("It is 99999."), F.lit("x"), F.concat(F.lit("It is "), size, F.lit(". Is it 7777?"))).alias("output_phrasing"),
        F.create_map(F.lit("size"), size, F.lit("type"), F.col("p_type")).alias("field_data"), empty.cast("array<map<string,string>>").alias("sources"), empty.cast("string").alias("target_field"), empty.cast("array<string>").alias("conflicting_values"),
    )


@query("d12_gate_report", """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS pass, count(*) AS generated, count(*) FILTER (WHERE p_partkey % 5 = 4) AS accepted, count(*) FILTER (WHERE p_partkey % 5 <> 4) AS rejected,
 round(count(*) FILTER (WHERE p_partkey % 5 = 4) / count(*)::DOUBLE * 100.0, 2) AS pass_rate FROM part GROUP BY 1""")
def gate_report(spark, sf_dir):
    return analytics.gate_report(grounding.check_records(_narrow(spark, sf_dir)))


@query("k19_grading", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'PASS' WHEN p_partkey % 3 = 1 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END AS verdict FROM part")
def grading(spark, sf_dir):
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    json = F.when(i % 3 == 0, F.concat(F.lit('{"the size": "'), size, F.lit('"}'))).when(i % 3 == 1, F.lit('{"size": "none"}')).otherwise(F.lit('{"colour": "red"}'))
    cases = table(spark, sf_dir, "part").select(i.alias("id"), F.concat(F.lit("[Document: x] size: "), size).alias("expected_fact"), json.alias("debug_json"))
    return grounding.grade(cases).select("id", "verdict")


@query("k15_narrow_pass", f"""WITH {PART_SQL}, b AS (SELECT label FROM fields GROUP BY label HAVING count(*) >= 20 AND count(DISTINCT value)::DOUBLE / count(*) <= 0.08),
 u AS (SELECT * FROM fields WHERE trim(value) <> '' AND label NOT IN (SELECT label FROM b)),
 p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('1|' || id), id) AS n FROM u),
 x AS (SELECT p.id, p.label, min_by(o.label, o.ord) AS other FROM p LEFT JOIN u o ON o.id = p.id AND o.label <> p.label WHERE p.n <= 3 GROUP BY ALL),
 y AS (SELECT id, CASE WHEN other IS NOT NULL AND CAST('0x' || substr(sha1('2|' || id || '|' || label), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.4 THEN label || ',' || other ELSE label END AS labels FROM x)
 SELECT 'narrow-' || substr(sha1('c0|' || id || '|' || labels), 1, 20) AS custom_id, 'c0' AS client_id, id, labels FROM y""")
def narrow_pass(spark, sf_dir):
    """Seeded sample of field questions."""
    done = spark.createDataFrame([], "custom_id string")
    return curation.narrow_pass(part_chunks(spark, sf_dir), done).withColumn("labels", F.array_join("labels", ","))


@query("k16_broad_pass", f"""WITH {_DENSE}, g AS (SELECT 'c' || (query_id // 100 % 2) AS client_id, query_id AS probe_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM dense WHERE rank <= 5 GROUP BY query_id HAVING count(*) >= 2),
 r AS (SELECT 'broad-' || substr(sha1(client_id || '|' || ids), 1, 20) AS custom_id, *, row_number() OVER (PARTITION BY client_id, ids ORDER BY probe_id) AS n FROM g)
 SELECT custom_id, client_id, probe_id, ids FROM r WHERE n = 1""")
def broad_pass(spark, sf_dir):
    """Every vector whose id is divisible by 100 is a probe; its first five results are its sources."""
    top = retrieval.dense_top_k(dense_queries(spark, sf_dir), vectors(spark, sf_dir), 5)
    probes = top.select(F.concat(F.lit("c"), F.expr("query_id div 100 % 2").cast("string")).alias("client_id"), F.col("query_id").alias("probe_id"), "id")
    done = spark.createDataFrame([], "custom_id string")
    return curation.broad_pass(probes, done).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("k17_absence_pass", """WITH q AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY sha1('31|' || p_partkey), p_partkey) AS n FROM part), c AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY sha1('32|' || p_partkey), p_partkey) AS n FROM part),
 p AS (SELECT q.n, q.id AS question_id, CASE WHEN c.id = q.id THEN s.id ELSE c.id END AS id FROM q JOIN c ON c.n = q.n LEFT JOIN c s ON s.n = q.n + 120 AND s.n <= 240 WHERE q.n <= 120),
 k AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM p WHERE id IS NOT NULL)
 SELECT 'absence-' || substr(sha1('c0|' || question_id || '|' || id), 1, 20) AS custom_id, 'c0' AS client_id, question_id, id FROM k WHERE k <= 60""")
def absence_pass(spark, sf_dir):
    """Questions with chunks that aren't theirs."""
    chunks = part_chunks(spark, sf_dir)
    q = table(spark, sf_dir, "part").select(F.lit("c0").alias("client_id"), F.col("p_partkey").alias("question_id"), F.col("p_partkey").alias("source_id"))
    return curation.absence_pass(q, chunks, spark.createDataFrame([], "custom_id string"))


@query("k18_ambiguous_pass", f"""WITH {PART_SQL}, lacks AS (SELECT s.id, l.label FROM (SELECT DISTINCT id, sheet_name FROM rows) s JOIN (SELECT DISTINCT sheet_name, label FROM fields) l USING (sheet_name) ANTI JOIN fields f ON f.id = s.id AND f.label = l.label),
 m AS (SELECT *, row_number() OVER (ORDER BY sha1('4|' || id || '|' || label)) AS k FROM lacks),
 v AS (SELECT label, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value, min(id) AS id FROM fields GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id, value) AS n FROM v),
 t AS (SELECT label, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS ids FROM r WHERE n <= 2 GROUP BY label HAVING count(*) = 2), x AS (SELECT *, row_number() OVER (ORDER BY sha1('4|' || label)) AS k FROM t)
 SELECT 'missing-' || substr(sha1('c0|' || id || '|' || label), 1, 20) AS custom_id, 'c0' AS client_id, 'ambiguous_direct' AS grounding_type, label, CAST(id AS VARCHAR) AS ids FROM m WHERE k <= 30
 UNION ALL SELECT 'conflict-' || substr(sha1('c0|' || label), 1, 20), 'c0', 'ambiguous_cross_chunk', label, ids FROM x WHERE k <= 20""")
def ambiguous_pass(spark, sf_dir):
    done = spark.createDataFrame([], "custom_id string")
    return curation.ambiguous_pass(part_chunks(spark, sf_dir), done).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("c5_not_done", "SELECT doc_id AS custom_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_done(spark, sf_dir):
    d, done = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return curation.not_done(d.select(F.col("doc_id").alias("custom_id")), done.select(F.col("doc_id").alias("custom_id")))
