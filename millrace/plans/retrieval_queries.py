"""Queries over vectors and texts: legs, fusion, accuracy and decisions about ranked results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import stored
from millrace.operators import cells, decisions, postings, retrieval
from millrace.plans.registry import query
from millrace.tables import dense_queries, table, text_chunks, text_queries, vectors

_DENSE = """pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label AS query_label, e.label, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pairs)"""
_WORD = "[\\p{L}\\p{N}_]+"
_SPARSE = f"""q AS (SELECT item_id AS query_id, text AS t FROM benchmark),
terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(t), '{_WORD}'))) AS term FROM q),
wanted AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY query_id),
words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents),
freq AS (SELECT id, term, count(*) AS f FROM words GROUP BY id, term),
hits AS (SELECT t.query_id, f.id, count(*) AS n, sum(f.f)::DOUBLE AS score FROM terms t JOIN freq f USING (term) GROUP BY t.query_id, f.id),
sparse AS (SELECT h.query_id, h.id, h.score, CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id) AS INTEGER) AS rank FROM hits h JOIN wanted w USING (query_id) WHERE h.n = w.n_terms)"""
_FUSED = """legs AS (SELECT query_id, id, rank AS d, NULL::INTEGER AS s FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, id, NULL, rank FROM sparse WHERE rank <= 20),
fused AS (SELECT query_id, id, min(d) AS dense_rank, min(s) AS sparse_rank FROM legs GROUP BY query_id, id),
scored AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0.0), 9) AS score FROM fused),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS INTEGER) AS rank FROM scored)"""


def _dense(spark, sf_dir, k):
    return retrieval.dense_top_k(dense_queries(spark, sf_dir), vectors(spark, sf_dir), k)


@query("f1_dense_top_k", f"WITH {_DENSE} SELECT query_id, id, score, rank FROM dense WHERE rank <= 20")
def dense(spark, sf_dir):
    return _dense(spark, sf_dir, 20)


@query("f1_cells_top_k")
def cells_top_k(spark, sf_dir):
    """Approximate: `f1_cells_recall` measures it against exact search."""
    index = stored.once(spark, "cells", sf_dir, lambda path: cells.write_cells(vectors(spark, sf_dir), path))
    return cells.search_cells(spark, index, dense_queries(spark, sf_dir), 20)


@query("f1_cells_recall", "SELECT count(*) AS query_count, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0")
def cells_recall(spark, sf_dir):
    """Does approximate search find 0.9 of the exact neighbours of all vectors whose id is divisible by 100?"""
    found = cells.recall(cells_top_k(spark, sf_dir), _dense(spark, sf_dir, 20), 20)
    return found.select("query_count", (F.col("recall") >= 0.9).alias("reached"))


def _indexed(spark, sf_dir, cover_density):
    """Answered from posting blocks that the first query of an application writes."""
    index = stored.once(spark, "postings", sf_dir, lambda path: postings.write_postings(text_chunks(spark, sf_dir), path))
    return postings.search_postings(spark, index, text_queries(spark, sf_dir), 20, cover_density)


@query("f2_lexical_top_k", f"WITH {_SPARSE} SELECT query_id, id, score, rank FROM sparse WHERE rank <= 20")
def lexical(spark, sf_dir):
    return _indexed(spark, sf_dir, False)


@query("f2_full_text_top_k")
def full_text(spark, sf_dir):
    """Ranked by cover density; tests compare with an enumeration of the covers."""
    return _indexed(spark, sf_dir, True)


@query("f3_hybrid_rrf", f"WITH {_DENSE}, {_SPARSE}, {_FUSED} SELECT query_id, id, score, dense_rank, sparse_rank, rank FROM ranked WHERE rank <= 5")
def hybrid(spark, sf_dir):
    """The vectors' and documents' ids are merged as one id space, as a synthetic convention."""
    fused = retrieval.reciprocal_rank_fusion(_dense(spark, sf_dir, 20), lexical(spark, sf_dir))
    return retrieval.top_per_query(fused, 5, F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("id"))


@query("d6_top_k_accuracy", f"""WITH {_DENSE}, other AS (SELECT * FROM dense WHERE id <> query_id), best AS (SELECT query_id, min_by(id, rank) AS expected_id FROM other WHERE label = query_label GROUP BY query_id),
 ranks AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM other)
 SELECT 'dot' AS model, round(avg(CASE WHEN r.id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS top_k_accuracy, count(*) AS query_count, 5 AS top_k, CAST(NULL AS VARCHAR) AS error_message
 FROM best b LEFT JOIN ranks r ON b.query_id = r.query_id AND b.expected_id = r.id AND r.rank <= 5""")
def accuracy(spark, sf_dir):
    """Is the nearest other vector of the query's own label among the first five others?"""
    q = dense_queries(spark, sf_dir)
    expected = retrieval.nearest_other(q.withColumnRenamed("query_label", "label"), vectors(spark, sf_dir), on=("label",))
    near = retrieval.dense_top_k(q, vectors(spark, sf_dir), 6).where(F.col("id") != F.col("query_id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = near.withColumn("rank", order).withColumn("model", F.lit("dot"))
    out = retrieval.top_k_accuracy(ranked, expected, 5)
    return out.withColumn("top_k_accuracy", F.round("top_k_accuracy", 9))


@query("e4_breadth", f"""WITH {_DENSE}, t AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2 FROM dense WHERE rank <= 2 GROUP BY query_id)
 SELECT *, CASE WHEN s2 IS NULL OR (s1 >= 0.0 AND s1 - s2 >= 0.3) THEN 'narrow' ELSE 'broad' END AS breadth FROM t""")
def breadth(spark, sf_dir):
    return decisions.breadth(_dense(spark, sf_dir, 5))


@query("e5_within_gap", f"WITH {_DENSE}, t AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM dense WHERE rank <= 20) SELECT query_id, id, score, rank FROM t WHERE top - score <= 0.5")
def within_gap(spark, sf_dir):
    return decisions.within_gap(_dense(spark, sf_dir, 20), 0.5)


@query("e6_first_by_name", f"WITH {_DENSE}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM dense WHERE rank <= 20) SELECT query_id, id, score, rank, CAST(label AS VARCHAR) AS name FROM t WHERE n = 1")
def first_by_name(spark, sf_dir):
    named = _dense(spark, sf_dir, 20).join(vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("name")), "id")
    return decisions.first_by_name(named)


@query("k6_availability", f"""WITH {_DENSE}, asked AS (SELECT DISTINCT query_id, query_label % 3 AS partition FROM pairs),
 f AS (SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY d.score DESC, d.id) AS fr FROM dense d JOIN asked a USING (query_id) WHERE d.label % 3 = a.partition AND d.id % 4 = 0),
 usable AS (SELECT query_id, id % 8 <> 0 AS usable FROM f WHERE fr = 1),
 alt AS (SELECT d.query_id, min_by(d.id, d.rank) AS id, min_by(d.label % 3, d.rank) AS partition FROM dense d JOIN asked a USING (query_id) WHERE d.rank <= 20 AND d.label % 3 <> a.partition AND d.id % 8 <> 0 GROUP BY d.query_id)
 SELECT a.query_id, CASE WHEN u.usable THEN 'normal' WHEN x.id IS NOT NULL THEN 'unavailable_here' ELSE 'unavailable_everywhere' END AS availability,
  CASE WHEN coalesce(u.usable, FALSE) THEN NULL ELSE x.id END AS id, CASE WHEN coalesce(u.usable, FALSE) THEN NULL ELSE x.partition END AS partition
 FROM asked a LEFT JOIN usable u USING (query_id) LEFT JOIN alt x USING (query_id)""")
def availability(spark, sf_dir):
    """Labels modulo 3 are partitions; every eighth vector stands for a placeholder row of equal values."""
    values = F.when(F.col("id") % 8 == 0, F.array(*[F.lit("x")] * 5)).otherwise(F.array(*[F.lit(str(i)) for i in range(5)]))
    rows = vectors(spark, sf_dir).withColumn("partition", F.col("label") % 3).withColumn("values", values)
    q = dense_queries(spark, sf_dir).withColumn("partition", F.col("query_label") % 3)
    side = rows.select("id", "partition", "values")
    filtered = retrieval.dense_top_k(q, rows.where("id % 4 = 0"), 5, on=("partition",)).join(side, "id")
    return decisions.availability(q.select("query_id", "partition"), filtered, _dense(spark, sf_dir, 20).join(side, "id"))


@query("c10_compare_rankings", f"""WITH {_DENSE}, a AS (SELECT * FROM dense WHERE rank <= 10), b AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score * (1 + id % 3), 9) DESC, id) AS INTEGER) AS rank, round(score * (1 + id % 3), 9) AS score FROM a)
 SELECT a.query_id, a.id, a.rank AS rank_a, a.score AS score_a, b.rank AS rank_b, b.score AS score_b, a.rank - b.rank AS move FROM a JOIN b ON a.query_id = b.query_id AND a.id = b.id""")
def compare(spark, sf_dir):
    a = _dense(spark, sf_dir, 10)
    b = retrieval.top_per_query(a.drop("rank").withColumn("score", F.round(F.col("score") * (1 + F.col("id") % 3), 9)), 10, F.col("id"))
    return retrieval.compare_rankings(a, b)


@query("c9_verbatim_benchmark", "SELECT b.item_id, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def verbatim(spark, sf_dir):
    """Documents that hold each item verbatim; items are the checked small side."""
    blocks = retrieval.query_blocks(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item"), "item_id")
    docs = table(spark, sf_dir, "documents")
    out = None
    for b in blocks:
        part = docs.join(F.broadcast(b), F.contains("text", "item")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return table(spark, sf_dir, "benchmark").select("item_id").join(out, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
