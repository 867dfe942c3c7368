"""Dense, lexical and hybrid retrieval for many queries at once, and their evaluation.

Queries are the small side: they are broadcast in blocks of a checked size, so the corpus is
scanned and never shuffled; each leg keeps a query's top k of every partition before ranking (dense
scores: see `products`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import small, with_defaults
from millrace.functions import text as tx
from millrace.operators import products

#: Queries, and bytes of their vectors, up to which they are broadcast as one block.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 32 << 20
#: Query terms up to which they are broadcast.
BROADCAST_TERMS = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors."""
    return 1 - dot(a, b)


def query_blocks(queries: DataFrame, key: str = "query_id", block: int = BROADCAST_QUERIES) -> list[DataFrame]:
    """The queries in blocks that may be broadcast; the number of blocks follows their count and the length of their vectors."""
    wide = F.max(F.size("vector")) * 8 if "vector" in queries.columns else F.lit(0)
    count, width = queries.agg(F.count(F.lit(1)), wide).first()
    n = max(-(-count // block), -(-count * max(0, width or 0) // BROADCAST_BYTES))
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _agree(on: tuple[str, ...], optional: tuple[str, ...]) -> list[Column]:
    """A query q and a row c have equal columns `on`, and `optional` ones where the query has a value."""
    return [F.col(f"q.{c}") == F.col(f"c.{c}") for c in on] + [F.col(f"q.{c}").isNull() | (F.col(f"q.{c}") == F.col(f"c.{c}")) for c in optional]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_per_query(scored: DataFrame, k: int, *ties: Column) -> DataFrame:
    """Rows with `rank` 1..k by descending score, ties as given."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_scores(queries: DataFrame, chunks: DataFrame, on: tuple[str, ...] = (), optional: tuple[str, ...] = (), k: int | None = None, skip_own: bool = False) -> DataFrame:
    """(query_id, id, score) of all pairs by cosine; queries(query_id, vector, *on, *optional), chunks(id, embedding, *on, *optional).

    Rows without an embedding are left out; `on` holds the tenant and filter columns, which are
    compared inside the scan, and `optional` filters that a query may lack.  Scores are rounded to 9
    places.  With k, a task leaves out what can't be among its query's first k rows, ties by id; with
    `skip_own`, rows of the query's own id.
    """
    parts = [products.scores(block, chunks, on, optional, k, skip_own) for block in query_blocks(queries)]
    return _union(parts).withColumn("score", F.round("score", 9))


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, on: tuple[str, ...] = (), optional: tuple[str, ...] = (), skip_own: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the first k pairs of `dense_scores`, ties by id."""
    return top_per_query(dense_scores(queries, chunks, on, optional, k, skip_own), k, F.col("id"))


def nearest_other(queries: DataFrame, chunks: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, expected_id): the best row but the query's own, over all rows; ties by id."""
    return dense_top_k(queries, chunks, 1, on, skip_own=True).select("query_id", F.col("id").alias("expected_id"))


def postings(chunks: DataFrame, content: str = "content", terms: DataFrame | None = None) -> DataFrame:
    """(id, term, places) of the lower-cased words of each chunk; a reusable index table.

    With terms(term), words of others are left out before anything is grouped: the terms are
    broadcast up to BROADCAST_TERMS, so only hits are shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    each = chunks.select("id", F.posexplode(words).alias("place", "term"))
    if terms is not None:
        known = terms.select("term").distinct()
        each = each.join(F.broadcast(known) if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else known, "term", "left_semi")
    return each.groupBy("id", "term").agg(F.sort_array(F.collect_list("place")).alias("places"))


def query_terms(queries: DataFrame, text: str = "query_text") -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return queries.select("query_id", F.size(words).alias("n_terms"), F.explode(words).alias("term"))


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int, on: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that hold all terms of a query, by summed term frequency, ties by id; `on` and `optional` as for `dense_scores`.

    A term joins its postings, so a hot term's rows are split by Spark; chunks are not broadcast.
    """
    terms = query_terms(queries)
    hits = postings(chunks, terms=terms).join(terms, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), F.sum(F.size("places")).cast("double").alias("score"))
    whole = hits.where("n = n_terms").select("query_id", "id", "score")
    if on or optional:
        asked, held = queries.select("query_id", *on, *optional).alias("q"), chunks.select("id", *on, *optional).alias("c")
        both = whole.alias("w").join(asked, F.col("w.query_id") == F.col("q.query_id")).join(held, [F.col("w.id") == F.col("c.id"), *_agree(on, optional)])
        whole = both.select("w.query_id", "w.id", "w.score")
    return top_per_query(whole, k, F.col("id"))


def cover_density(places: Column, n_terms: Column) -> Column:
    """Sum over minimal covers of 0.1 / (1 + words in the cover that are not query terms).

    places: sorted array<struct<place:int,term:int>> with terms numbered from 0.
    """
    never = F.lit(-1)
    state = F.struct(F.transform(F.sequence(F.lit(0), n_terms - 1), lambda _: never).alias("last"), never.alias("from"), F.lit(0.0).alias("sum"))
    nth = F.transform(places, lambda p, i: F.struct(p["place"].alias("place"), p["term"].alias("term"), i.alias("i")))

    def step(s: Column, p: Column) -> Column:
        # each term's last hit, by its number: the hits of a cover are those from the earliest one on
        last = F.transform(s["last"], lambda x, i: F.when(i == p["term"], p["i"]).otherwise(x))
        begin = F.array_min(last)
        words = p["place"] - F.get(places, begin)["place"] + 1
        gain = F.when((begin >= 0) & (begin > s["from"]), F.lit(0.1) / (1 + words - (p["i"] - begin + 1))).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(s["from"], begin).alias("from"), (s["sum"] + gain).alias("sum"))

    return F.aggregate(nth, state, step, lambda s: s["sum"])


def full_text_top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """As lexical_top_k, ranked by cover density, as a full-text engine ranks proximity."""
    order = Window.partitionBy("query_id").orderBy("term")
    terms = query_terms(queries).withColumn("no", F.row_number().over(order) - 1)
    each = F.transform("places", lambda p: F.struct(p.alias("place"), F.col("no").alias("term")))
    hits = postings(chunks, terms=terms).join(terms, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), F.sort_array(F.flatten(F.collect_list(each))).alias("at"))
    scored = hits.where("n = n_terms").select("query_id", "id", F.round(cover_density(F.col("at"), F.col("n_terms")), 9).alias("score"))
    return top_per_query(scored, k, F.col("id"))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, rrf_k: int = 60, settings: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, dense_rank, sparse_rank): sum of 1 / (rrf_k + rank) over both legs.

    A union and one aggregation; ranked by score, then dense rank (none last), sparse rank, id.
    settings(query_id, rrf_k) gives each query its own constant instead.
    """
    legs = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).union(sparse.select("query_id", "id", F.lit(None).cast("int"), F.col("rank")))
    both = legs.groupBy("query_id", "id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    own = both.withColumn("rrf_k", F.lit(rrf_k)) if settings is None else both.join(small(settings.select("query_id", "rrf_k")), "query_id")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col("rrf_k") + F.col(c)), F.lit(0.0))
    return own.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9)).drop("rrf_k")


def candidate_k(k: int) -> int:
    return max(20, 4 * k)


def hybrid_top_k(queries: DataFrame, chunks: DataFrame, k: int, rrf_k: int = 60, on: tuple[str, ...] = (), rerank: Callable[[Column, Column], Column] | None = None, optional: tuple[str, ...] = (), own: bool = False) -> DataFrame:
    """Both legs to max(20, 4k) candidates, fused, cut to as many, re-ranked if asked, cut to k.

    With `own`, each query has its own k and constant in the columns `top_k` and `rrf_k`, and k is
    the largest: one plan answers queries of any settings.
    """
    wide = candidate_k(k)
    settings = queries.select("query_id", "top_k", "rrf_k") if own else None

    def cut(ranked: DataFrame, most: Column) -> DataFrame:
        return ranked if settings is None else ranked.join(small(settings), "query_id").where(F.col("rank") <= most).drop("top_k", "rrf_k")

    candidates = F.greatest(F.lit(20), 4 * F.col("top_k"))
    legs = [cut(leg(queries, chunks, wide, on, optional), candidates) for leg in (dense_top_k, lexical_top_k)]
    fused = reciprocal_rank_fusion(*legs, rrf_k, settings)
    ties = (F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("id"))
    pool = cut(top_per_query(fused, wide, *ties), candidates)
    if rerank is not None:
        paired = pool.drop("score").withColumnRenamed("rank", "original_index").join(chunks.select("id", "content"), "id").join(queries.select("query_id", "query_text"), "query_id")
        pool = top_per_query(paired.withColumn("score", rerank(F.col("query_text"), F.col("content"))), wide, F.col("original_index")).drop("content", "query_text")
    return cut(pool.where(F.col("rank") <= k), F.col("top_k"))


def unknown_filter_keys(filters: Column, allowed: Column) -> Column:
    """Sorted filter keys that a tenant doesn't allow; a query with any is rejected."""
    return F.array_sort(F.array_except(F.map_keys(filters), allowed))


def holds_metadata(metadata: Column, filters: Column) -> Column:
    """Whether a row's metadata, a map, has all entries of the filters; any row does where there are none."""
    return F.forall(F.map_entries(F.coalesce(filters, F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.try_element_at(metadata, e["key"]) == e["value"], F.lit(False)))


def retrieve(requests: DataFrame, chunks: DataFrame, config: DataFrame, rerank: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rejected) of requests(query_id, client_id, query_text, vector, filters map) over tenants' chunks.

    Rejected (query_id, error): unknown clients and filter keys that the client doesn't allow.  The
    others are answered by both legs inside their tenant, all in one plan; the only promoted filter is
    `brand`.  Results are the tenant's retrieval_top_k; a request without any result has no row.
    """
    known = requests.join(small(with_defaults(config).select("client_id", "allowed_metadata_keys", "retrieval_top_k", "rrf_k").withColumn("_known", F.lit(True))), "client_id", "left")
    refused = unknown_filter_keys(F.coalesce("filters", F.create_map().cast("map<string,string>")), F.coalesce("allowed_metadata_keys", F.array().cast("array<string>")))
    error = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown client "), "client_id")).when(F.size(refused) > 0, F.concat(F.lit("filter keys not allowed: "), F.array_join(refused, ",")))
    judged = known.withColumn("error", error)
    good = judged.where("error is null").withColumn("brand", F.try_element_at("filters", F.lit("brand")))
    most = good.agg(F.max("retrieval_top_k")).first()[0] or 1
    asked = good.select("query_id", "client_id", "query_text", "vector", "brand", F.col("retrieval_top_k").alias("top_k"), "rrf_k")
    results = hybrid_top_k(asked, chunks, most, on=("client_id",), rerank=rerank, optional=("brand",), own=True)
    return results, judged.where("error is not null").select("query_id", "error")


def lexical_overlap(query: Column, content: Column) -> Column:
    """Deterministic default re-ranking score: share of the query's tokens that the text holds."""
    q = tx.tokens(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tx.tokens(content))) / F.size(q))


def top_k_accuracy(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Share of queries of each model whose expected id is among its first k; ranked(model, query_id, id, rank).

    A model without any ranked row failed: its accuracy is null, with a message.
    """
    hits = ranked.where(F.col("rank") <= k).join(expected, ["query_id"]).where(F.col("id") == F.col("expected_id")).select("model", "query_id").distinct().withColumn("hit", F.lit(1.0))
    ran = ranked.select("model").distinct().withColumn("ran", F.lit(True))
    wanted = expected.select("query_id", F.explode("models").alias("model")) if "models" in expected.columns else expected.select("query_id").join(small(ran.select("model")))
    out = wanted.join(hits, ["model", "query_id"], "left").groupBy("model").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("accuracy"), F.count(F.lit(1)).alias("query_count")).join(ran, "model", "left")
    return out.select("model", F.when(F.col("ran"), F.col("accuracy")).alias("top_k_accuracy"), "query_count", F.lit(k).alias("top_k"), F.when(F.col("ran").isNull(), F.lit("could not run")).alias("error_message"))


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rankings of the same candidates side by side: rank and score of each, and the move."""
    side = lambda x, n: x.select("query_id", "id", F.col("rank").alias(f"rank_{n}"), F.col("score").alias(f"score_{n}"))
    return side(a, "a").join(side(b, "b"), ["query_id", "id"]).withColumn("move", F.col("rank_a") - F.col("rank_b"))


def window_report(ranked: DataFrame, breadth: DataFrame, narrow_k: int = 1) -> DataFrame:
    """Retrieved rows with their query's `breadth` and `in_first`: whether the first generation call sees them.

    A narrow query shows its first `narrow_k` rows and keeps the rest for a retry; a broad one shows all.
    """
    x = ranked.join(breadth.select("query_id", "breadth"), "query_id", "left")
    return x.withColumn("in_first", (F.col("breadth") != "narrow") | (F.col("rank") <= narrow_k))
