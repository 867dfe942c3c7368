"""Full-text search over a stored index of posting blocks.

Documents are dealt into blocks of bounded size by a hash of their id.  The index has a row for each
term and block: the documents that hold the term, how often, and where; it is partitioned by a hash
of the term, and a term's rows stand by their largest frequency, highest first.  A search first reads
only the rows' heads: blocks that lack a term of a query can't answer it, and the sum of the terms'
largest frequencies bounds what a block can give.  The blocks with the highest bounds are scored, and
of the others only those whose bound reaches the score that the k-th document has by then.  So results
are exact, and a query reads the lists of few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import stored
from millrace.operators import retrieval

#: Documents of a block, partitions of the terms, and blocks of a query that are scored before the others are judged.
BLOCK_DOCS, PARTS, FIRST_BLOCKS = 4096, 64, 4
#: Matches of a query whose places a task holds at once.
ANSWER_DOCS = 256
#: Fixed value: what one cover adds at most.
COVER = 0.1

_ROWS = "part int, term string, block int, n int, most int, ids array<long>, counts array<int>, places array<int>"


def words(content: Column) -> Column:
    """The lower-cased words, as `retrieval.postings` has them."""
    return F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, words) sorted by block, as one row a term and stretch of a block."""
    for b in batches:
        block, lists = np.asarray(b.column("block")), b.column("words")
        lengths = np.asarray(pc.list_value_length(lists), np.int64)
        if not lengths.sum():
            continue
        terms = pc.dictionary_encode(lists.flatten())
        code, doc = np.asarray(terms.indices, np.int64), np.repeat(np.arange(b.num_rows), lengths)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((place, doc, code))  # documents of a block are neighbours
        code, doc, place = code[order], doc[order], place[order]
        new_doc = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
        counts = np.diff(np.append(new_doc, len(code)))
        d_code, d_doc = code[new_doc], doc[new_doc]
        d_block = block[d_doc]
        new_row = np.flatnonzero(np.concatenate([[True], (d_code[1:] != d_code[:-1]) | (d_block[1:] != d_block[:-1])]))
        ends = np.append(new_row, len(d_code)).astype(np.int32)
        place_ends = np.append(new_doc, len(code))[ends].astype(np.int32)
        ids = b.column("id").take(pa.array(d_doc))
        yield pa.RecordBatch.from_arrays(
            [
                terms.dictionary.take(pa.array(d_code[new_row])).cast(pa.string()),
                pa.array(d_block[new_row].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), ids),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(place_ends), pa.array(place.astype(np.int32))),
            ],
            ["term", "block", "ids", "counts", "places"],
        )


def write_postings(chunks: DataFrame, path: str, content: str = "content") -> None:
    """Write the index of chunks(id, content) to `path`; ids are longs, and rows without one are left out.

    A document moves once, as its words, to the others of its block, and the block's rows once more
    to their term's.  Rows of one term and block that Arrow's batches part stay apart; a search puts
    them together.
    """
    docs = chunks.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), words(F.col(content)).alias("words"))
    n_blocks = max(1, -(-chunks.count() // BLOCK_DOCS))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).repartition("block").sortWithinPartitions("block", "id")
    rows = dealt.mapInArrow(_packed, "term string, block int, ids array<long>, counts array<int>, places array<int>")
    rows = rows.withColumns({"part": part_of(F.col("term")), "n": F.size("ids"), "most": F.array_max("counts")})
    ranged = rows.repartitionByRange("part", "term", "block").sortWithinPartitions("part", "term", F.desc("most"), "block")
    ranged.select("part", "term", "block", "n", "most", "ids", "counts", "places").write.partitionBy("part").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, n_terms, no, term, part): the terms of each query, numbered by their order."""
    terms = retrieval.query_terms(queries)
    order = Window.partitionBy("query_id").orderBy("term")
    return terms.withColumns({"no": (F.row_number().over(order) - 1).cast("int"), "part": part_of(F.col("term"))})


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(retrieval.BROADCAST_TERMS + 1).count() <= retrieval.BROADCAST_TERMS else table


def _bounds(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, block, bound): blocks that hold all terms of a query, and the most that its terms occur in one document."""
    heads = index.select("part", "term", "block", "most").join(_small(asked), ["part", "term"])
    each = heads.groupBy("query_id", "n_terms", "block", "term").agg(F.max("most").alias("most"))
    return each.groupBy("query_id", "n_terms", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("bound")).where("n = n_terms").select("query_id", "block", "bound")


def _matched(terms: list[tuple[str, int]], lists: dict[str, list]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, scores, places) of a block's documents that hold all of a query's terms, ANSWER_DOCS at a time."""
    if not terms or any(t not in lists for t, _ in terms):
        return
    every = None
    for term, _ in sorted(terms, key=lambda t: sum(len(x[0]) for x in lists[t[0]])):
        own = np.concatenate([x[0] for x in lists[term]])
        every = np.unique(own) if every is None else every[np.isin(every, own)]
        if not len(every):
            return
    for start in range(0, len(every), ANSWER_DOCS):
        ids = every[start : start + ANSWER_DOCS]
        at: list[list[dict]] = [[] for _ in ids]
        score = np.zeros(len(ids))
        for term, no in terms:
            for own, counts, places in lists[term]:
                slot = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                found = np.flatnonzero(ids[slot] == own)
                np.add.at(score, slot[found], counts[found])
                if places is not None:
                    ends = np.cumsum(counts)
                    for i in found.tolist():
                        at[slot[i]] += [{"place": p, "term": no} for p in places[ends[i] - counts[i] : ends[i]].tolist()]
        yield ids, score, [sorted(x, key=lambda p: p["place"]) for x in at]


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block that hold all terms of a query: rows sorted by block, in each the queries and then the lists.

    A block's lists are held once, however many queries ask for them.
    """
    block, queries, wanted, lists = None, [], set(), {}

    def found() -> Iterator[pa.RecordBatch]:
        for q, n_terms, terms in queries:
            for ids, score, at in _matched(terms, lists):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), pa.array(np.full(n, n_terms, np.int32)), pa.array(ids), pa.array(score), pa.array(at, pa.list_(pa.struct([("place", pa.int32()), ("term", pa.int32())])))], ["q", "n_terms", "id", "score", "at"])

    for b in batches:
        heads = list(zip(*[b.column(c).to_pylist() for c in ("block", "q", "n_terms", "terms", "term")], strict=True))
        for i, (own, q, n_terms, terms, term) in enumerate(heads):
            if own != block:
                yield from found()
                block, queries, wanted, lists = own, [], set(), {}
            if term is None:
                queries.append((q, n_terms, [(t["term"], t["no"]) for t in terms]))
                wanted.update(t["term"] for t in terms)
            elif term in wanted:
                values = [b.column(c)[i].values for c in ("ids", "counts", "places")]
                lists.setdefault(term, []).append([None if v is None else np.array(v) for v in values])
    yield from found()


def _scored(index: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, id, score, n_terms, at): the matches in the blocks(q, query_id, block); `at` has the places of all terms.

    The queries' terms and a block's lists of any of these terms meet in the block's task, so a list
    moves once and not once for each query.
    """
    pairs = asked.join(blocks, "query_id").select("q", "block", "n_terms", "no", "term", "part")
    terms = pairs.groupBy("block", "q", "n_terms").agg(F.collect_list(F.struct("term", "no")).alias("terms"))
    lists = index.join(_small(pairs.select("part", "term").distinct()), ["part", "term"], "left_semi").join(_small(pairs.select("block").distinct()), "block", "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    asks = terms.select("block", "q", "n_terms", "terms", none("string").alias("term"), none("array<long>").alias("ids"), none("array<int>").alias("counts"), none("array<int>").alias("places"))
    held = lists.select("block", none("long").alias("q"), none("int").alias("n_terms"), none("array<struct<term:string,no:int>>").alias("terms"), "term", "ids", "counts", "places")
    rows = asks.union(held).repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first(), "q")
    return rows.mapInArrow(_matches, "q long, n_terms int, id long, score double, at array<struct<place:int,term:int>>")


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int, cover_density: bool = False) -> DataFrame:
    """(query_id, id, score, rank) as `retrieval.lexical_top_k` or, by cover density, `retrieval.full_text_top_k`.

    A query's first FIRST_BLOCKS blocks by bound are scored, then those whose bound reaches the k-th
    score so far.  A document begins at most one cover with each of its hits, so by cover density a
    block gives at most COVER times its bound.  Equal ids are one document.
    """
    index, asked = read_postings(spark, path), _asked(queries)
    if not cover_density:
        index = index.withColumn("places", F.lit(None).cast("array<int>"))
    ids = stored.saved(queries.select("query_id").distinct().withColumn("q", F.xxhash64(F.lit(11), "query_id")), stored.fresh(spark, "queries"))
    asked = stored.saved(asked, stored.fresh(spark, "query-terms"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = stored.saved(_bounds(index, asked).withColumn("nth", F.row_number().over(order)).join(ids, "query_id"), stored.fresh(spark, "block-bounds"))

    def best(rows: DataFrame) -> DataFrame:
        score = F.round(retrieval.cover_density(F.col("at"), F.col("n_terms")), 9) if cover_density else F.col("score")
        named = rows.select("q", "id", score.alias("score")).join(ids, "q").select("query_id", "id", "score")
        return retrieval.top_per_query(named, k, F.col("id"))

    first = stored.saved(best(_scored(index, asked, bounds.where(F.col("nth") <= FIRST_BLOCKS))), stored.fresh(spark, "first-matches"))
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    bound = F.col("bound") * COVER if cover_density else F.col("bound")
    rest = bounds.where(F.col("nth") > FIRST_BLOCKS).join(reached, "query_id", "left").where(F.col("least").isNull() | (bound >= F.col("least") - 1e-9))
    more = best(_scored(index, asked, rest))
    return retrieval.top_per_query(first.drop("rank").unionByName(more.drop("rank")), k, F.col("id"))
