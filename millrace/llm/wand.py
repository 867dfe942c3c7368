"""Ranked lexical search: WAND in each document shard over a stored index, shard heaps merged.

The index is a table: documents are dealt into shards of bounded text, and a shard has one row for
each of its terms, with the places of the documents that hold it and their frequencies.  A search
reads the rows of its own terms only.  In a shard, a term's maximum impact bounds what it can add to
any document; a document is a pivot if the maxima of its terms reach the threshold of the query's
heap, and only pivots are scored.  Lists whose maxima together stay below the threshold offer no
pivots; they are only looked up at those of the others.  Each task has one heap for a query, which
it keeps from shard to shard, so its threshold grows; the heaps of all tasks are merged at the end.

Scores are whole numbers, so results don't depend on the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, discard, written

#: Most text bytes (or one document) and most documents of a shard.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 8192
#: Text bytes, or one text, whose words are cut at once.
PIECE_BYTES = 1 << 19
#: Documents that a query gets.
TOP = 50
#: Pairs of query and term that a task holds at once; larger sets of queries are searched in blocks.
BLOCK_PAIRS = 1_000_000
#: Heaps of so many groups of tasks are merged before those of all.
GROUPS = 256
#: Fixed values of the score.
SCALE, WEIGHT_SCALE = 1_000_000_000, 1000

_INDEX = "shard long, term long, df int, places array<int>, counts array<int>, ids array<long>"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term, text) of each word; words are cut from PIECE_BYTES at a time, so only these two arrays are as long as the shard."""
    terms, owners = [], []
    for i, j in tk.slices(texts, PIECE_BYTES):
        w = tk.Words(texts.slice(i, j - i), tk.ALNUM_WORDS, lower=True)
        terms.append(tk.as_long(w.hashes()))
        owners.append((w.text + i).astype(np.int32))
    return (np.concatenate(terms), np.concatenate(owners)) if terms else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _grouped(terms: np.ndarray, owners: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, offset of its postings, text, frequency) of some words, sorted by term and text."""
    distinct, number = np.unique(terms, return_inverse=True)
    key, counts = np.unique(number * n_texts + owners, return_counts=True)
    of_term, text = key // n_texts, key % n_texts
    return distinct, np.searchsorted(of_term, np.arange(len(distinct) + 1)), text, counts


def _list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _shard_rows(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """The rows of one shard: first its documents with a term and their lengths, then its terms."""
    words, owners = _tokens(texts)
    if not len(words):
        return None
    lengths = np.bincount(owners, minlength=len(texts))
    held = np.flatnonzero(lengths)
    terms, offsets, text, counts = _grouped(words, owners, len(texts))
    places = np.searchsorted(held, text)
    n = len(terms) + 1
    bounds = np.concatenate([[0, len(held)], len(held) + offsets[1:]])
    first = np.concatenate([[0], np.full(n, len(held))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, shard)),
            pa.array(np.concatenate([[0], terms]), mask=np.arange(n) == 0),
            pa.array(np.concatenate([[0], np.diff(offsets)]).astype(np.int32)),
            _list(np.concatenate([np.arange(len(held)), places]), bounds, pa.int32()),
            _list(np.concatenate([lengths[held], counts]), bounds, pa.int32()),
            pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), ids.take(pa.array(held)).cast(pa.int64())),
        ],
        ["shard", "term", "df", "places", "counts", "ids"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of `docs`, a written table; `discard` it when no search will read it.

    (shard, term, df, places, counts, ids): a shard's row without a term has its documents, their
    numbers of terms and ids.  Terms are 64-bit hashes of the words.  A text without words, or null,
    isn't stored.  Ids are integers and may be null or repeat; every row is a document of its own.
    """
    rows = Rows(docs, text_col)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for i, j in tk.slices(b.column(1), SHARD_BYTES):
                for at in range(i, j, SHARD_DOCS):
                    part = b.slice(at, min(j - at, SHARD_DOCS))
                    if (out := _shard_rows(base + made, part.column(0), part.column(1))) is not None:
                        made += 1
                        yield out

    return written(rows.frame.select(rows.id(id_col).alias("_id"), rows.text).mapInArrow(shards, _INDEX), "search-index")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, term): the distinct terms of each query; rows of one id, null included, are one query."""
    rows = Rows(queries, text_col)

    def terms(batches):
        for b in batches:
            for i, j in tk.slices(b.column(1)):
                part = b.slice(i, j - i)
                w = tk.Words(part.column(1), tk.ALNUM_WORDS, lower=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w.text)), pa.array(tk.as_long(w.hashes()))], ["_id", "term"])

    frame = rows.frame.select(rows.col(id_col).alias("_id"), rows.text)
    kind = frame.schema["_id"].dataType.simpleString()
    return frame.mapInArrow(terms, f"_id {kind}, term long").distinct()


class Heap:
    """The best `k` documents of a query so far: score, whether the id is null, id."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """What a document must reach to enter; equal scores may enter by their ids."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def push(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        score, null, ids = (np.concatenate(x) for x in ((self.score, score), (self.null, null), (self.id, ids)))
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.id = score[best], null[best], ids[best]


def _pivots(lists: list[tuple[np.ndarray, np.ndarray, int]], threshold: int, n_docs: int) -> np.ndarray:
    """The documents whose terms' maximum impacts reach the threshold; lists are sorted by that maximum."""
    most = np.cumsum([top for _, _, top in lists])
    if most[-1] < threshold:
        return np.zeros(0, np.int64)
    idle = int(np.searchsorted(most, threshold))  # lists before this one can't make a pivot without a later one
    bound = np.zeros(n_docs, np.int64)
    for places, _, top in lists[idle:]:
        bound[places] += top
    pivots = np.flatnonzero(bound)
    bound = bound[pivots]
    for i in range(idle - 1, -1, -1):
        places, _, top = lists[i]
        alive = bound + most[i] >= threshold  # those that the remaining lists can still lift
        pivots, bound = pivots[alive], bound[alive]
        at = np.minimum(np.searchsorted(places, pivots), len(places) - 1)
        bound = bound + top * (places[at] == pivots)
    return pivots[bound >= threshold]


def _scores(lists: list[tuple[np.ndarray, np.ndarray, int]], pivots: np.ndarray) -> np.ndarray:
    total = np.zeros(len(pivots), np.int64)
    for places, impacts, _ in lists:
        at = np.minimum(np.searchsorted(places, pivots), len(places) - 1)
        total += np.where(places[at] == pivots, impacts[at], 0)
    return total


def search_shard(lists: dict[int, tuple[np.ndarray, np.ndarray, int]], queries: list[np.ndarray], heaps: list[Heap], ids: np.ndarray, null: np.ndarray) -> None:
    """Put a shard's documents into the heaps; lists: places, impacts and the largest impact of each term."""
    for terms, heap in zip(queries, heaps, strict=True):
        own = sorted((x for x in (lists.get(t) for t in terms.tolist()) if x is not None and x[2] > 0), key=lambda x: x[2])
        if not own:
            continue
        threshold = heap.threshold
        pivots = _pivots(own, threshold, len(ids))
        if not len(pivots):
            continue
        score = _scores(own, pivots)
        enter = score >= threshold
        if enter.any():
            heap.push(score[enter], null[pivots[enter]], ids[pivots[enter]])


def _search_block(index: DataFrame, pairs: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(_id, doc_id, score): the best k documents, or more, of the queries of pairs(_id, term)."""
    spark = index.sparkSession
    found = pairs.collect()  # at most about BLOCK_PAIRS
    names = list(dict.fromkeys(r["_id"] for r in found))
    number = {x: i for i, x in enumerate(names)}
    terms: list[list[int]] = [[] for _ in names]
    for r in found:
        terms[number[r["_id"]]].append(r["term"])
    wanted = sorted({t for x in terms for t in x})
    known = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term long"))
    postings = index.join(known, "term", "left_semi").select(*index.columns)
    dfs = {r["term"]: r["df"] for r in postings.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = {t: math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in dfs.items()}
    shared = spark.sparkContext.broadcast((weights, [np.array(sorted(t), np.int64) for t in terms]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = shared.value
        heaps = [Heap(k) for _ in queries]
        shard, lists = None, {}
        ids = null = length = np.zeros(0, np.int64)
        for b in batches:
            shards, own_terms = b.column("shard").to_numpy(), b.column("term")
            is_first, own_terms = own_terms.is_null().to_numpy(zero_copy_only=False), own_terms.fill_null(0).to_numpy()
            places, offsets = tk.lists(b.column("places"))
            counts, _ = tk.lists(b.column("counts"))
            for i in range(b.num_rows):
                if shards[i] != shard:
                    if lists:
                        search_shard(lists, queries, heaps, ids, null)
                    shard, lists = shards[i], {}
                at = slice(offsets[i], offsets[i + 1])
                if is_first[i]:
                    held = b.column("ids")[i].values
                    null, ids = held.is_null().to_numpy(zero_copy_only=False), held.fill_null(0).to_numpy()
                    length = 50 + (50 * counts[at] * n_docs) // n_terms
                elif w := weight[int(own_terms[i])]:
                    tf = counts[at]
                    impacts = w * ((SCALE * tf) // (1000 * tf + 20 * length[places[at]]))
                    lists[int(own_terms[i])] = (places[at], impacts, int(impacts.max()))
        if lists:
            search_shard(lists, queries, heaps, ids, null)
        for q, heap in enumerate(heaps):
            if len(heap.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heap.score), q, np.int32)), pa.array(heap.id, mask=heap.null), pa.array(heap.score), pa.array(np.full(len(heap.score), TaskContext.get().partitionId() % GROUPS, np.int32))], ["q", "doc_id", "score", "g"])

    rows = postings.unionByName(index.where("term is null")).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    best = rows.mapInArrow(search, "q int, doc_id long, score long, g int")
    first = Window.partitionBy("q", "g").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    kind = pairs.schema["_id"].dataType.simpleString()
    return best.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), f"q int, _id {kind}")), "q").select("_id", "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, doc_id, score): the k best documents of each query whose score is above 0.

    Ranked by score, then id (null last).  Rows of one query id, null included, are one query; a
    query without terms, or whose terms no document holds, has no row.
    """
    pairs = written(query_terms(queries, id_col, text_col), "search-terms")
    size = index.where("term is null").agg(F.sum(F.size("ids")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    out = None
    for i in range(blocks):
        own = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == i)
        part = _search_block(index, own, size[0] or 0, size[1] or 0, k)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = out.select(F.col("_id").alias(id_col), "rank", "doc_id", "score")
    discard(pairs)
    return out
