"""Exact scores of vectors against many queries, as products of matrices inside the tasks that scan the vectors.

A task multiplies a slice of its vectors with a block of queries.  Where only the first k rows of a
query are asked for, it keeps the pairs that can be among them: the product tells which they are, with
a margin for its precision, for its order of summation and for the rounding of scores, and only these
are scored term by term, in doubles.  Of pairs of one query with equal scores the k smallest ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Pairs that a task multiplies at once, and scores at once where all are asked for.
PAIRS, PAIRS_ALL = 1 << 21, 1 << 17
#: Scores that round to the same 9 places differ by less, and the most that orders of summation differ, for unit vectors.
ROUNDING, SUMMATION = 2e-9, 1e-12
#: Products are of single precision where all norms are below SINGLE_NORM; SINGLE times the terms is twice their relative error.
SINGLE_NORM, SINGLE = 1e15, 2.0**-23
#: Kept pairs beyond four times k a query, at which a task drops those that fell behind.
SPARE = 100_000


def _agreeing(on: tuple[str, ...]) -> Column:
    """The columns `on` as one string; null, which agrees with nothing, if any is."""
    return F.when(reduce(and_, [F.col(c).isNotNull() for c in on]), F.to_json(F.struct(*on))) if on else F.lit("")


def _classes(groups: pa.Array, vectors: pa.Array) -> dict[tuple[str, int], np.ndarray]:
    """Rows by group and length of their vector; -1 for none or one with a null."""
    length = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1), np.int64)
    if vectors.flatten().null_count:
        length = np.array([-1 if v.values is None or v.values.null_count else n for v, n in zip(vectors, length.tolist(), strict=True)], np.int64)
    found: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(groups.to_pylist(), length.tolist(), strict=True)):
        if key[0] is not None:
            found.setdefault(key, []).append(i)
    return {k: np.array(v) for k, v in found.items()}


def _matrix(vectors: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    return np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), length)


def _values(ids: pa.Array) -> np.ndarray:
    """Ids without nulls as integers, others as objects."""
    whole = pa.types.is_integer(ids.type) and not ids.null_count
    return np.asarray(ids, np.int64) if whole else np.array([*ids.to_pylist(), None], object)[:-1]


class _Class:
    """Queries of one group and length: their vectors, and the k-th score of each so far."""

    def __init__(self, asked: dict, rows: np.ndarray, length: int):
        self.rows, self.q = rows, _matrix(asked["vector"], rows, length)
        with np.errstate(over="ignore"):
            self.single = self.q.astype(np.float32)
        self.columns = np.ascontiguousarray(self.q.T)
        self.norm, self.least = np.linalg.norm(self.q, axis=1), np.full(len(rows), -np.inf)
        self.own = _values(asked["query_id"])[rows]
        self.optional = [o[rows] for o in asked["codes"]]
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_kept = 0

    def allowed(self, ids: np.ndarray, codes: list[np.ndarray], skip_own: bool) -> np.ndarray | None:
        """Which pairs of a row and a query may be scored; None for all."""
        out = None
        for q, r in zip(self.optional, codes, strict=True):
            fits = (q[None, :] == -1) | (q[None, :] == r[:, None])
            out = fits if out is None else out & fits
        if skip_own:
            at = {x: n for n, x in enumerate(dict.fromkeys(self.own.tolist()))}
            other = np.array([at.get(x, -1) for x in ids.tolist()])[:, None] != np.array([at[x] for x in self.own.tolist()])[None, :]
            out = other if out is None else out & other
        return out

    def candidates(self, x: np.ndarray, k: int, allowed: np.ndarray | None, asking: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x, and queries (by their place among those `asking`), of the pairs that can be among a query's first k."""
        norm, size = self.norm[asking], np.linalg.norm(x, axis=1).max()
        single = norm.max(initial=0) < SINGLE_NORM and size < SINGLE_NORM  # else numbers that single precision can't hold, or NaN
        s = x.astype(np.float32) @ self.single[asking].T if single else x @ self.q[asking].T
        if allowed is not None:
            s[~allowed] = -np.inf
        margin = ROUNDING + (SINGLE * (x.shape[1] + 4) if single else SUMMATION) * norm * size
        with np.errstate(over="ignore"):
            least = np.nextafter((self.least[asking] - margin).astype(s.dtype), s.dtype.type(-np.inf))
        near = s < least
        np.logical_not(near, out=near)
        if len(x) > k and np.count_nonzero(near) > 2 * k * s.shape[1]:
            near &= ~(s < np.partition(s, len(x) - k, axis=0)[len(x) - k] - 2 * margin)
        if allowed is not None:
            near &= allowed
        return np.divmod(np.flatnonzero(near), max(1, s.shape[1]))

    def add(self, x: np.ndarray, ids: np.ndarray, r: np.ndarray, c: np.ndarray, k: int) -> None:
        score = np.zeros(len(r))
        for a, b in zip(np.ascontiguousarray(x.T), self.columns, strict=True):
            score += a[r] * b[c]
        self.kept.append(self.best(c, ids[r], score, k))
        self.n_kept += len(self.kept[-1][0])
        if self.n_kept > 4 * k * len(self.q) + SPARE:
            self.prune(k)

    def prune(self, k: int) -> None:
        if self.kept:
            self.kept = [self.best(*(np.concatenate(v) for v in zip(*self.kept, strict=True)), k)]
            self.n_kept = len(self.kept[0][0])

    def best(self, c: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be among their query's first k of these; Spark ranks NaN above all numbers."""
        nan = np.isnan(score)
        key, whole = np.where(nan, np.inf, score), ids.dtype != object
        order = np.lexsort((*((ids,) if whole else ()), -key, ~nan, c))
        c, ids, score, key, nan = (v[order] for v in (c, ids, score, key, nan))
        at = np.arange(len(c))
        new = np.append(True, c[1:] != c[:-1])[: len(c)]
        place = at - np.flatnonzero(new)[np.cumsum(new) - 1]
        kth = np.flatnonzero(place == k - 1)
        self.least[c[kth]] = np.maximum(self.least[c[kth]], key[kth])
        keep = ~(key < self.least[c] - ROUNDING)
        if whole:
            tie = new | np.append(True, (key[1:] != key[:-1]) | (nan[1:] != nan[:-1]))[: len(c)]
            keep &= at - np.flatnonzero(tie)[np.cumsum(tie) - 1] < k
        return c[keep], ids[keep], score[keep]


def scores(queries: DataFrame, chunks: DataFrame, on: tuple[str, ...], optional: tuple[str, ...], k: int | None, skip_own: bool) -> DataFrame:
    """(query_id, id, score), not rounded, of the pairs of a block of queries(query_id, vector, *on, *optional) and chunks(id, embedding, ...).

    The block goes to all tasks.  With k, pairs that can't be among their query's first k rows may be
    left out.  `on` columns are of one type on both sides.  A pair of vectors of different lengths, or
    with a null, has a null score.
    """
    spark, text = chunks.sparkSession, lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    extra = [F.when(F.col(c).isNotNull(), text(c)).alias(f"o{i}") for i, c in enumerate(optional)]
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), _agreeing(on).alias("grp"), *extra).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(asked)
    rows = chunks.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"), _agreeing(on).alias("grp"), *extra)
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", chunks.schema["id"].dataType), StructField("score", DoubleType())])
    n_optional = len(optional)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if not table.num_rows:
            return
        column = {n: table.column(n).combine_chunks() for n in table.column_names}
        column = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
        known = [{v: i for i, v in enumerate(dict.fromkeys(column[f"o{o}"].to_pylist())) if v is not None} for o in range(n_optional)]
        column["codes"] = [np.array([-1 if v is None else known[o][v] for v in column[f"o{o}"].to_pylist()], np.int64) for o in range(n_optional)]
        groups: dict[str, dict[int, _Class]] = {}
        odd: dict[str, np.ndarray] = {}
        for (grp, length), at in _classes(column["grp"], column["vector"]).items():
            groups.setdefault(grp, {})[length] = _Class(column, at, max(0, length)) if length >= 0 else None
            if length < 0:
                odd[grp] = at
        step = max(1, (PAIRS_ALL if k is None else PAIRS) // table.num_rows)
        kind = None

        def pairs(c: np.ndarray, ids: pa.Array, score: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column["query_id"].take(pa.array(c)), ids, score], ["query_id", "id", "score"])

        for b in batches:
            kind = b.column("id").type
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                ids, codes = _values(part.column("id")), [np.array([known[o].get(v, -2) for v in part.column(f"o{o}").to_pylist()], np.int64) for o in range(n_optional)]
                for (grp, length), at in _classes(part.column("grp"), part.column("v")).items():
                    for other, asking in groups.get(grp, {}).items():
                        if other == length and asking:
                            x, own, coded = _matrix(part.column("v"), at, length), ids[at], [v[at] for v in codes]
                            allowed = asking.allowed(own, coded, skip_own)
                            if k is not None:
                                asking.add(x, own, *asking.candidates(x, k, allowed), k)
                                continue
                            score = np.zeros((len(x), len(asking.q)))
                            for a, q in zip(x.T, asking.q.T, strict=True):
                                score += a[:, None] * q[None, :]
                            r, c = np.nonzero(np.ones(score.shape, bool) if allowed is None else allowed)
                            yield pairs(asking.rows[c], part.column("id").take(pa.array(at[r])), pa.array(score[r, c]))
                            continue
                        rows_of = asking.rows if asking else odd[grp]
                        for q in rows_of.tolist():  # null scores, which stand last by id
                            fits = np.ones(len(at), bool)
                            for o, v in enumerate(codes):
                                fits &= (column["codes"][o][q] == -1) | (v[at] == column["codes"][o][q])
                            if skip_own:
                                fits &= np.array([v != column["query_id"][q].as_py() for v in ids[at].tolist()], bool)
                            found = at[fits]
                            if k is not None and ids.dtype != object:
                                found = found[np.argsort(ids[found], kind="stable")[:k]]
                            yield pairs(np.full(len(found), q), part.column("id").take(pa.array(found)), pa.nulls(len(found), pa.float64()))
        for lengths in groups.values():
            for asking in lengths.values():
                if asking and asking.kept:
                    asking.prune(k)
                    c, ids, score = asking.kept[0]
                    yield pairs(asking.rows[c], pa.array(ids, kind), pa.array(score))

    return rows.mapInArrow(scan, schema)
