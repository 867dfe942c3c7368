"""Dense scores by products of matrices against the same scores as Spark expressions."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import products, retrieval


def made(spark, kind):
    r = random.Random(5)
    rows = []
    for i in range(400):
        v = [r.choice([-1.0, 0.5, 0.1]) * r.random() for _ in range(4)] if i % 4 else rows[r.randrange(len(rows))][1] if rows else [0.1, 0.2, 0.3, 0.4]
        v = [1e300, 1e300, 0.0, 0.0] if i == 77 else [float("nan"), 1.0, 0.0, 0.0] if i in (78, 120) else [float("inf"), 0.0, -1.0, 0.0] if i == 79 else [1.0, 2.0] if i in (80, 81) else [None, 1.0, 2.0, 3.0] if i in (82, 160) else None if i in (83, 180) else v
        rows.append((i, v, None if i % 31 == 0 else f"t{i % 3}", None if i % 7 == 0 else f"b{i % 2}"))
    rows += [(i, rows[1][1], "t0", "b1") for i in range(3000, 3060)] + [(60, rows[1][1], "t0", "b0"), (None, rows[2][1], "t1", "b1")]
    return spark.createDataFrame(rows, "id long, embedding array<double>, client_id string, brand string").withColumn("id", F.col("id").cast(kind)).repartition(3)


def plainly(q, chunks, on, optional, skip_own):
    same = [F.col(f"q.{c}") == F.col(f"c.{c}") for c in on] + [F.col(f"q.{c}").isNull() | (F.col(f"q.{c}") == F.col(f"c.{c}")) for c in optional]
    pairs = chunks.where("embedding is not null").alias("c").join(q.alias("q"), same or None, "inner" if same else "cross")
    out = pairs.select("q.query_id", "c.id", F.round(retrieval.dot(F.col("c.embedding"), F.col("q.vector")), 9).alias("score"))
    return out.where("NOT (id <=> query_id)") if skip_own else out


def seen(frame, *columns):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(v) for v in r) for r in frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("kind", "on", "optional", "skip_own"), [("long", (), (), False), ("string", (), (), False), ("long", ("client_id",), ("brand",), False), ("long", ("client_id",), (), True), ("int", (), ("brand", "client_id"), True)])
def test_scores_equal_expressions(spark, monkeypatch, kind, on, optional, skip_own):
    monkeypatch.setattr(products, "SPARE", 0)
    monkeypatch.setattr(products, "PAIRS", 2000)
    monkeypatch.setattr(products, "PAIRS_ALL", 300)
    chunks = made(spark, kind)
    q = chunks.where("CAST(id AS INT) % 20 = 0 OR id IN (79, 80)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), "client_id", "brand").dropDuplicates(["query_id"])
    want = plainly(q, chunks, on, optional, skip_own)
    assert seen(retrieval.dense_scores(q, chunks, on, optional, skip_own=skip_own), "query_id", "id", "score") == seen(want, "query_id", "id", "score")
    for k in (1, 7, 1000):
        got = retrieval.dense_top_k(q, chunks, k, on, optional, skip_own)
        assert seen(got, "query_id", "id", "score", "rank") == seen(retrieval.top_per_query(want, k, F.col("id")), "query_id", "id", "score", "rank")


def test_pairs_closer_than_single_precision(spark):
    """300 vectors whose scores differ by 4e-8 or so, which single precision can't tell apart."""
    r = random.Random(9)
    chunks = spark.createDataFrame([(i, [0.5 + 1e-7 * r.random() for _ in range(4)] if i % 3 else [r.random() / 2 for _ in range(4)]) for i in range(450)], "id long, embedding array<double>").repartition(2)
    q = chunks.where("id % 30 = 1").selectExpr("id AS query_id", "embedding AS vector")
    for k in (1, 20):
        want = retrieval.top_per_query(plainly(q, chunks, (), (), False), k, F.col("id"))
        assert seen(retrieval.dense_top_k(q, chunks, k), "query_id", "id", "score", "rank") == seen(want, "query_id", "id", "score", "rank")


def test_products_are_of_single_precision_where_it_can_hold_them():
    asked = {"vector": pa.array([[3.0, 4.0], [1e200, 0.0]]), "query_id": pa.array([1, 2]), "codes": []}
    x = np.array([[1.0, 0.0], [1e-9, 1.0]])
    for rows, kind in (([0], np.float32), ([0, 1], np.float64)):
        made = products._Class(asked, np.array(rows), 2)
        found = []
        made.single = made.single.view(Seen)
        made.q = made.q.view(Seen)
        Seen.found = found
        made.candidates(x, 5, None)
        assert found == [kind]


class Seen(np.ndarray):
    """Notes the type of the numbers that are multiplied."""

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if ufunc is np.matmul:
            Seen.found.append(self.dtype.type)
        return getattr(ufunc, method)(*[np.asarray(i) for i in inputs], **kwargs)


def test_tasks_leave_out_pairs_and_no_pair_is_a_row_of_a_join(spark):
    chunks = spark.range(20_000).selectExpr("id", "transform(sequence(1, 8), j -> sin(id * j + j)) AS embedding").coalesce(2)
    q = chunks.where("id % 100 = 0").selectExpr("id AS query_id", "embedding AS vector")
    few = retrieval.dense_scores(q, chunks, k=5)
    assert "NestedLoopJoin" not in retrieval.dense_top_k(q, chunks, 5)._jdf.queryExecution().toString()
    assert 1000 <= few.count() <= 2 * 1000 + 100
