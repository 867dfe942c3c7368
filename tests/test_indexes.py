"""The stored indexes against exact search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SF_DIR

from millrace import stored
from millrace.operators import cells, postings, products, retrieval
from millrace.tables import dense_queries, text_chunks, text_queries, vectors


def rows(frame):
    return sorted(map(tuple, frame.select("query_id", "id", "score", "rank").collect()), key=repr)


def random_vectors(spark, n=900, dim=8, groups=3):
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    made = []
    for i in range(n):
        v = [x + r.gauss(0, 0.4) for x in base[i % 9]]
        size = sum(x * x for x in v) ** 0.5
        made.append((i, [x / size for x in v], f"t{i % groups}", None if i % 50 == 7 else "a" if i % 2 else "b"))
    made += [(n, None, "t0", "a"), (None, made[0][1], "t0", "a"), *[(n + 1 + j, made[0][1], "t0", "a") for j in range(100)]]
    return spark.createDataFrame(made, "id long, embedding array<double>, client_id string, brand string")


def asking(spark, v):
    return v.where("id % 60 = 0 and embedding is not null").selectExpr("id AS query_id", "embedding AS vector", "client_id", "brand")


@pytest.mark.parametrize("on", [(), ("client_id",), ("client_id", "brand")])
def test_reading_all_cells_is_exact(spark, on):
    v = random_vectors(spark).where("id is not null")
    path = stored.fresh(spark, "test-cells")
    cells.write_cells(v, path, on)
    q = asking(spark, v)
    exact = retrieval.dense_top_k(q, v.withColumn("embedding", v.embedding.cast("array<float>")), 7, on)
    got, want = rows(cells.search_cells(spark, path, q, 7, on, probes=10_000)), rows(exact)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, want, strict=True))


def test_few_cells_reach_the_recall(spark):
    """Clustered vectors need few cells, and a hot cell is dealt to several tasks."""
    v = random_vectors(spark)
    path = stored.fresh(spark, "test-cells")
    cells.write_cells(v, path, n_cells=30)
    probes = spark.read.parquet(f"{path}/about").first()["probes"]
    assert probes < 15 and spark.read.parquet(f"{path}/blocks").selectExpr("sum(size(ids))").first()[0] == 1000
    q = asking(spark, v.where("embedding is not null"))
    found = cells.recall(cells.search_cells(spark, path, q, 10), retrieval.dense_top_k(q, v.where("id is not null"), 10), 10).first()
    assert found["query_count"] == q.count() and found["recall"] >= 0.9


def test_recall_on_the_test_vectors(spark):
    path = stored.fresh(spark, "test-cells")
    cells.write_cells(vectors(spark, SF_DIR), path)
    q = dense_queries(spark, SF_DIR)
    assert cells.recall(cells.search_cells(spark, path, q, 20), retrieval.dense_top_k(q, vectors(spark, SF_DIR), 20), 20).first()["recall"] >= 0.9


def test_a_block_is_multiplied_with_all_its_queries(spark, monkeypatch):
    """Blocks meet slices of queries, not one query after another, and send on few rows."""
    v = random_vectors(spark)
    path = stored.fresh(spark, "test-cells")
    cells.write_cells(v.where("id is not null"), path, n_cells=10)
    asked = asking(spark, v.where("embedding is not null and id < 900"))
    n, original = asked.count(), products._Class.candidates

    def candidates(self, x, k, allowed, own):
        assert len(own) == min(n, max(1, products.PAIRS // len(x)))
        return original(self, x, k, allowed, own)

    monkeypatch.setattr(products._Class, "candidates", candidates)
    want = rows(retrieval.dense_top_k(asked, v.where("id is not null").withColumn("embedding", v.embedding.cast("array<float>")), 5))
    assert n == 15 and rows(cells.search_cells(spark, path, asked, 5, probes=10)) == want


def test_cells_that_a_query_reads(monkeypatch):
    r = np.random.default_rng(1)
    q, c = r.normal(size=(50, 4)), r.normal(size=(20, 4))
    order = np.argsort(-(q @ c.T), axis=1)
    for pairs in (1 << 21, 60):
        monkeypatch.setattr(products, "PAIRS", pairs)
        for probes in (1, 7, 20, 30):
            read = cells._read_by(q, c, probes)
            assert [set(np.flatnonzero(x)) for x in read.T] == [set(x[:probes]) for x in order]
        assert cells._nearest(q, c).tolist() == order[:, 0].tolist()


def test_no_vectors_no_neighbours(spark):
    v = random_vectors(spark)
    path = stored.fresh(spark, "test-cells")
    cells.write_cells(v.limit(0), path)
    assert cells.search_cells(spark, path, asking(spark, v), 5).count() == 0
    with pytest.raises(ValueError):
        cells.write_cells(v.selectExpr("id", "IF(id = 3, array(1.0D), embedding) AS embedding"), stored.fresh(spark, "test-cells"))


@pytest.mark.parametrize("cover", [False, True])
@pytest.mark.parametrize("block", [4096, 25])
def test_posting_blocks_answer_as_a_scan(spark, monkeypatch, block, cover):
    """Small blocks make later ones be judged by their bounds."""
    monkeypatch.setattr(postings, "BLOCK_DOCS", block)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 2)
    chunks, path = text_chunks(spark, SF_DIR), stored.fresh(spark, "test-postings")
    postings.write_postings(chunks, path)
    common = spark.createDataFrame([(900, "the of"), (901, "the"), (902, "de la que"), (903, ""), (904, None), (905, "nowhere the"), (906, "The THE of and")], "query_id long, query_text string")
    q = text_queries(spark, SF_DIR).union(common)
    exact = retrieval.full_text_top_k if cover else retrieval.lexical_top_k
    want = rows(exact(q, chunks, 5))
    assert rows(postings.search_postings(spark, path, q, 5, cover)) == want and len({r[0] for r in want}) > 5


def test_blocks_below_the_threshold_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 10)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 1)
    docs = [(i, "a b") for i in range(300)] + [(1000, "a a a a b b b"), (None, "a b"), (2000, None)]
    path = stored.fresh(spark, "test-postings")
    postings.write_postings(spark.createDataFrame(docs, "id long, content string"), path)
    q = spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    read = []
    original = postings._scored
    monkeypatch.setattr(postings, "_scored", lambda index, asked, blocks: read.append(blocks.count()) or original(index, asked, blocks))
    assert rows(postings.search_postings(spark, path, q, 1)) == [(1, 1000, 7.0, 1)]
    assert read == [1, 0]  # of about 30 blocks


def test_a_list_moves_once_for_all_queries(spark, monkeypatch):
    path = stored.fresh(spark, "test-postings")
    postings.write_postings(spark.range(100).selectExpr("id", "'a b' AS content"), path)
    asked = postings._asked(spark.range(50).selectExpr("id AS query_id", "'a b' AS query_text"))
    blocks = spark.range(50).selectExpr("id AS query_id", "id AS q", "0 AS block")

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist([{"q": len(x or []), "n_terms": 0, "id": 0, "score": 0.0, "at": []} for x in b.column("ids").to_pylist()], pa.schema([("q", pa.int64()), ("n_terms", pa.int32()), ("id", pa.int64()), ("score", pa.float64()), ("at", pa.list_(pa.struct([("place", pa.int32()), ("term", pa.int32())])))]))

    monkeypatch.setattr(postings, "_matches", counted)
    assert postings._scored(postings.read_postings(spark, path), asked, blocks).agg({"q": "sum"}).first()[0] == 200


def test_an_index_is_written_once_while_it_is_there(spark):
    written = []

    def write(path):
        written.append(path)
        spark.range(1).write.parquet(path)

    first, second = (stored.once(spark, "test", "a folder", write) for _ in range(2))
    assert first == second and written == [first]
    stored.delete(spark, first)
    assert stored.once(spark, "test", "a folder", write) == written[1] != first
