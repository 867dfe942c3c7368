"""Approximate nearest neighbours: vectors in cells around centroids, of which a query reads a few.

The centroids are fitted on a bounded sample; every vector is indexed.  An index is a folder of
three tables: `centroids`, `blocks` (up to BLOCK vectors of one cell and group in a row, partitioned
by cell) and `about` (dimensions, and how many cells a query should read).  That number is found on
the sample: the fewest cells that reach a target recall of exact answers there.  Found vectors are
scored exactly, so only which rows are looked at is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace import stored
from millrace.operators import products, retrieval

#: Most cells; a table of n vectors gets sqrt(n).
CELLS_MOST = 4096
#: Vectors of the sample for each cell, taken by a hash of the id, and rounds of k-means.
SAMPLE_EACH, ROUNDS = 64, 12
#: Sampled vectors that ask when the number of cells to read is found, how many neighbours they want, and the recall to reach.
CALIBRATION, CALIBRATION_K, TARGET = 256, 20, 0.97
#: Vectors in a row of the index, and rows of a cell that one task writes.
BLOCK, TASK_ROWS = 1024, 1_000_000

_BLOCKS = "cell int, grp string, ids array<long>, vectors array<float>"


def group_of(on: tuple[str, ...]) -> Column:
    """The columns that a query and a vector must agree in, as one string; null, which agrees with nothing, if any is."""
    if not on:
        return F.lit("")
    return F.when(reduce(and_, [F.col(c).isNotNull() for c in on]), F.to_json(F.struct(*on)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid of the greatest product with each row, a slice of rows at a time."""
    step = max(1, products.PAIRS // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(x[i : i + step] @ centroids.T, axis=1) for i in range(0, len(x), step)]])


def _read_by(q: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """(cell, query): whether the query reads the cell, as one of the `probes` whose centroids are nearest."""
    out = np.ones((len(centroids), len(q)), bool)
    step = max(1, products.PAIRS // max(1, len(centroids)))
    for i in range(0, len(q) if probes < len(centroids) else 0, step):
        s = centroids @ q[i : i + step].T
        out[:, i : i + step] = s >= np.partition(s, len(s) - probes, axis=0)[len(s) - probes]
    return out


def fit_cells(x: np.ndarray, n_cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means, begun at evenly spaced rows; cells that lose all rows are dropped."""
    unit = _unit(x)
    centroids = unit[np.linspace(0, len(unit) - 1, min(n_cells, len(unit))).astype(int)]
    for _ in range(rounds):
        nearest = _nearest(unit, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        centroids = _unit(sums[np.bincount(nearest, minlength=len(centroids)) > 0])
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, target: float = TARGET, k: int = CALIBRATION_K) -> int:
    """The fewest cells that hold `target` of the exact neighbours of some rows of x, on average."""
    asking = x[np.linspace(0, len(x) - 1, min(CALIBRATION, len(x))).astype(int)]
    k = min(k, len(x))
    step = max(1, products.PAIRS // len(x))
    best = np.concatenate([np.argpartition(-(asking[i : i + step] @ x.T), k - 1, axis=1)[:, :k] for i in range(0, len(asking), step)])
    cell = _nearest(_unit(x), centroids)
    order = np.argsort(-(asking @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    needed = np.take_along_axis(place, cell[best], axis=1)  # how far down the query's list of cells each neighbour's cell is
    reached = [(needed < p).mean() for p in range(1, len(centroids) + 1)]
    return int(np.searchsorted(np.maximum.accumulate(reached), target)) + 1 if reached[-1] >= target else len(centroids)


def write_cells(vectors: DataFrame, path: str, on: tuple[str, ...] = (), n_cells: int | None = None) -> None:
    """Write the index of vectors(id, embedding, *on) to `path`; rows without an id or embedding are left out.

    Vectors of different lengths are an error.  `on` holds columns that queries filter by: vectors
    of different values stand in different blocks.  A hot cell is written by as many tasks as its
    share of the sample asks for.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<float>").alias("v"), group_of(on).alias("grp"))
    rows = rows.where("grp is not null and id is not null")
    n, dim, longest = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if dim != longest:
        raise ValueError(f"vectors of {dim} to {longest} numbers")
    dim = dim or 0
    n_cells = n_cells or max(1, min(CELLS_MOST, math.isqrt(n)))
    share = min(1.0, n_cells * SAMPLE_EACH / max(1, n))
    order = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40))
    sample = rows.withColumn("h", order).where(F.col("h") <= share * float(1 << 40)).orderBy("h", "id").limit(2 * n_cells * SAMPLE_EACH)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        x = _matrix(table.sort_by([("h", "ascending"), ("id", "ascending")]).column("v").combine_chunks(), dim)
        centroids = fit_cells(x, n_cells)
        share = np.bincount(_nearest(_unit(x), centroids), minlength=len(centroids)) / len(x)
        probes = probes_for(x, centroids)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array(list(centroids.astype(np.float32)), pa.list_(pa.float32())), pa.array(share), pa.array(np.full(len(centroids), probes, np.int32))], ["cell", "centroid", "share", "probes"])

    # 2 * CELLS_MOST * SAMPLE_EACH vectors at most meet in one task
    fitted = sample.select("h", "id", "v").repartition(1).mapInArrow(fit, "cell int, centroid array<float>, share double, probes int")
    fitted = stored.saved(fitted.coalesce(1), f"{path}/centroids")
    found = fitted.orderBy("cell").collect()
    spark.createDataFrame([(dim, n, found[0]["probes"] if found else 0)], "dim int, n long, probes int").coalesce(1).write.parquet(f"{path}/about")
    shared = spark.sparkContext.broadcast((np.array([r["centroid"] for r in found], np.float32).reshape(-1, max(1, dim)), np.array([max(1, math.ceil(r["share"] * n / TASK_ROWS)) for r in found], np.int64)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, parts = shared.value
        for b in batches:
            cell = _nearest(_matrix(b.column("v"), dim), centroids)
            salt = np.abs(np.asarray(b.column("h"))) % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(salt), *[b.column(c) for c in ("grp", "id", "v")]], ["cell", "salt", "grp", "id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.float32())]
        for b in batches:
            cell, grp = np.asarray(b.column("cell")), b.column("grp").to_pylist()
            changes = [i for i in range(1, b.num_rows) if cell[i] != cell[i - 1] or grp[i] != grp[i - 1]]
            bounds = sorted({0, *changes, b.num_rows})
            cuts = [(s, min(s + BLOCK, e)) for a, e in zip(bounds, bounds[1:], strict=False) for s in range(a, e, BLOCK)]
            ids, flat = np.asarray(b.column("id")), np.asarray(b.column("v").flatten(), np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell[s] for s, _ in cuts], pa.int32()), pa.array([grp[s] for s, _ in cuts], pa.string()), pa.array([ids[s:e] for s, e in cuts], kinds[0]), pa.array([flat[s * dim : e * dim] for s, e in cuts], kinds[1])],
                ["cell", "grp", "ids", "vectors"],
            )

    placed = rows.select("id", "v", "grp", order.alias("h")).mapInArrow(assign, "cell int, salt long, grp string, id long, v array<float>")
    blocks = placed.repartition("cell", "salt").sortWithinPartitions("cell", "grp", "id").mapInArrow(pack, _BLOCKS)
    blocks.write.partitionBy("cell").parquet(f"{path}/blocks")


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, on: tuple[str, ...] = (), probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) as `retrieval.dense_top_k`, over the vectors of each query's nearest cells.

    queries(query_id, vector, *on) are broadcast in blocks of a checked size; partitions of cells that
    no query of a block reads are pruned.  `probes`: cells a query reads, by default what the index
    found for itself.  A task multiplies a block with all queries that read its cell (see `products`)
    and sends on what can be among their first k.
    """
    about = spark.read.parquet(f"{path}/about").first()
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # CELLS_MOST at most
    stored_blocks = spark.read.parquet(f"{path}/blocks") if centroids else spark.createDataFrame([], "grp string, ids array<long>, vectors array<float>, cell int")
    dim, probes = about["dim"], max(1, probes or about["probes"])
    c = np.array([r["centroid"] for r in centroids], np.float32).reshape(-1, max(1, dim))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", stored_blocks.schema["ids"].dataType.elementType), StructField("score", DoubleType())])
    parts = []
    for block in retrieval.query_blocks(queries.where(F.col("vector").isNotNull())):
        asked = block.select("query_id", F.col("vector").cast("array<double>").alias("vector"), group_of(on).alias("grp")).where("grp is not null").toArrow().combine_chunks()
        q = np.array(asked.column("vector").combine_chunks().flatten(), np.float64).reshape(asked.num_rows, -1) if asked.num_rows else np.zeros((0, max(1, dim)))
        read = _read_by(q, c, probes) if len(c) else np.zeros((0, len(q)), bool)
        cells = np.flatnonzero(read.any(axis=1)).tolist()
        shared = spark.sparkContext.broadcast((asked, np.packbits(read, axis=1)))  # a bit for each query and cell

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, read = shared.value
            if not asked.num_rows:
                return
            column = {n: pa.concat_arrays(asked.column(n).chunks) for n in asked.column_names}
            number = {g: i for i, g in enumerate(dict.fromkeys(column["grp"].to_pylist()))}
            group = np.array([number[g] for g in column["grp"].to_pylist()])
            best = products._Class(column | {"codes": []}, np.arange(asked.num_rows), dim)
            for b in batches:
                cells, groups = b.column("cell").to_pylist(), b.column("grp").to_pylist()
                for i in range(b.num_rows):
                    asking = np.flatnonzero(np.unpackbits(read[cells[i]], count=len(group)) & (group == number.get(groups[i], -1)))
                    ids = np.asarray(b.column("ids")[i].values)
                    x = np.asarray(b.column("vectors")[i].values, np.float64).reshape(len(ids), -1)
                    step = max(1, products.PAIRS // len(ids))
                    for j in range(0, len(asking), step):
                        own = asking[j : j + step]
                        row, nth = best.candidates(x, k, None, own)
                        best.add(x, ids, row, own[nth], k)
            best.prune(k)
            for at, ids, score in best.kept:
                yield pa.RecordBatch.from_arrays([column["query_id"].take(pa.array(at)), pa.array(ids), pa.array(score)], ["query_id", "id", "score"])

        found = stored_blocks.where(F.col("cell").isin(cells if asked.num_rows else []))
        parts.append(found.select("cell", "grp", "ids", "vectors").mapInArrow(scan, schema))
    return retrieval.top_per_query(retrieval._union(parts).withColumn("score", F.round("score", 9)), k, F.col("id"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_count, recall): the mean share of each query's exact first k rows that `found` has."""
    hits = exact.where(F.col("rank") <= k).join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    each = hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return each.agg(F.count(F.lit(1)).alias("query_count"), F.avg("recall").alias("recall"))
