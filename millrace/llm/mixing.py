"""Mixing sources to target weights, without Python workers.

Words are summed for each source, targets are filled up to their caps, and each document is taken
floor(rate) times and once more with the rate's fraction as probability, by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._columns import words
from millrace.llm._shared import Rows, written

#: Weights of the sources in code point order, repeating; the null source comes last.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most times that a source is repeated.
TOTAL_SHARE, MOST_REPEATS = 1.5, 2
#: Seed of the draws.
SEED = 0
#: Sources up to which their table is broadcast; beyond, the join shuffles (and splits hot sources).
BROADCAST_SOURCES = 50_000


def _draw(id_col: Column, seed: int) -> Column:
    """Uniform in [0, 1), from 52 bits of a digest of seed and id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size): one row for each source.

    Fills level * weight up to each cap.  With the sources ordered by cap / weight, the level is
    the greatest of (pool - caps before) / (weights from here on), so no loop is needed.  The
    windows without a partition see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(every) - 1) % len(WEIGHTS) + 1)
    x = by_source.withColumn("weight", weight).withColumn("cap", MOST_REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (TOTAL_SHARE * F.sum("source_size").over(whole) - before) / left)
    x = x.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return x.select("source", "source_size", "target", rate.alias("rate"))


def _with_source(rows: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    table = by_source.withColumnRenamed("source", "_source_key")
    return rows.join(F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table, F.col("_source").eqNullSafe(F.col("_source_key")), "inner").drop("_source_key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """All columns of `docs`, and size, source_size, target, copies, taken (size * copies).

    Size counts runs of `[^\\x20\\x09-\\x0D]`; a null text has size 0.  A null source is a source
    of its own.  A document is taken floor(rate) times and once more if its draw is below the
    rate's fraction.  Rows with equal ids draw alike; null ids draw as the empty string.  The draw
    depends on seed and id alone, so reruns agree.  An input column with a result's name, in any
    case, is replaced.  An empty table gives an empty one.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    rows = Rows(docs, text_col, added)
    text_size = F.size(words(rows.col(text_col))).cast("long")
    sized = rows.frame.select(rows.row, rows.text, rows.col(id_col).alias("_id"), rows.col(source_col).alias("_source"), text_size.alias("size"))
    by_source = written(targets(rows.frame.select(rows.col(source_col).alias("source"), text_size.alias("size"))), "targets")
    whole = F.floor(F.col("rate"))
    copies = (whole + F.when(_draw(F.col("_id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long")
    out = _with_source(sized, by_source, by_source.count()).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.result(out, *added)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it."""
    some = mixed.where("copies > 0")
    plain = some.toDF(*[f"c{i}" for i in range(len(some.columns))])
    copies = F.col(f"c{some.columns.index('copies')}")
    return plain.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("copy").toDF(*some.columns)
