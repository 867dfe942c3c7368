"""Intermediate tables in the folder that the whole cluster shares, and rows with columns of any name."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from millrace import stored
from millrace.llm import _tokens as tk

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again: its lineage ends there.

    Whoever has written all that reads the table may `discard` it.
    """
    spark = df.sparkSession
    path = stored.fresh(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the table replaces its shuffles, whose files would stay till the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read any more."""
    for t in tables:
        stored.delete(t.sparkSession, t._written_to)


def schema_of(frame: DataFrame, added: str) -> StructType:
    """The columns of `frame` and those of the DDL `added`."""
    return StructType(frame.schema.fields + StructType.fromDDL(added).fields)


class Rows:
    """A table whose columns, whatever their names, go by number through an operator.

    `frame` has columns c0, c1, ...; `row` is a struct of those that the result keeps but the text,
    which travels once, as `_text`.  An input column with a result's name, in any case, is replaced.
    """

    def __init__(self, docs: DataFrame, text_col: str, added: tuple[str, ...] | list[str] = ()):
        self.names = docs.columns
        self.frame = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        taken = {x.lower() for x in added}
        self.kept = [i for i, c in enumerate(self.names) if c.lower() not in taken]
        self.text_number = self.number(text_col)
        self.text = F.col(f"c{self.text_number}").alias("_text")
        self.row = F.struct(F.lit(0).alias("any"), *[F.col(f"c{i}") for i in self.kept if i != self.text_number]).alias("_row")

    def number(self, name: str) -> int:
        exact = [i for i, c in enumerate(self.names) if c == name]
        return (exact or [i for i, c in enumerate(self.names) if c.lower() == name.lower()])[0]

    def col(self, name: str) -> Column:
        return F.col(f"c{self.number(name)}")

    def id(self, name: str) -> Column:
        """The id column as a long; ids are integers."""
        kind = self.frame.schema[self.number(name)].dataType
        if not isinstance(kind, IntegralType):
            raise TypeError(f"ids are integers, but {name} is {kind.simpleString()}")
        return self.col(name).cast("long")

    def result(self, frame: DataFrame, *added: str | Column) -> DataFrame:
        """The kept columns of a frame with `_row` and `_text` under their own names, and the added ones."""
        return frame.select(*[F.col("_text" if i == self.text_number else f"_row.c{i}").alias(self.names[i]) for i in self.kept], *added)


def with_computed(docs: DataFrame, read: str, added: str, compute: Callable[[pa.Array], list], keep: bool = True) -> DataFrame:
    """`docs` with the columns of the DDL `added`: compute(slice of the column `read`) gives their arrays.

    One pass without a shuffle; a task holds a slice of bounded text size at a time.  Without
    `keep`, `read` is dropped.
    """
    new = StructType.fromDDL(added)
    rows = Rows(docs, read, new.names)
    if not keep:
        rows.kept = [i for i in rows.kept if i != rows.text_number]
    stays = rows.text_number in rows.kept
    frame = rows.frame.select(rows.row, rows.text)
    schema = StructType([*frame.schema.fields[: 1 + stays], *new.fields])

    def scan(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: 1 + stays], *compute(part.column("_text"))], schema.names)

    return rows.result(frame.mapInArrow(scan, schema), *new.names)
