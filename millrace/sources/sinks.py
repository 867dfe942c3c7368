"""Writers: appends that may be repeated, replacement by partition, and dataset files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("client_id", "source_file")
#: What a training tool's registry says about the files' columns.
COLUMNS = {"prompt": "instruction", "query": "input", "response": "output", "system": "system", "history": "history"}


def append(rows: DataFrame, path: str, id_col: str | None = None) -> None:
    """Append; with an id column, rows whose id is stored already are left out, so a retry adds nothing."""
    if id_col is not None:
        rows = rows.dropDuplicates([id_col])
        try:
            stored = rows.sparkSession.read.parquet(path).select(id_col)
        except Exception as e:  # noqa: BLE001  nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            rows = rows.join(stored, id_col, "left_anti")
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> None:
    """Overwrite only the partitions of the rows' keys; nothing is written unless all rows are computed."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_datasets(split: DataFrame, folder: str, name: str = "dataset") -> dict:
    """JSON folders train and val, and the registry entry of each."""
    for part in ("train", "val"):
        split.where(F.col("split") == part).drop("split").write.mode("overwrite").json(f"{folder}/{part}")
    return {f"{name}_{part}": {"file_name": f"{folder}/{part}", "columns": COLUMNS} for part in ("train", "val")}


def write_judged(judged: DataFrame, folder: str) -> None:
    """JSON lines of the accepted records, and of the rejected ones with their reasons."""
    judged.where("accepted").drop("accepted", "rejection_reason", "rejection_stage").write.mode("overwrite").json(f"{folder}/accepted")
    judged.where("not accepted").drop("accepted").write.mode("overwrite").json(f"{folder}/rejected")


def merge_registry(spark: SparkSession, path: str, entries: dict) -> None:
    """A dataset registry with entries added or replaced; one row of JSON text."""
    try:
        old = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception as e:  # noqa: BLE001  there is none yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = {}
    text = json.dumps(old | entries, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def refresh_statistics(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
