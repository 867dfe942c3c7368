"""Ingest: staged sheet rows to chunks, replacement, mirroring and keyed updates of tables.

`replaced`, `upserted` and `mirrored` return the new table, for `sources.sinks` to write by partition;
`mirror_into` commits staged rows and chunks to a `sources.versions` store, where both switch at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import small
from millrace.functions import text as tx
from millrace.sources.versions import Store


def all_null(fields: Column) -> Column:
    return ~F.exists(fields, lambda f: f["value"].isNotNull())


def inferred_columns(staging: DataFrame) -> DataFrame:
    """(client_id, sheet_name, columns): labels in the order in which rows first show them."""
    each = staging.select("client_id", "sheet_name", "ord", F.posexplode("fields").alias("pos", "f")).where("f.key <> 'sheet_name'")
    first = each.groupBy("client_id", "sheet_name", F.col("f.key").alias("key")).agg(F.min(F.struct("ord", "pos")).alias("at"))
    listed = first.groupBy("client_id", "sheet_name").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("k"))
    return listed.select("client_id", "sheet_name", F.transform("k", lambda x: x["key"]).alias("columns"))


def missing_mandatory(sheets: DataFrame, registry: DataFrame) -> DataFrame:
    """(client_id, source_file, sheet_name, missing) of sheets that lack a mandatory column; their file is rejected."""
    x = sheets.join(small(registry.select("client_id", "sheet_name", "mandatory_fields")), ["client_id", "sheet_name"])
    return x.withColumn("missing", F.array_except("mandatory_fields", "columns")).where("size(missing) > 0").select("client_id", "source_file", "sheet_name", "missing")


def chosen_fields(fields: Column, columns: Column) -> Column:
    """Non-blank fields in the order of the sheet's columns; values stay as they are."""
    found = lambda c: F.get(F.filter(fields, lambda f: f["key"] == c), 0)["value"]
    return F.filter(F.transform(columns, lambda c: F.struct(c.alias("key"), found(c).alias("value"))), lambda f: F.coalesce(tx.stripped(f["value"]) != "", F.lit(False)))


def alias_value(fields: Column, aliases: Column) -> Column:
    """What the first field (in order) whose value has an alias stands for; null if none has."""
    hits = F.filter(F.transform(fields, lambda f: F.try_element_at(aliases, F.lower(tx.stripped(f["value"])))), lambda v: v.isNotNull())
    return F.get(hits, 0)


def chunk_rows(staging: DataFrame, registry: DataFrame, config: DataFrame) -> DataFrame:
    """Chunks of staged rows: id, content, source_file, chunk_type and metadata.

    Columns come from the registry, else from the rows; rows without a non-blank field give no
    chunk.  The alias map of a tenant is lower-cased once.  The registry and the settings are
    broadcast while they are small; staged rows never move, but for the inferred columns.
    """
    known = registry.select("client_id", "sheet_name", F.col("columns").alias("_registered"))
    inferred = inferred_columns(staging.join(small(known), ["client_id", "sheet_name"], "left_anti"))
    lowered = F.transform_keys("brand_value_aliases", lambda k, _: F.lower(tx.stripped(k)))
    x = staging.join(small(known), ["client_id", "sheet_name"], "left").join(small(inferred), ["client_id", "sheet_name"], "left").join(small(config.select("client_id", lowered.alias("_aliases"))), "client_id", "left")
    x = x.withColumn("field_data", chosen_fields(F.col("fields"), F.coalesce("_registered", "columns"))).where("size(field_data) > 0")
    content = tx.chunk_text(F.col("field_data"), F.col("source_file"))
    brand = F.when(F.col("_aliases").isNotNull(), alias_value(F.col("field_data"), F.col("_aliases")))
    metadata = F.struct("sheet_name", "source_file", brand.alias("brand"), "field_data")
    return x.select("client_id", tx.stable_id("chunk", F.col("client_id"), F.col("source_file"), F.col("sheet_name"), F.col("ord").cast("string")).alias("id"), content.alias("content"), "source_file", F.col("sheet_name").alias("chunk_type"), metadata.alias("metadata"))


def replaced(table: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("client_id", "source_file")) -> DataFrame:
    """`table` with all rows of the new rows' keys replaced by them."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def deleted(table: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("client_id", "source_file")) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def stale_files(tables: list[DataFrame], listed: DataFrame) -> DataFrame:
    """(client_id, source_file) that a table holds and the listing doesn't, sorted."""
    held = tables[0].select("client_id", "source_file")
    for t in tables[1:]:
        held = held.union(t.select("client_id", "source_file"))
    return held.distinct().join(listed.select("client_id", "source_file"), ["client_id", "source_file"], "left_anti").orderBy("client_id", "source_file")


def mirrored(tables: list[DataFrame], listed: DataFrame, listing_ok: bool) -> list[DataFrame]:
    """The tables without stale files; unchanged where the listing failed."""
    if not listing_ok:
        return tables
    gone = stale_files(tables, listed)
    return [deleted(t, gone) for t in tables]


def deleted_counts(table: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("client_id", "source_file")) -> DataFrame:
    """How many rows of each key `deleted` removes; 0 for a key that the table doesn't hold."""
    held = table.join(keys.select(*on).distinct(), list(on), "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return keys.select(*on).distinct().join(held, list(on), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mirror_sync(rows: DataFrame, listed: DataFrame, staging: DataFrame, chunks: DataFrame, registry: DataFrame, config: DataFrame, listing_ok: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staging, chunks, rejected) after the folder's files have been parsed into `rows`.

    rows: client_id, source_file, sheet_name, ord, fields.  A file that lacks a mandatory column is
    rejected and keeps what it had; each other file's rows and chunks are replaced.  Files that the
    listing doesn't name lose both, unless the listing failed; a listed file without rows keeps what it had.
    """
    labels = rows.select("client_id", "source_file", "sheet_name", F.explode("fields").alias("f"))
    sheets = labels.groupBy("client_id", "source_file", "sheet_name").agg(F.collect_set("f.key").alias("columns"))
    rejected = missing_mandatory(sheets, registry)
    good = rows.join(rejected.select("client_id", "source_file").distinct(), ["client_id", "source_file"], "left_anti")
    files = good.select("client_id", "source_file").distinct()
    new = chunk_rows(good, registry, config).select(chunks.columns)
    kept = mirrored([deleted(staging, files), deleted(chunks, files)], listed, listing_ok)
    return kept[0].unionByName(good.select(staging.columns)), kept[1].unionByName(new), rejected


def mirror_into(store: Store, rows: DataFrame, listed: DataFrame, registry: DataFrame, config: DataFrame, listing_ok: bool = True, batch: tuple[str, int] | None = None) -> DataFrame:
    """As `mirror_sync`, upon the tables `staging` and `chunks` of a store and in one commit; returns `rejected`.

    Only the new rows and the removed files' keys are written; what stays isn't touched.
    """
    manifest = store.manifest()
    held = [store.read(t, manifest) for t in ("staging", "chunks") if t in manifest["tables"]]
    labels = rows.select("client_id", "source_file", "sheet_name", F.explode("fields").alias("f"))
    sheets = labels.groupBy("client_id", "source_file", "sheet_name").agg(F.collect_set("f.key").alias("columns"))
    rejected = missing_mandatory(sheets, registry)
    good = rows.join(rejected.select("client_id", "source_file").distinct(), ["client_id", "source_file"], "left_anti")
    removed = good.select("client_id", "source_file")
    if held and listing_ok:
        removed = removed.union(stale_files(held, listed))
    store.commit({"staging": good, "chunks": chunk_rows(good, registry, config)}, removed, batch)
    return rejected


def upserted(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """`table` with new rows added and the non-null columns of known keys updated."""
    other = [c for c in table.columns if c not in keys]
    a, b = table.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    value = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")
    return a.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in other])


def with_embeddings(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with the embeddings that (client_id, id, embedding) adds or replaces."""
    x = chunks.join(new.select("client_id", "id", F.col("embedding").alias("_new")), ["client_id", "id"], "left")
    return x.withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def without_embedding(chunks: DataFrame, source_file: str | None = None) -> DataFrame:
    rows = chunks.where(F.col("embedding").isNull())
    return rows if source_file is None else rows.where(F.col("source_file") == source_file)


def tenant_of_key(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Requests with the tenant of their api key; null for an unknown key."""
    return requests.join(small(config.select(F.col("admin_api_key").alias("api_key"), "client_id")), "api_key", "left")


def source_files(table: DataFrame) -> DataFrame:
    return table.where(F.col("source_file").isNotNull()).select("client_id", "source_file").distinct()
