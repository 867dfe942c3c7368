"""Dataset curation: deterministic sampling, deduplication, splits and the four question passes.

Randomness is a hash of a seed and the row's id, so every sample is repeatable and independent of
partitioning.  Chunks are (client_id, id, sheet_name, brand, fields).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import small
from millrace.functions import text as tx
from millrace.operators.decisions import mode_share

# Limits of the passes and of the split.
LABEL_COUNT, LABEL_RATIO = 20, 0.08
DISCLAIMER_SHARE = 0.6
PER_LABEL = 3
COMPOUND_SHARE = 0.4
MISSING_MOST, CONFLICT_MOST = 30, 20
VAL_FRACTION, VAL_FROM = 0.05, 20
#: Hexadecimal digits of a hash by which the split counts rows before it ranks any.
BUCKET_DIGITS = 3


def hash_order(seed: int, *ids: str) -> Column:
    """A repeatable shuffle; SHA-1, so that any engine gives the same order."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *ids))


def labelled(chunks: DataFrame) -> DataFrame:
    """One row per field: chunk columns, ord, label, value."""
    return chunks.select("client_id", "id", "sheet_name", "brand", F.posexplode("fields").alias("ord", "f")).select("client_id", "id", "sheet_name", "brand", "ord", F.col("f.key").alias("label"), F.col("f.value").alias("value"))


def boilerplate_labels(chunks: DataFrame, count: int = LABEL_COUNT, ratio: float = LABEL_RATIO) -> DataFrame:
    """(client_id, label, n, distinct_ratio): frequent labels that hardly vary."""
    per = labelled(chunks).groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("d"))
    return per.withColumn("distinct_ratio", F.col("d") / F.col("n")).where((F.col("n") >= count) & (F.col("distinct_ratio") <= ratio)).drop("d")


def _at_most(rows: DataFrame, most: int | None, *ids: str) -> DataFrame:
    """The first `most` rows of each tenant in hash order of the ids; all if None."""
    if most is None:
        return rows
    order = Window.partitionBy("client_id").orderBy(hash_order(4, *ids))
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def conflicts(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """(client_id, label, values, ids): labels with two or more values, or `most` of each tenant; the first two and a chunk of each."""
    per = labelled(chunks).groupBy("client_id", "label", tx.collapsed(F.col("value")).alias("value")).agg(F.min("id").alias("id"))
    nth = Window.partitionBy("client_id", "label").orderBy("id", "value")
    two = per.withColumn("nth", F.row_number().over(nth)).where("nth <= 2")
    out = two.groupBy("client_id", "label").agg(F.sort_array(F.collect_list(F.struct("nth", "value", "id"))).alias("p")).where("size(p) = 2")
    return _at_most(out, most, "label").select("client_id", "label", F.transform("p", lambda x: x["value"]).alias("values"), F.transform("p", lambda x: x["id"]).alias("ids"))


def missing_fields(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """(client_id, id, label): labels of a sheet that a chunk of it lacks, or `most` of each tenant."""
    rows = labelled(chunks)
    sheet = rows.groupBy("client_id", "sheet_name").agg(F.array_sort(F.collect_set("label")).alias("all"))
    own = chunks.select("client_id", "sheet_name", "id", F.transform("fields", lambda f: f["key"]).alias("own"))
    lacking = own.join(sheet, ["client_id", "sheet_name"]).select("client_id", "id", F.explode(F.array_except("all", "own")).alias("label"))
    return _at_most(lacking, most, "id", "label")


def per_group(rows: DataFrame, n: int, seed: int, *by: str, id_col: str = "id") -> DataFrame:
    """The first n rows of each group in hash order."""
    order = Window.partitionBy(*by).orderBy(hash_order(seed, id_col), id_col)
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def disclaimer_seeds(chunks: DataFrame, share: float = DISCLAIMER_SHARE) -> DataFrame:
    """Chunks most of whose values are one value, three of each brand and sheet."""
    values = F.transform("fields", lambda f: tx.stripped(f["value"]))
    return per_group(chunks.where((F.size("fields") > 0) & (mode_share(values) >= share)), PER_LABEL, 1, "client_id", "brand", "sheet_name")


def resolved_ids(*files: DataFrame) -> DataFrame:
    """Distinct source ids that the records of several files settle."""
    out = None
    for f in files:
        ids = f.select(F.coalesce("source_hypothesis_custom_id", "custom_id").alias("custom_id"))
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def not_done(candidates: DataFrame, done: DataFrame, key: str = "custom_id") -> DataFrame:
    return candidates.join(done.select(key), key, "left_anti")


def narrow_pass(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Field questions: three chunks of each varying label; two in five ask for a second field too.

    (custom_id, client_id, id, labels): ids are stable, and those done already are left out.
    """
    usable = labelled(chunks).where(tx.stripped("value") != "").join(boilerplate_labels(chunks).select("client_id", "label"), ["client_id", "label"], "left_anti")
    picked = per_group(usable, PER_LABEL, 1, "client_id", "label")
    fields = usable.groupBy("client_id", "id").agg(F.sort_array(F.collect_list(F.struct("ord", "label"))).alias("all"))
    x = picked.join(fields, ["client_id", "id"])
    others = F.filter("all", lambda o: o["label"] != F.col("label"))
    compound = (F.size(others) > 0) & (F.conv(F.substring(hash_order(2, "id", "label"), 1, 8), 16, 10).cast("double") / float(1 << 32) < COMPOUND_SHARE)
    labels = F.when(compound, F.array(F.col("label"), F.get(others, 0)["label"])).otherwise(F.array("label"))
    out = x.select(tx.stable_id("narrow", F.col("client_id"), F.col("id"), F.array_join(labels, ",")).alias("custom_id"), "client_id", "id", labels.alias("labels"))
    return not_done(out, done)


def classify_hypotheses(hypotheses: DataFrame, top: DataFrame) -> DataFrame:
    """Hypotheses with `decision` by their first retrieved chunk.

    hypotheses: custom_id, source_id, answer map; top: custom_id, id, fields map.  The source
    itself retrieved: confirmed.  Another chunk that holds the answer: reattributed; one that has
    the keys with other values: needs_correction; anything else is discarded.
    """
    x = hypotheses.join(top.select("custom_id", F.col("id").alias("top_id"), F.col("fields").alias("top_fields")), "custom_id", "left")
    entries = F.map_entries("answer")
    has = lambda e: F.map_contains_key(F.col("top_fields"), e["key"])
    same = F.forall(entries, lambda e: has(e) & (tx.collapsed(F.try_element_at(F.col("top_fields"), e["key"])) == tx.collapsed(e["value"])))
    decision = F.when(F.col("top_id").isNull(), "discarded").when(F.col("top_id") == F.col("source_id"), "confirmed").when(same, "reattributed").when(F.forall(entries, has), "needs_correction").otherwise("discarded")
    return x.withColumn("decision", decision).drop("top_fields")


def broad_pass(probes: DataFrame, done: DataFrame) -> DataFrame:
    """Questions that several chunks answer; probes(client_id, probe_id, id) are retrieved rows.

    A probe needs two results or more; its id is made of its sorted sources.
    """
    x = probes.groupBy("client_id", "probe_id").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) >= 2")
    out = x.select(tx.stable_id("broad", F.col("client_id"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("custom_id"), "client_id", "probe_id", "ids")
    first = out.groupBy("custom_id", "client_id", "ids").agg(F.min("probe_id").alias("probe_id")).select("custom_id", "client_id", "probe_id", "ids")
    return not_done(first, done)


def with_requests(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results with the metadata of their request; those of unknown requests are left out."""
    return results.join(requests, "custom_id")


def absence_pass(questions: DataFrame, chunks: DataFrame, done: DataFrame, target: int = 60) -> DataFrame:
    """Questions paired with a chunk that isn't theirs, without repeats, `target` of each tenant.

    Both sides are put in hash order and joined on their rank, so no pairs are enumerated; a
    question that meets its own chunk takes one of the chunks behind those of all ranks, so no two
    questions get the same.
    """
    place = lambda x, seed, key: x.withColumn("_n", F.row_number().over(Window.partitionBy("client_id").orderBy(hash_order(seed, key), key)))
    q = place(questions.select("client_id", "question_id", "source_id"), 31, "question_id").where(F.col("_n") <= 2 * target)
    c = place(chunks.select("client_id", "id"), 32, "id").where(F.col("_n") <= 4 * target)
    spare = c.where(F.col("_n") > 2 * target).select("client_id", (F.col("_n") - 2 * target).alias("_n"), F.col("id").alias("_spare"))
    met = q.join(c, ["client_id", "_n"]).join(spare, ["client_id", "_n"], "left")
    pairs = met.withColumn("id", F.when(F.col("id") == F.col("source_id"), F.col("_spare")).otherwise(F.col("id"))).where("id is not null").drop("_spare")
    kept = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("client_id").orderBy("_n"))).where(F.col("_k") <= target)
    out = kept.select(tx.stable_id("absence", F.col("client_id"), F.col("question_id"), F.col("id")).alias("custom_id"), "client_id", "question_id", "id")
    return not_done(out, done)


def ambiguous_pass(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without one answer: fields that a chunk lacks, and labels whose values conflict."""
    direct = missing_fields(chunks, MISSING_MOST).select(tx.stable_id("missing", F.col("client_id"), F.col("id"), F.col("label")).alias("custom_id"), "client_id", F.lit("ambiguous_direct").alias("grounding_type"), "label", F.array("id").alias("ids"))
    cross = conflicts(chunks, CONFLICT_MOST).select(tx.stable_id("conflict", F.col("client_id"), F.col("label")).alias("custom_id"), "client_id", F.lit("ambiguous_cross_chunk").alias("grounding_type"), "label", "ids")
    return not_done(direct.unionByName(cross), done)


def dedup_records(records: DataFrame, order: str = "ord") -> DataFrame:
    """Records without exact duplicates, then without twins of one instruction and input; the first stays.

    One window over (instruction, input): twins include exact duplicates, whose column `dropped`
    tells which kind they are in the counts of `dedup_report`.
    """
    return _dedup_marked(records, order).where("dropped is null").drop("dropped")


def _dedup_marked(records: DataFrame, order: str) -> DataFrame:
    pair = Window.partitionBy("instruction", "input").orderBy(order)
    exact = Window.partitionBy("instruction", "input", "_json", "output_phrasing").orderBy(order)
    x = records.withColumn("_json", tx.canonical_json(F.col("output_json"))).withColumn("_e", F.row_number().over(exact)).withColumn("_p", F.row_number().over(pair))
    return x.withColumn("dropped", F.when(F.col("_e") > 1, "exact").when(F.col("_p") > 1, "near_twin")).drop("_json", "_e", "_p")


def dedup_report(records: DataFrame, order: str = "ord") -> DataFrame:
    return _dedup_marked(records, order).agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("dropped") == "exact").alias("exact_duplicates_dropped"), F.count_if(F.col("dropped") == "near_twin").alias("near_twin_duplicates_dropped"), F.count_if(F.col("dropped").isNull()).alias("output"))


def stratified_split(records: DataFrame, stratum: str = "pass", id_col: str = "id", seed: int = 101) -> DataFrame:
    """Records with `split`: of strata of 20 or more, a twentieth (half to even) is for validation.

    Validation rows are the first of their stratum in hash order.  Counts by the hash's first
    digits tell the bucket in which a stratum's last one lies; only rows of that bucket are
    ranked, and all others are marked by comparison.
    """
    h = hash_order(seed, id_col)
    rows = records.withColumn("_bucket", F.conv(F.substring(h, 1, BUCKET_DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy(F.col(stratum).alias("_stratum"), "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    of, n = Window.partitionBy("_stratum"), F.col("_n")
    n_val = F.when(n >= VAL_FROM, F.bround(n * VAL_FRACTION)).otherwise(0)
    upto = F.sum("_c").over(of.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    sized = counts.withColumn("_n", F.sum("_c").over(of)).withColumn("_before", upto - F.col("_c")).withColumn("_left", n_val - F.col("_before"))
    edges = sized.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_c"))).select("_stratum", F.col("_bucket").alias("_edge"), "_left")
    x = rows.join(small(edges), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    marked = lambda part, val: part.select(*records.columns, F.when(val, "val").otherwise("train").alias("split"))
    order = Window.partitionBy(stratum).orderBy(h, id_col)
    edge = marked(x.where("_bucket = _edge").withColumn("_nth", F.row_number().over(order)), F.col("_nth") <= F.col("_left"))
    return marked(x.where("_edge is null or _bucket <> _edge"), F.col("_bucket") < F.col("_edge")).union(edge)


def alpaca(records: DataFrame, system: str) -> DataFrame:
    """Records in the instruction format: system, instruction, input, output, history."""
    fenced = F.concat(F.lit("```json\n"), F.col("output_json"), F.lit("\n```\n\n"), F.col("output_phrasing"))
    return records.select(F.lit(system).alias("system"), F.concat(F.lit("CONTEXT:\n"), "input").alias("instruction"), F.concat(F.lit("PATIENT MESSAGE:\n"), "instruction").alias("input"), fenced.alias("output"), F.array().cast("array<string>").alias("history"))


def taxonomy(chunks: DataFrame, prefix: str) -> DataFrame:
    """(client_id, topic): distinct collapsed values of the labels that start with a prefix."""
    rows = labelled(chunks).where(tx.stripped(tx.without_tatweel(F.col("label"))).startswith(prefix) & (tx.stripped("value") != ""))
    return rows.select("client_id", tx.collapsed(F.col("value")).alias("topic")).distinct()


def unmatched(chunks: DataFrame, prefix: str) -> DataFrame:
    """(client_id, n): chunks without a topic under the prefix."""
    has = F.exists("fields", lambda f: tx.stripped(tx.without_tatweel(f["key"])).startswith(prefix) & (tx.stripped(f["value"]) != ""))
    return chunks.groupBy("client_id").agg(F.count_if(~F.coalesce(has, F.lit(False))).alias("n"))
