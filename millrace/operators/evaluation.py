"""Classification of failed answers against the contexts that a log shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

# Phrases of apologies, and terms that any context may hold (callers add their brands).
APOLOGIES = ("مش متوفرة عندي", "مش متوفره عندي", "مش واضحة عندي", "مش واضح عندي", "مش واضحة بالشكل", "مش واضح بالشكل", "للأسف يا فندم", "أحولك لزميلي", "أحوّلك لزميلي", "احولك لزميلي", "مش هقدر أأكدلك", "مش هقدر اأكدلك", "مش هقدر أقولك")
GENERIC_TERMS = ("متاح", "فرع", "الفروع")
SNIPPET = 1500


def latest_blocks(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records with the latest block of their query and the number of its blocks.

    blocks(query, seq, block).  An exact query wins; else the one equal without outer spaces.
    """
    per = blocks.groupBy("query").agg(F.max_by("block", "seq").alias("block"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    trimmed = per.groupBy(tx.stripped("query").alias("_trimmed")).agg(F.min_by(F.struct("block", "n"), "first").alias("_near"))
    x = records.join(per.select(F.col("query").alias("patient_query"), F.struct("block", "n").alias("_exact")), "patient_query", "left")
    x = x.withColumn("_trimmed", tx.stripped("patient_query")).join(trimmed, "_trimmed", "left").withColumn("_m", F.coalesce("_exact", "_near"))
    return x.withColumns({"context": F.col("_m.block"), "context_match_count": F.coalesce("_m.n", F.lit(0)).cast("int")}).drop("_exact", "_near", "_m", "_trimmed")


def classify_failures(records: DataFrame, blocks: DataFrame, brand_terms: tuple[str, ...] = ()) -> DataFrame:
    """Records that failed, with failure_reasons, context_available and the context's beginning."""
    x = latest_blocks(records, blocks)
    empty = F.col("debug_json").isNull() | F.regexp_replace("debug_json", r"\s", "").isin("{}", "[]", "null")
    apology = empty & tx.contains_any(F.coalesce("actual_reply", F.lit("")), APOLOGIES)
    wanted = tx.significant_tokens(F.col("expected_fact"))
    unrelated = F.col("context").isNotNull() & (F.size(wanted) > 0) & ~F.arrays_overlap(wanted, tx.significant_tokens(F.col("context")))
    kind = F.when(tx.contains_any(F.col("context"), GENERIC_TERMS + brand_terms), "KEYWORD_COLLISION_SUSPECTED").otherwise("CONTEXT_TOPIC_MISMATCH")
    reasons = F.filter(F.array(F.when(apology, "EMPTY_OR_APOLOGY"), F.when(unrelated, kind)), lambda r: r.isNotNull())
    out = x.withColumns({"failure_reasons": reasons, "context_available": F.col("context").isNotNull(), "retrieved_context_snippet": F.substring("context", 1, SNIPPET)})
    return out.where("size(failure_reasons) > 0").drop("context")
