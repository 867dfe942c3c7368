"""Decisions about ranked results, for all queries at once.

Ranked rows are (query_id, rank, id, score, ...), rank 1 first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as tx

#: Fewest fields of a row that can look like a placeholder.
PLACEHOLDER_FIELDS = 5

def distinct_ratio(values: Column) -> Column:
    return F.size(F.array_distinct(F.transform(values, lambda v: tx.stripped(v)))) / F.size(values)


def is_placeholder(values: Column, most: Column | float) -> Column:
    """A row of five fields or more whose distinct values are at most this share."""
    return (F.size(values) >= PLACEHOLDER_FIELDS) & (distinct_ratio(values) <= most)


def mode_share(values: Column) -> Column:
    """Share of the most frequent value of a row."""
    counts = F.transform(F.array_distinct(values), lambda x: F.size(F.filter(values, lambda y: y == x)))
    return F.array_max(counts) / F.size(values)


def breadth(ranked: DataFrame, threshold: float = 0.0, gap: float = 0.3) -> DataFrame:
    """(query_id, breadth): narrow for fewer than two results or a clear first one, else broad."""
    top = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    x = ranked.where("rank <= 2").groupBy("query_id").agg(top(1).alias("s1"), top(2).alias("s2"))
    clear = F.col("s2").isNull() | ((F.col("s1") >= threshold) & (F.col("s1") - F.col("s2") >= gap))
    return x.select("query_id", "s1", "s2", F.when(clear, "narrow").otherwise("broad").alias("breadth"))


def within_gap(ranked: DataFrame, gap: float) -> DataFrame:
    """Results at most `gap` below their query's first."""
    return ranked.withColumn("top", F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("top") - F.col("score") <= gap).drop("top")


def first_by_name(ranked: DataFrame) -> DataFrame:
    """The best ranked result of each displayed name."""
    order = Window.partitionBy("query_id", tx.display(F.col("name"))).orderBy("rank")
    return ranked.where(F.col("name").isNotNull()).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def availability(queries: DataFrame, filtered: DataFrame, unfiltered: DataFrame, most: float = 0.4) -> DataFrame:
    """(query_id, availability, id, partition) of queries with an active partition filter.

    queries(query_id, partition); results carry partition and values.  The filtered results are
    unavailable if there are none or the first looks like a placeholder; then the first unfiltered
    result of another partition (or of none) that doesn't is offered, or nothing is available.
    """
    first = filtered.where("rank = 1").select("query_id", (~is_placeholder(F.col("values"), most)).alias("usable"))
    other = unfiltered.alias("u").join(queries.select("query_id", F.col("partition").alias("asked")), "query_id").where(~F.col("partition").eqNullSafe(F.col("asked")) & ~is_placeholder(F.col("values"), most))
    best = other.groupBy("query_id").agg(F.min_by(F.struct("id", "partition"), "rank").alias("alternative"))
    out = queries.select("query_id").join(first, "query_id", "left").join(best, "query_id", "left")
    kind = F.when(F.col("usable"), "normal").when(F.col("alternative").isNotNull(), "unavailable_here").otherwise("unavailable_everywhere")
    here = kind == "unavailable_here"
    return out.select("query_id", kind.alias("availability"), F.when(here, F.col("alternative.id")).alias("id"), F.when(here, F.col("alternative.partition")).alias("partition"))


def _options(candidates: Column) -> Column:
    """struct<category, options>: one shared category, else the names' common leading words; null if neither."""
    names, categories = F.transform(candidates, lambda c: c["name"]), F.transform(candidates, lambda c: c["category"])
    shared = F.forall(categories, lambda c: F.coalesce(tx.stripped(c) != "", F.lit(False))) & (F.size(F.array_distinct(F.transform(categories, tx.display))) == 1)
    lists = F.transform(names, lambda n: F.split(n, " "))
    prefix = tx.common_prefix(lists)
    rest = F.filter(F.transform(lists, lambda x: F.array_join(F.slice(x, F.size(prefix) + 1, F.size(x)), " ")), lambda x: x != "")
    by_category = F.struct(F.element_at(categories, 1).alias("category"), names.alias("options"))
    by_prefix = F.struct(F.array_join(prefix, " ").alias("category"), rest.alias("options"))
    return F.when(shared, by_category).when((F.size(prefix) > 0) & (F.size(rest) >= 2), by_prefix)


def ambiguity(ranked: DataFrame, queries: DataFrame, gap: float = 0.3) -> DataFrame:
    """(query_id, category, options, reply) of queries that name a thing of several variants.

    ranked has name and category, queries resolved_query.  Close results of distinct names must
    form a group whose category the query mentions, and the query must not single out exactly one
    of them.  Queries without results have no row.
    """
    close = first_by_name(within_gap(ranked, gap))
    grouped = close.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "category"))).alias("c")).where("size(c) >= 2")
    x = grouped.select("query_id", F.transform("c", lambda r: F.struct(r["name"].alias("name"), r["category"].alias("category"))).alias("c")).withColumn("g", _options(F.col("c"))).where("g is not null")
    x = x.join(queries.select("query_id", tx.tokens(F.col("resolved_query")).alias("asked")), "query_id")
    x = x.withColumn("about", tx.tokens(F.col("g.category"))).withColumn("each", F.transform("g.options", tx.tokens))
    own = F.transform("each", lambda t, i: F.array_except(F.array_except(t, F.flatten(F.filter("each", lambda _, j: j != i))), F.col("about")))
    singled = F.size(F.filter(own, lambda t: F.arrays_overlap(t, F.col("asked")))) == 1
    kept = x.where(F.arrays_overlap("about", "asked") & ~singled)
    return kept.select("query_id", F.col("g.category").alias("category"), F.col("g.options").alias("options"), tx.clarification(F.col("g.category"), F.col("g.options")).alias("reply"))


def specificity_note(text: Column, resolved: Column) -> Column:
    """The resolved query, if it says more than the text; else null."""
    resolved = tx.stripped(resolved)
    more = F.size(F.array_except(tx.tokens(resolved), tx.tokens(text))) > 0
    return F.when((resolved != "") & (resolved != tx.stripped(text)) & more, resolved)


#: Intents that a text pipeline answers.
TEXT_PIPELINE = "text_pipeline"


def route(intent: Column, targets: dict[str, str]) -> Column:
    """Target of an intent; unknown intents go to the text pipeline."""
    out = F.when(F.lit(False), intent)
    for name, target in targets.items():
        out = out.when(intent == name, target)
    return out.otherwise(TEXT_PIPELINE)


def in_closed_set(label: Column, allowed: Column, fallback: str) -> Column:
    return F.when(F.array_contains(allowed, label), label).otherwise(fallback)


def routing_outcome(target: Column) -> Column:
    return F.when(target == TEXT_PIPELINE, "ai_handled").otherwise("not_implemented")


def topic_of(override: Column, outcome: Column, query: Column, classified: Column) -> Column:
    """An override wins; otherwise only queries with an outcome and some text are classified."""
    return F.coalesce(override, F.when(outcome.isNotNull() & (tx.stripped(query) != ""), classified))


def outcome_status(availability: Column, ambiguous: Column, generated: Column, verified: Column) -> Column:
    """Outcome of a turn of the text pipeline, first cause first."""
    return F.when(ambiguous, "clarification_requested").when(availability == "unavailable_everywhere", "not_found").when(~generated, "technical_error").when(~verified, "escalated_verification").otherwise("answered")


def template_reply(turns: DataFrame, templates: DataFrame, otherwise: Column) -> DataFrame:
    """Replies mapped to a (tenant, dialogue state) win over retrieved ones."""
    return turns.join(templates.select("client_id", "dialogue_state", F.col("template").alias("_template")), ["client_id", "dialogue_state"], "left").withColumn("reply", F.coalesce("_template", otherwise)).drop("_template")
