"""Ports to models, chosen by name; an unknown name gives None.

The defaults are deterministic, so that pipelines run and test without a model server.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import retrieval

DIMENSIONS = 64


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed hashed bag of words, of unit length; all zeros without words, null for null."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    bucket = lambda c: F.pmod(c, F.lit(dimensions)).cast("int").alias("bucket")
    coded = F.array_sort(F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda c: F.struct(bucket(c), F.when(c < 0, -1).otherwise(1).alias("sign"))))
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    state = lambda out, at, n: F.struct(out.alias("out"), at.alias("at"), n.alias("n"))

    def step(s: Column, w: Column) -> Column:
        """Words come bucket by bucket; a bucket's sum is written when the next one begins."""
        same = state(s["out"], s["at"], s["n"] + w["sign"])
        return F.when(w["bucket"] == s["at"], same).otherwise(state(F.concat(s["out"], F.array(s["n"]), zeros(w["bucket"] - s["at"] - 1)), w["bucket"], w["sign"]))

    begin = state(F.array().cast("array<int>"), F.lit(0), F.lit(0))
    held = F.aggregate(coded, begin, step, lambda s: F.concat(s["out"], F.array(s["n"]), zeros(F.lit(dimensions - 1) - s["at"])))
    counted = F.array(held)
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x)), F.lit(1e-30))
    scaled = F.transform(counted, lambda v: F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(norm(v), dimensions).alias("n")), lambda p: (p["v"] / p["n"]).cast("float")))
    return F.when(text.isNotNull(), F.get(scaled, 0))


def embed_missing(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Chunks whose missing embeddings are computed; the others never reach the model."""
    todo = chunks.where("embedding is null").withColumn("embedding", embed(F.col("content")))
    return chunks.where("embedding is not null").unionByName(todo)


def keyword_intent(text: Column, keywords: dict[str, tuple[str, ...]], fallback: str = "inquiry") -> Column:
    """The first intent one of whose words the text holds."""
    out = F.when(F.lit(False), F.lit(fallback))
    for intent, words in keywords.items():
        out = out.when(tx.contains_any(F.lower(text), words), intent)
    return out.otherwise(fallback)


def keyword_topic(text: Column, topics: Column) -> Column:
    """The first of a tenant's topics that the text names; null, which is never an error, if it names none."""
    asked = tx.tokens(text)
    return F.get(F.filter(topics, lambda t: (F.size(tx.tokens(t)) > 0) & (F.size(F.array_except(tx.tokens(t), asked)) == 0)), 0)


def unchanged_query(text: Column, history: Column) -> Column:
    """The rewriting that is safe without a model: the query as it was asked."""
    return tx.stripped(text)


EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hashed": hashed_embedding}
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"lexical": retrieval.lexical_overlap}
REWRITERS: dict[str, Callable[[Column, Column], Column]] = {"unchanged": unchanged_query}
TOPICS: dict[str, Callable[[Column, Column], Column]] = {"keyword": keyword_topic}
STORES: dict[str, Callable[..., DataFrame]] = {"exact": retrieval.dense_top_k}


def port(registry: dict, name: str):
    return registry.get(name)
