"""Quality rules: counts of each text and a hashed n-gram log-likelihood ratio, without Python workers.

Unigrams and bigrams of words are hashed into a fixed number of buckets.  The bucket counts of all
trusted documents and of all documents are two multinomials; a document's score is the mean, over
its n-grams, of the log ratio of the two smoothed bucket probabilities.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._columns import GAP_CHARS, computed_once, let, words
from millrace.llm._shared import Rows, discard, written

#: Buckets of the multinomials: the two count tables and the table of ratios have this many rows.
BUCKETS = 8192
#: Added to each bucket's count.
SMOOTHING = 1.0
#: A document is kept from this quantile of the trusted documents' own scores on.
QUANTILE = 0.01
#: Ranges that a round of the search for a quantile counts.
RANGES = 4096
#: Words of a window in the repetition rule.
WINDOW = 8  # `_repeat_words` builds it of bigrams by two doublings
SYMBOLS = "#*$%&|<>"


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _joined(h: Column, step: int) -> Column:
    """Each hash joined with the one `step` places on, or with the end of the text."""
    return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def _grams(texts: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, and _h and _b: hashes of _text's words and bigrams (the last word's is with the end)."""
    hashed = texts.select(*columns, _hashes(F.col("_text")).alias("_h"))
    return hashed.withColumn("_b", _joined(F.col("_h"), 1))


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _trusted_ids(labels: DataFrame) -> DataFrame:
    """(_id): all ids of label quality 1."""
    return labels.where("quality = 1").select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()


def ratios(rows: Rows, trusted: DataFrame, id_col: str) -> list[float]:
    """Log ratio of each bucket: trusted documents against all documents.

    Texts are shuffled once, to the trusted ids, of which there may be any number.  Collects BUCKETS
    rows of counts at most.  All zero where no document is trusted.
    """
    marked = rows.frame.select(rows.col(id_col).alias("_id"), rows.text).join(trusted.withColumn("_trusted", F.lit(1)).hint("merge"), "_id", "left")
    counts = _grams(marked, "_trusted").select("_trusted", F.explode(F.concat("_h", "_b")).alias("gram")).select("_trusted", _bucket(F.col("gram")).alias("bucket"))
    counts = written(counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")), "bucket-counts")
    found = {r["bucket"]: (r["target"], r["raw"]) for r in counts.collect()}
    discard(counts)
    n_target, n_raw = sum(t for t, _ in found.values()), sum(r for _, r in found.values())
    if not n_target:
        return [0.0] * BUCKETS
    share = lambda n, total: math.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS))
    return [share(found.get(b, (0, 0))[0], n_target) - share(found.get(b, (0, 0))[1], n_raw) for b in range(BUCKETS)]


def _nth(values: DataFrame, n: int, low: float, high: float) -> float:
    """The n-th smallest `llr`, from 0, of values from low to high: counts of ever narrower ranges, RANGES rows at a time."""
    while low < high:
        at = F.least(F.floor((F.col("llr") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        inside = values.where(F.col("llr").between(low, high)).groupBy(at.alias("at"))
        for r in inside.agg(F.count(F.lit(1)).alias("n"), F.min("llr").alias("low"), F.max("llr").alias("high")).orderBy("at").collect():
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
    return low


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of `llr`, between two values as `percentile` has it; None without values."""
    count, low, high = values.agg(F.count("llr"), F.min("llr"), F.max("llr")).first()
    if not count:
        return None
    place = share * (count - 1)
    before, after = (_nth(values, n, low, high) for n in (math.floor(place), math.ceil(place)))
    return before + (place - math.floor(place)) * (after - before)


def threshold_of(rows: Rows, trusted: DataFrame, id_col: str, table: Column) -> float:
    """The QUANTILE of all trusted documents' scores, over rows with a word; minus infinity without any.

    All documents are scored, and only their ids and scores are shuffled to the trusted ids.
    """
    texts = _grams(rows.frame.select(rows.col(id_col).alias("_id"), rows.text), "_id")
    scores = computed_once(texts, ["_id"], n=F.size("_h"), llr=_score(F.col("_h"), F.col("_b"), table)).where("n > 0")
    scores = written(scores.join(trusted, "_id").select("llr"), "trusted-scores")
    score = quantile(scores, QUANTILE)
    discard(scores)
    return -math.inf if score is None else score


def _repeat_words(bigrams: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more; a window is two pairs of bigrams."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), s + WINDOW) - s))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def starts(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda p: F.filter(p, lambda x, j: F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False)) | F.coalesce(F.when(j > 0, x["h"] == F.get(p, j - 1)["h"]), F.lit(False)))
        return F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(starts(windows), covered))

    windows = F.slice(let(_joined(bigrams, 2), lambda h: _joined(h, 4)), F.lit(1), F.size(bigrams) - WINDOW + 1)
    return F.when(F.size(bigrams) < WINDOW, F.lit(0)).otherwise(let(windows, count))


def _score(h: Column, bigrams: Column, table: Column) -> Column:
    pair = lambda x, y: F.get(table, _bucket(x)) + F.get(table, _bucket(y))
    total = F.aggregate(F.zip_with(h, bigrams, pair), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(h) == 0, F.lit(0.0)).otherwise(total / (2 * F.size(h)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """All columns of `docs`, and the counts, base_failed, llr and kept of each row.

    A null or empty text has no words: all counts 0, llr 0.0, base_failed.  Rows are judged alone,
    so ids may be of any type, be null or repeat; a null id is never trusted.  Without a threshold
    it is the QUANTILE of the trusted documents' scores; without trusted documents the base rules
    decide.  An input column with a result's name, in any case, is replaced.  Three passes over the
    texts, the first of which shuffles them; two with a threshold.
    """
    result = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")
    rows, trusted = Rows(docs, text_col, (*result, "base_failed", "kept")), _trusted_ids(labels)
    table = F.split(F.lit(",".join(map(repr, ratios(rows, trusted, id_col)))), ",").cast("array<double>")
    least = threshold_of(rows, trusted, id_col, table) if threshold is None else threshold
    text = F.coalesce("_text", F.lit(""))
    length = lambda chars: F.length(_without(text, chars))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != ""), lambda v: F.size(v) - F.size(F.array_distinct(v)))
    values = [let(F.col("_h"), F.size), length(GAP_CHARS), F.length(text) - length(SYMBOLS), lines, let(F.col("_b"), _repeat_words)]
    values = {k: v.cast("long") for k, v in zip(result, values, strict=False)} | {"llr": _score(F.col("_h"), F.col("_b"), table)}
    counted = computed_once(_grams(rows.frame.select(rows.row, rows.text), "_row", "_text"), ["_row", "_text"], **values)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
    return rows.result(out, *result, "base_failed", "kept")
