"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A logistic model scores each sentence from hashed words and
word prefixes; the document's score is the noisy-or of its sentences, 1 - prod(1 - p).  Only
document labels are known in training: the gradient of the noisy-or decides which sentences carry
them.  The same sentence scores then locate the offending sentences.

Training runs in one Spark task on a bounded sample of labelled rows; scoring is one pass over all
texts with the selected features' weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, with_computed

#: Most labelled documents of either label in the training sample, and most bytes of their texts, taken by a hash of the id.
SAMPLE_EACH, SAMPLE_BYTES = 3000, 32 << 20
#: Most features that the model keeps, and the fewest toxic documents that hold one.
FEATURES, LEAST_DOCS = 4096, 3
#: Byte lengths of the word prefixes.
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
#: Rows whose crc32(id as text) modulo 4 is this are held out.
FOLDS, HELD_OUT = 4, 2
STEPS, RATE, DECAY = 400, 0.05, 1e-3
THRESHOLD = 0.3

_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Bags:
    """Feature hashes of each word of some texts, their sentence and text numbers."""

    def __init__(self, column: pa.Array):
        w = tk.Words(column, tk.ALNUM_WORDS, lower=True)
        stops = np.concatenate([[0], np.cumsum(_STOP[w.bytes])])
        key = stops[w.starts] if len(w) else np.zeros(0, np.int64)
        new = tk.run_starts(w.text, key) if len(w) else np.zeros(0, bool)
        sentence = np.cumsum(new) - 1
        self.sentence_text = w.text[new]
        self.sentence_start = w.starts[new] - w.text_offsets[self.sentence_text]
        features, owners = [w.hashes()], [sentence]
        for n in PREFIXES:
            long = np.flatnonzero(w.ends - w.starts > n)
            features.append(w.span_hashes(w.starts[long], w.starts[long] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            owners.append(sentence[long])
        self.feature, self.sentence = np.concatenate(features), np.concatenate(owners)


def hazard(logit: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of each sentence above that of a sentence without evidence, 0 at least.

    So a text's score grows with its evidence, and not with its number of harmless sentences.
    """
    return np.maximum(np.logaddexp(0, logit) - np.logaddexp(0, bias), 0)


def noisy_or(hazards: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """1 - prod(1 - p) over each text's sentences; 0 for a text without sentences."""
    return -np.expm1(-np.bincount(text, hazards, minlength=n_texts)) if len(hazards) else np.zeros(n_texts)


def fit(column: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, weights, bias)."""
    n, y = len(column), label.astype(float)
    n1, n0 = max(1, int((label > 0).sum())), max(1, int((label == 0).sum()))
    distinct, a, b = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j in tk.slices(column):  # document counts of each feature
        bags = Bags(column.slice(i, j - i))
        owner = bags.sentence_text[bags.sentence]
        order = np.lexsort((owner, bags.feature))
        feature, owner = bags.feature[order], owner[order]
        new = tk.run_starts(feature, owner)
        feature, toxic = feature[new], label[i + owner[new]] > 0
        merged, inverse = np.unique(np.concatenate([distinct, feature]), return_inverse=True)
        a = np.bincount(inverse, np.concatenate([a, toxic]), minlength=len(merged))
        b = np.bincount(inverse, np.concatenate([b, ~toxic]), minlength=len(merged))
        distinct = merged
    p1, p0 = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    gain = np.where((a >= LEAST_DOCS) & (p1 > p0), p1 * np.log(p1 / p0) + (1 - p1) * np.log((1 - p1) / (1 - p0)), 0)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    keys = np.sort(distinct[best[gain[best] > 0]])
    if not len(keys):
        return keys, np.zeros(0), -8.0
    parts, owners, base = [], [], 0
    for i, j in tk.slices(column):
        bags = Bags(column.slice(i, j - i))
        number, own = lookup(keys, bags)
        parts.append((number.astype(np.int32), (own + base).astype(np.int32)))
        owners.append(bags.sentence_text + i)
        base += len(bags.sentence_text)
    column_no, sentence = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.concatenate(owners)
    weight, bias = np.full(len(keys), 0.1), -5.0  # evidence counts from the first step on
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for step in range(1, STEPS + 1):
        logit = bias + np.bincount(sentence, weight[column_no], minlength=len(text))
        p = 1 / (1 + np.exp(-logit))
        own = hazard(logit, bias)
        bag = np.clip(noisy_or(own, text, n), 1e-9, 1 - 1e-9)
        # d loss / d hazard: 1 for a clean bag, -(1 - bag) / bag for a toxic one
        slope = (np.where(y > 0, -(1 - bag) / bag, 1.0) * share)[text] * (own > 0)
        grad = np.append(np.bincount(column_no, (slope * p)[sentence], minlength=len(keys)) + DECAY * weight / len(keys), (slope * (p - 1 / (1 + np.exp(-bias)))).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return keys, weight, float(bias)


def lookup(keys: np.ndarray, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, sentence) of the distinct known features of each sentence."""
    at = np.minimum(np.searchsorted(keys, bags.feature), len(keys) - 1)
    known = keys[at] == bags.feature
    pairs = np.unique(bags.sentence[known].astype(np.int64) * len(keys) + at[known])
    return pairs % len(keys), pairs // len(keys)


def score(column: pa.Array, model: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, list[list[int]]]:
    """(noisy-or score of each text, byte starts of its sentences that score 0.3 or more alone)."""
    keys, weight, bias = model
    bags = Bags(column)
    n = len(bags.sentence_text)
    logit = np.full(n, bias)
    if len(keys) and n:
        column_no, sentence = lookup(keys, bags)
        logit += np.bincount(sentence, weight[column_no], minlength=n)
    where: list[list[int]] = [[] for _ in range(len(column))]
    own = hazard(logit, bias)
    for s in np.flatnonzero(-np.expm1(-own) >= THRESHOLD):
        where[bags.sentence_text[s]].append(int(bags.sentence_start[s]))
    return noisy_or(own, bags.sentence_text, len(column)), where


def train(rows: Rows, labels: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labelled rows outside the held-out fold.

    An id labelled twice counts as toxic if any label is; of an id with several texts the smallest
    one is learnt from.
    """
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % FOLDS
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.where(fold != HELD_OUT).groupBy("_id").agg((F.max("_toxic") > 0).alias("_toxic"))
    order = [F.xxhash64(F.col("_id")), F.col("_id")]
    sample = known.where("_toxic").orderBy(*order).limit(SAMPLE_EACH).union(known.where("not _toxic").orderBy(*order).limit(SAMPLE_EACH))
    # at most 2 * SAMPLE_EACH ids are broadcast, and as many rows are left
    texts = rows.frame.select(rows.col(id_col).alias("_id"), rows.text).join(F.broadcast(sample), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    so_far = Window.partitionBy("_toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("_bytes", F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(so_far)).where(f"_bytes <= {SAMPLE_BYTES}")

    def learn(batches):
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        t = t.sort_by([("_id", "ascending")]).combine_chunks()
        keys, weight, bias = fit(t.column("_text").combine_chunks(), t.column("_toxic").to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(tk.as_long(np.append(keys, np.uint64(0)))), pa.array(np.append(weight, bias))], ["key", "weight"])

    found = texts.select("_id", "_text", "_toxic").repartition(1).mapInArrow(learn, "key long, weight double").collect()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), -8.0
    return np.array([r["key"] for r in found[:-1]], np.int64).view(np.uint64), np.array([r["weight"] for r in found[:-1]]), found[-1]["weight"]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and held_out, score, predicted, offending (byte starts of sentences).

    A text without words (or null) has score 0.  A null id is never held out nor trained on.
    Ids may repeat, and be of any type that labels' ids have: every row is scored by its own text.
    Without labels all scores are 0.  An input column with a result's name, in any case, is replaced.
    """
    model = train(Rows(docs, text_col), labels, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    rows = Rows(docs, text_col, ("held_out", "score", "predicted", "offending"))
    fold = F.coalesce(F.crc32(rows.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))

    def compute(texts):
        p, where = score(texts, shared.value)
        return [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(where, pa.list_(pa.int64()))]

    held = rows.frame.select(F.struct(rows.row, fold.alias("held_out")).alias("both"), rows.text)
    out = with_computed(held, "_text", "score double, predicted int, offending array<long>", compute)
    return rows.result(out.select("both._row", "_text", "both.held_out", "score", "predicted", "offending"), "held_out", "score", "predicted", "offending")
