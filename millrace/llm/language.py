"""Language identification by the nearest of several centroids a language.

A text is a vector of hashed byte n-grams of its letters, weighted by TF-IDF and of unit length.
Each language's sample is clustered by spherical k-means, so that a language with several kinds of
texts has several centroids; a text gets the language of the centroid with the largest cosine.  A
text farther from that centroid than nearly all of its own members were is marked as rejected.

Document frequencies cover all rows that may be learnt from; only the centroids are fitted on a
bounded sample, each language's in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, with_computed

#: Buckets of the n-grams.
BITS = 12
BUCKETS = 1 << BITS
#: Bytes of an n-gram; blanks stand for all that is no letter.
SIZES = (2, 3, 4)
#: Most texts, and bytes of texts, of a language that its centroids are fitted on; taken by a hash of the text.
SAMPLE_EACH, SAMPLE_BYTES = 1500, 8 << 20
#: Most languages; of more labels, the most frequent are learnt.
LANGUAGES = 500
#: Centroids a language, rounds of k-means, and the least share of the sample that a centroid must have.
CLUSTERS, ROUNDS, LEAST_SHARE = 4, 10, 0.02
#: A text is rejected beyond the distance that this share of a centroid's own members exceed.
BEYOND = 0.005
#: Rows whose crc32(id as text) modulo 3 is this are held out.
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
#: Texts whose dense vectors a task holds at once.
MOST_TEXTS = 256

_LETTERS = np.full(256, 0x20, np.uint8)
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTERS[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTERS[_b] = _b + 0x20


def _gram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS): how often each text has the n-grams of each bucket."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    # every text begins with a blank, which also ends the one before it
    letters, owners = np.full(len(raw) + n + 1, 0x20, np.uint8), np.zeros(len(raw) + n + 1, np.int32)
    at = np.arange(len(raw)) + owner + 1
    letters[at], owners[at] = _LETTERS[raw], owner
    owners[offsets + np.arange(n + 1)] = np.arange(n + 1)
    kept = np.append((letters[:-1] != 0x20) | (letters[1:] != 0x20), True)
    letters, owners = letters[kept].astype(np.uint32), owners[kept]
    out = np.zeros(n * BUCKETS, np.int64)
    for size in SIZES:
        m = len(letters) - size + 1
        if m <= 0:
            continue
        code = np.full(m, size, np.uint32)
        for i in range(size):
            code = code * np.uint32(257) + letters[i : i + m]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = owners[:m] == owners[size - 2 : size - 2 + m]  # the last byte may be the next text's blank
        key = owners[:m][inside].astype(np.int64) * BUCKETS + bucket[inside]
        out += np.bincount(key, minlength=len(out))
    return out.reshape(n, BUCKETS)


def gram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of some texts at a time; a text of many bytes is counted piece by piece."""
    for i, j in tk.slices(column):
        for a in range(i, j, MOST_TEXTS):
            raw, offsets = tk.text_buffer(column.slice(a, min(MOST_TEXTS, j - a)))
            if len(offsets) == 2 and len(raw) > tk.SLICE_BYTES:
                yield a, sum(_gram_counts(raw[s : s + tk.SLICE_BYTES], np.array([0, min(tk.SLICE_BYTES, len(raw) - s)])) for s in range(0, len(raw), tk.SLICE_BYTES))
            else:
                yield a, _gram_counts(raw, offsets)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length of log(1 + count) * idf; all zeros for a text without n-grams."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosine of each) by spherical k-means, without chance: it begins with rows of even spacing by their cosine to the mean."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(CLUSTERS, len(x))
    centroids = x[order[((np.arange(k) + 0.5) * len(x) / k).astype(int)]]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sizes = np.bincount(nearest, minlength=len(centroids))
        keep = np.flatnonzero(sizes >= max(1, LEAST_SHARE * len(x)))
        sums = np.stack([x[nearest == c].sum(axis=0) for c in keep])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosine = x @ centroids.T
    nearest, best = cosine.argmax(axis=1), cosine.max(axis=1)
    own = [best[nearest == c] for c in range(len(centroids))]
    return centroids, np.array([np.quantile(v, BEYOND) if len(v) else 1.0 for v in own])


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with an n-gram, and of those with one of each bucket; collects BUCKETS + 1 rows."""

    def count(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for _, counts in gram_counts(b.column(0)):
                total[:BUCKETS] += (counts > 0).sum(axis=0)
                total[BUCKETS] += counts.any(axis=1).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["bucket", "n"])

    found = {r["bucket"]: r["n"] for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    return found.get(BUCKETS, 0), np.array([found.get(i, 0) for i in range(BUCKETS)])


class Model:
    """Centroids with their languages, in the order of the languages' frequencies, and the weights of the buckets."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.centroids, self.least = idf, languages, centroids, least

    def nearest(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, its cosine) of each text."""
        number, cosine = np.zeros(len(column), np.int64), np.zeros(len(column))
        for a, counts in gram_counts(column):
            c = unit_vectors(counts, self.idf) @ self.centroids.T
            number[a : a + len(c)], cosine[a : a + len(c)] = c.argmax(axis=1), c.max(axis=1)
        return number, np.clip(cosine, 0.0, 1.0)


def train(rows: Rows, id_col: str, lang_col: str) -> Model | None:
    """The model of the rows that aren't held out and whose text has a letter; None without any."""
    fold = F.crc32(rows.col(id_col).cast("string").cast("binary")) % FOLDS
    known = rows.frame.where(fold != HELD_OUT).where(rows.col(lang_col).isNotNull() & F.coalesce(rows.text.rlike(r"\p{L}"), F.lit(False)))
    known = known.select(rows.col(lang_col).cast("string").alias("_lang"), rows.text)
    counts = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    n, df = _frequencies(known.select("_text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    spark = rows.frame.sparkSession
    rates = spark.createDataFrame([(r["_lang"], min(1.0, 2 * SAMPLE_EACH / r["_n"])) for r in counts], "_lang string, _rate double")
    hashed = known.withColumn("_h", F.xxhash64("_text")).join(F.broadcast(rates), "_lang").where(F.pmod("_h", F.lit(1 << 32)) < F.col("_rate") * float(1 << 32))
    distinct = hashed.groupBy("_lang", "_h").agg(F.min("_text").alias("_text"))  # copies count once
    order = Window.partitionBy("_lang").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    sample = distinct.withColumns({"_no": F.row_number().over(Window.partitionBy("_lang").orderBy("_h")), "_bytes": F.sum(F.octet_length("_text")).over(order)})
    sample = sample.where(f"_no = 1 or (_no <= {SAMPLE_EACH} and _bytes <= {SAMPLE_BYTES})").select("_lang", "_h", "_text")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("_h").combine_chunks()
        x = np.concatenate([unit_vectors(c, idf) for _, c in gram_counts(table.column("_text").combine_chunks())])
        centroids, least = cluster(x)
        return pa.table({"lang": pa.array([table.column("_lang")[0].as_py()] * len(least)), "least": pa.array(least, pa.float64()), "centroid": pa.array(list(centroids), pa.list_(pa.float32()))})

    found = sample.groupBy("_lang").applyInArrow(fit, "lang string, least double, centroid array<float>").toArrow()
    place = {r["_lang"]: i for i, r in enumerate(counts)}
    langs = found.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (place[langs[i]], found.column("least")[i].as_py()))
    centroids = np.array(found.column("centroid").combine_chunks().flatten(), np.float32).reshape(len(langs), BUCKETS)
    return Model(idf, [langs[i] for i in order], centroids[order], found.column("least").to_numpy()[order])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of `docs`, and held_out, lang_pred, score (the cosine, 0 to 1), rejected.

    A null text, or one without a letter, is `und` with score 0, and rejected.  Others get the
    nearest language, the most frequent one on a tie; those far from all centroids are marked as
    rejected, for the caller to keep or drop.  A null id is never held out nor learnt from; ids may
    repeat.  Without a learnt row all are `und`.  An input column with a result's name, in any case,
    is replaced.  Three passes over the texts, no shuffle but of counts and the sample.
    """
    model = train(Rows(docs, text_col), id_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES * CLUSTERS centroids
    result = ("held_out", "lang_pred", "score", "rejected")
    rows = Rows(docs, text_col, result)
    fold = F.coalesce(F.crc32(rows.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))

    def compute(texts):
        m = shared.value
        if m is None:
            return [pa.nulls(len(texts), pa.string()), pa.array(np.zeros(len(texts))), pa.array(np.ones(len(texts), bool))]
        number, cosine = m.nearest(texts)
        return [pa.array(m.languages, pa.string()).take(pa.array(number)), pa.array(cosine), pa.array(cosine < m.least[number])]

    letter = F.coalesce(rows.text.rlike(r"\p{L}"), F.lit(False))
    held = rows.frame.select(F.struct(rows.row, fold.alias("held_out"), letter.alias("letter")).alias("both"), rows.text)
    out = with_computed(held, "_text", "lang_pred string, score double, rejected boolean", compute)
    told = F.col("both.letter") & F.col("lang_pred").isNotNull()
    return rows.result(
        out.select("both._row", "_text", "both.held_out", F.when(told, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(told, F.col("score")).otherwise(0.0).alias("score"), F.when(told, F.col("rejected")).otherwise(True).alias("rejected")),
        *result,
    )
