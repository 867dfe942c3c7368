"""Benchmark decontamination by winnowed fingerprints that Spark joins.

Both sides keep the smallest k-gram hash of every window (runs of windows share theirs), so two
texts that share a window share a fingerprint.  An item shorter than a window is one window of its
own length and its own fingerprint.

1. Tasks list each item's distinct windows with their fingerprints.
2. A bitmap of fixed greatest size, filled by an aggregation, tells the tasks that scan the
   documents which fingerprints may be an item's; they send on only windows of such ones.
3. These are joined with the items' fingerprints, and each hit is extended to whole windows, which
   are compared by two independent hashes.  Windows that repeat in a text travel once, with the
   runs of their places; nowhere do places meet places.
4. Hits are gathered by a digest of the text, so that copies are judged once.

Documents join their hits by digest, however few these are, so the work grows in proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, discard, written

#: Words of a window and of a fingerprinted gram.
WINDOW, GRAM = 13, 5
#: Bits of the bitmap for each fingerprint, and its least and greatest size as a power of two (1 and 16 MB).
BITS_EACH, BITS_LEAST, BITS_MOST = 64, 23, 27
_PAGE = 1 << 15  # bits of one row of the bitmap's aggregation
_WINDOWS = "n int, fp long, h long, h2 long"


class Windows:
    """The windows of n words of some texts: fingerprint and two hashes from each word on."""

    def __init__(self, texts: pa.Array, gram: int):
        self.w = tk.Words(texts, tk.ALNUM_WORDS, lower=True)
        self.h, self.gram = self.w.hashes(), gram
        self.h2: np.ndarray | None = None

    def places(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.w.full(n))

    def fingerprints(self, n: int, whole: bool) -> np.ndarray:
        """From each word on; `whole`: the window itself, else its smallest gram."""
        if whole:
            return tk.as_long(tk.grams(self.h, n))
        return tk.as_long(tk.sliding_min(tk.grams(self.h, self.gram), n - self.gram + 1))

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.h2 is None:
            self.h2 = self.w.hashes(1)
        return tk.as_long(tk.grams(self.h, n)), tk.as_long(tk.grams(self.h2, n))


def bit_of(fp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A fingerprint's place in a bitmap of 2**bits bits."""
    return (tk.mix(fp.view(np.uint64) + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(item, n, fp, h, h2): the distinct windows of each item, whose id is told as a string."""
    rows = Rows(benchmark, text_col)

    def scan(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                part = b.slice(i, j - i)
                x, ids = Windows(part.column("_text"), gram), part.column("item")
                sizes = np.minimum(x.w.counts, window)
                for n in np.unique(sizes[sizes > 0]).tolist():
                    at = x.places(n)
                    at = at[sizes[x.w.text[at]] == n]
                    h, h2 = (v[at] for v in x.hashes(n))
                    new = np.unique(np.stack([x.w.text[at], h, h2]), axis=1, return_index=True)[1]
                    at, h, h2 = at[new], h[new], h2[new]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.w.text[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(x.fingerprints(n, n < window)[at]), pa.array(h), pa.array(h2)], ["item", "n", "fp", "h", "h2"])

    items = rows.frame.select(rows.col(item_col).cast("string").alias("item"), rows.text).where("item is not null and _text is not null")
    return items.mapInArrow(scan, f"item string, {_WINDOWS}").distinct()


def bitmap(fingerprints: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, as bytes, with those of the rows (n, fp) set; the driver gets them, at most 2**BITS_MOST."""

    def scan(batches):
        for b in batches:
            n, fp = b.column("n").to_numpy(), b.column("fp").to_numpy()
            at = np.concatenate([bit_of(fp[n == x], int(x), bits) for x in np.unique(n)]) if len(n) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at))], ["bit"])

    pages = fingerprints.select("n", "fp").mapInArrow(scan, "bit long").groupBy(F.expr(f"bit div {_PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(bit % {_PAGE})").alias("map"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pages.collect():
        part = out[r["page"] * (_PAGE // 8) :][: _PAGE // 8]
        part[:] = np.frombuffer(r["map"], np.uint8)[: len(part)]
    return out


def document_windows(rows: Rows, known, lengths: list[int], bits: int, window: int, gram: int) -> DataFrame:
    """(digest, n, fp, h, h2, runs): windows of the documents whose fingerprint may be an item's.

    runs: stretches of the window's places in the text, start << 32 | length.
    """

    def scan(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                part = b.slice(i, j - i)
                x, digests = Windows(part.column("_text"), gram), part.column("_digest")
                for n in lengths:
                    at, fp = x.places(n), x.fingerprints(n, n < window)
                    bit = bit_of(fp[at], n, bits)
                    at = at[(known.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                    if not len(at):
                        continue
                    h, h2, text = *(v[at] for v in x.hashes(n)), x.w.text[at]
                    order = np.lexsort((at, h2, h, text))
                    at, h, h2, text = at[order], h[order], h2[order], text[order]
                    row = tk.run_starts(text, h, h2)
                    run = row | tk.run_starts(at - np.arange(len(at)))
                    first = np.flatnonzero(run)
                    length = np.diff(np.append(first, len(at)))
                    runs = ((at[first] - x.w.offsets[text[first]]) << 32) + length
                    of = np.searchsorted(first, np.append(np.flatnonzero(row), len(at))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([digests.take(pa.array(text[row])), pa.array(np.full(int(row.sum()), n, np.int32)), pa.array(fp[at[row]]), pa.array(h[row]), pa.array(h2[row]), pa.ListArray.from_arrays(of, pa.array(runs))], ["digest", "n", "fp", "h", "h2", "runs"])

    texts = rows.frame.select(F.md5(rows.text.cast("binary")).alias("_digest"), rows.text).where("_text is not null")
    return texts.mapInArrow(scan, f"digest string, {_WINDOWS}, runs array<long>")


def hits(rows: Rows, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(digest, spans, items): for each text with hits the runs of its hit windows (array of (n, runs)) and the items' ids."""
    spark = rows.frame.sparkSession
    fingerprints = written(items.select("n", "fp").distinct(), "fingerprints")
    lengths = [r["n"] for r in fingerprints.select("n").distinct().orderBy("n").collect()]  # at most `window` of them
    bits = min(BITS_MOST, max(BITS_LEAST, (fingerprints.count() * BITS_EACH).bit_length()))
    known = spark.sparkContext.broadcast(bitmap(fingerprints, bits))
    # copies of a text send the same windows: one of each is left
    found = document_windows(rows, known, lengths, bits, window, gram).join(fingerprints, ["n", "fp"], "left_semi").groupBy("digest", "n", "h", "h2").agg(F.first("runs").alias("runs"))
    found = written(found.join(items.select("n", "h", "h2").distinct(), ["n", "h", "h2"], "left_semi"), "hit-windows")
    spans = found.groupBy("digest").agg(F.collect_list(F.struct("n", "runs")).alias("spans"))
    ids = found.select("digest", "n", "h", "h2").join(items, ["n", "h", "h2"]).select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = written(spans.join(ids, "digest"), "hits")
    discard(found, fingerprints)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of `docs`, and n_words, n_hit, items (ids as sorted strings) and contaminated.

    Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z.  A null text has
    no words; an item without words, without text or without id has no windows.  Documents are
    judged by their texts alone, so their ids may be of any type, be null or repeat.  Items that
    repeat an id count once.  Contaminated: n_hit > 0 and 20 * n_hit >= n_words.  An input column
    with a result's name, in any case, is replaced.  With an empty benchmark nothing is hit.
    """
    added = ("n_words", "n_hit", "items", "contaminated")
    rows = Rows(docs, text_col, added)
    items = written(item_windows(benchmark, item_col, item_text_col, window, gram), "item-windows")
    found = hits(rows, items, window, gram)
    discard(items)
    frame = rows.frame.select(rows.row, rows.text, F.md5(rows.text.cast("binary")).alias("digest")).join(found.hint("merge"), "digest", "left").select("_row", "_text", "spans", "items")
    schema = StructType([*frame.schema.fields[:2], *StructType.fromDDL("n_words long, n_hit long").fields, frame.schema.fields[3]])

    def count(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                part = b.slice(i, j - i)
                w, spans = tk.Words(part.column("_text"), tk.ALNUM_WORDS, lower=True), part.column("spans")
                n_hit = np.zeros(j - i, np.int64)
                for r in np.flatnonzero(np.asarray(spans.is_valid())).tolist():
                    v = spans[r].values
                    runs, sizes = tk.lists(v.field("runs"))
                    n = np.repeat(v.field("n").to_numpy(), np.diff(sizes))
                    n_hit[r] = tk.covered(runs >> 32, (runs & 0xFFFFFFFF) + n - 1, int(w.counts[r])).sum()
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), pa.array(w.counts.astype(np.int64)), pa.array(n_hit), part.column("items")], schema.names)

    out = frame.mapInArrow(count, schema)
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return rows.result(out, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), contaminated.alias("contaminated"))
