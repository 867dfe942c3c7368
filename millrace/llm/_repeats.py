"""Shared Spark steps of the exact substring operators.

A *unit* is a word or a byte, a *window* is k consecutive units of one text.  Two texts that
share a window also share its *anchor*: the smallest hash among the window's m-grams.  Anchors
are about a fifth as many as windows, so they find the texts' repeated regions at little cost;
the operators then decide every window of those regions exactly.

Rows of one hot hash never meet in one task: each map task first groups a bounded buffer by
hash, settles what it can there, and sends on one row for each hash (or as many as one document
has).  Settled rows pass through on a route of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows

#: Rows that a map task gathers before it groups them by hash.
BUFFER_ROWS = 1_000_000

#: texts -> (text number of each unit, whether a whole window starts there, that window's anchor)
Finder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never split a run of equal keys; the batches come sorted by key."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if held and cut == 0 and held_key == k[-1]:
            held.append(b)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held, held_key = [b.slice(cut)], k[-1]
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: Rows, id_col: str) -> DataFrame:
    """_id, _text, _row (all other kept columns), _dup: ordinal among rows of one id.

    Rows without an id are left out.  Dealt by id; every later pass over the texts selects the
    same columns, so that Spark shuffles the texts once and reuses that exchange.
    """
    out = rows.frame.where(rows.id(id_col).isNotNull()).select(rows.id(id_col).alias("_id"), rows.text, rows.row)
    return out.withColumn("_dup", F.row_number().over(Window.partitionBy("_id").orderBy("_text")).cast("long") - 1)


def with_spans(rows: Rows, id_col: str, spans: DataFrame) -> list[DataFrame]:
    """(_text, _row, _dup, _spans) of the rows with an id and of those without; spans(_id, loc, n)."""
    gathered = spans.groupBy("_id").agg(F.collect_list(F.struct("loc", "n")).alias("_spans"))
    nameless = rows.frame.where(rows.id(id_col).isNull()).select(rows.text, rows.row, F.lit(0).cast("long").alias("_dup"), F.lit(None).cast("array<struct<loc:long,n:long>>").alias("_spans"))
    return [numbered(rows, id_col).join(gathered, "_id", "left").select("_text", "_row", "_dup", "_spans"), nameless]


def windows(h: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the whole windows' starts, anchor of the window from each position)."""
    counts = np.diff(first)
    ok = np.arange(len(h)) - np.repeat(first[:-1], counts) + k <= np.repeat(counts, counts)
    return ok, tk.sliding_min(tk.grams(h, m), k - m + 1)


def repeated_anchors(rows: Rows, id_col: str, find: Finder, most: int = tk.SLICE_BYTES) -> DataFrame:
    """(_id, anchors): for each id the anchors that another id has too."""

    def emit(batches):
        hashes, ids, n = [], [], 0

        def flush():
            h, d = np.concatenate(hashes), np.concatenate(ids)
            order = tk.ordered(h, d)
            h, d = h[order], d[order]
            new = tk.run_starts(h, d)
            h, d = h[new], d[new]
            group = np.cumsum(tk.run_starts(h)) - 1
            sure = np.bincount(group)[group] > 1
            first = tk.run_starts(h)
            # a settled group sends its first row once to the hash's route, as evidence for other tasks
            out_h, out_d = np.concatenate([h[~sure], h[sure], h[sure & first]]), np.concatenate([d[~sure], d[sure], d[sure & first]])
            state = np.repeat(np.array([0, 1, 2], np.int8), [int((~sure).sum()), int(sure.sum()), int((sure & first).sum())])
            yield from pa.Table.from_arrays([pa.array(out_h), pa.array(out_d), pa.array(state)], ["hash", "_id", "state"]).to_batches(max_chunksize=100_000)

        for b in batches:
            ids_of, text = b.column("_id"), b.column("_text")
            for i, j in tk.slices(text, most):
                text_no, ok, anchor = find(text.slice(i, j - i))
                text_no, a = text_no[ok], tk.as_long(anchor[ok])
                keep = tk.run_starts(a, text_no)
                hashes.append(a[keep])
                ids.append(ids_of.slice(i, j - i).to_numpy(zero_copy_only=False)[text_no[keep]])
                n += int(keep.sum())
                if n >= BUFFER_ROWS:
                    yield from flush()
                    hashes, ids, n = [], [], 0
        if n:
            yield from flush()

    def judge(batches):
        for t in whole_groups(batches, "hash"):
            h, d, s = (t.column(c).to_numpy() for c in ("hash", "_id", "state"))
            new = tk.run_starts(h)
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            hit = (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)) | (np.maximum.reduceat(s, first) > 0)
            keep = (s == 1) | ((s == 0) & hit[group])
            yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(h[keep])], ["_id", "hash"])

    texts = rows.frame.where(rows.id(id_col).isNotNull()).select(rows.id(id_col).alias("_id"), rows.text)
    found = texts.mapInArrow(emit, "hash long, _id long, state byte")
    routed = found.repartition(route("state = 1", "_id", "hash")).sortWithinPartitions("hash")  # one key: a radix sort
    return routed.mapInArrow(judge, "_id long, hash long").groupBy("_id").agg(F.collect_list("hash").alias("_anchors"))


def route(settled: str, own: str, key: str) -> Column:
    """Settled rows go by their own id, the others by the shared key."""
    return F.when(F.expr(settled), F.xxhash64(own)).otherwise(F.col(key))


def marked(text_no: np.ndarray, anchor: np.ndarray, anchors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each anchor of a text whether it is in that text's list."""
    salt = tk.mix(np.arange(len(offsets) - 1, dtype=np.uint64) + np.uint64(1))
    known = np.unique(tk.mix(anchors.view(np.uint64) ^ np.repeat(salt, np.diff(offsets))))
    if not len(known):
        return np.zeros(len(anchor), bool)
    wanted = tk.mix(anchor ^ salt[text_no])
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[at] == wanted
