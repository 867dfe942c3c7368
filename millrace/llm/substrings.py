"""Substring deduplication by compacting a De Bruijn graph of word k-mers.

Every k consecutive words are an edge from the node of their first k - 1 words to that of their
last k - 1.  Regions that may stand in several documents (their anchor is repeated, see `_repeats`)
are cut into runs, consecutive k-mers with one anchor.  Equal runs are one string, that of their
first document; only its edges are built.  An edge's source is its first place in the smallest
document that holds it.

1. Nodes are counted: one that a single repeated edge enters and a single one leaves doesn't
   branch.  A join through such nodes links edges whose sources follow each other.
2. A join with the links leaves the edges that begin a path: the links compact the graph to
   nonbranching paths, each a span of its source.
3. Stretches of a later document that run along a source are cut where its paths begin, and both
   coordinates of every piece are read again from the texts: their words are compared by an
   independent digest before anything is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import _repeats as rp
from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, discard, schema_of, written

#: Words of a k-mer, and of the grams among which its anchor is chosen.
WINDOW, ANCHOR = 13, 4
_DUP = 40  # a location is the row's ordinal in its id << 40 | word
#: Words of a source whose path beginnings meet in one row.
SECTION = 4096


def _units(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = tk.Words(text, tk.SPACE_WORDS)
    return w.hashes(), w.offsets


def _stretches(d: np.ndarray, loc: np.ndarray, src_d: np.ndarray, src_loc: np.ndarray) -> list[np.ndarray]:
    """(d, loc, n, src_d, src_loc) of the maximal stretches that run along one source."""
    order = np.lexsort((loc, d))
    d, loc, src_d, src_loc = d[order], loc[order], src_d[order], src_loc[order]
    step = np.arange(len(d))
    first = np.flatnonzero(tk.run_starts(d, loc - step, src_d, src_loc - step))
    return [d[first], loc[first], np.diff(np.append(first, len(d))), src_d[first], src_loc[first]]


def _runs(candidates: DataFrame, k: int, m: int) -> DataFrame:
    """(run, _id, loc, n, src_id, src_loc, shared): runs; those that a smaller id has too with their source, else shared or not."""

    def table(run, d, loc, n, src_d, src_loc, settled, shared):
        arrays = [pa.array(run), pa.array(d), pa.array(loc), pa.array(n), pa.array(src_d, mask=~settled), pa.array(src_loc, mask=~settled), pa.array(shared)]
        return pa.Table.from_arrays(arrays, ["run", "_id", "loc", "n", "src_id", "src_loc", "shared"])

    def emit(batches):
        held: list[list[np.ndarray]] = []
        n_held = 0

        def flush():
            run, d, loc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((loc, d, run))
            run, d, loc, n = run[order], d[order], loc[order], n[order]
            new = tk.run_starts(run)
            group = np.cumsum(new) - 1
            later = d > d[new][group]
            yield from table(run, d, loc, n, d[new][group], loc[new][group], later, (np.bincount(group, later) > 0)[group]).to_batches(max_chunksize=100_000)

        for b in batches:
            ids, dups, text, lists = (b.column(c) for c in ("_id", "_dup", "_text", "_anchors"))
            for i, j in tk.slices(text):
                w = tk.Words(text.slice(i, j - i), tk.SPACE_WORDS)
                ok, anchor = rp.windows(w.hashes(), w.offsets, k, m)
                at = np.flatnonzero(ok)
                at = at[rp.marked(w.text[at], anchor[at], *tk.lists(lists.slice(i, j - i)))]
                if not len(at):
                    continue
                new = tk.run_starts(anchor[at], w.text[at], at - np.arange(len(at)))
                start, n = at[new], np.diff(np.append(np.flatnonzero(new), len(at)))
                own, dup = ids.slice(i, j - i).to_numpy(), dups.slice(i, j - i).to_numpy()
                no = w.text[start]
                run = tk.mix(w.span_hashes(w.starts[start], w.ends[start + n + k - 2]) ^ n.astype(np.uint64))
                held.append([tk.as_long(run), own[no], (dup[no] << _DUP) + start - w.offsets[no], n])
                n_held += len(start)
                if n_held >= rp.BUFFER_ROWS:
                    yield from flush()
                    held.clear()
                    n_held = 0
        if n_held:
            yield from flush()

    def judge(batches):
        for t in rp.whole_groups(batches, "run"):
            run, d, loc, n, shared = (t.column(c).to_numpy() for c in ("run", "_id", "loc", "n", "shared"))
            settled = np.asarray(t.column("src_id").is_valid())
            new = tk.run_starts(run)
            group = np.cumsum(new) - 1
            later = settled | (d > d[new][group])
            src_d = np.where(settled, t.column("src_id").fill_null(0).to_numpy(), d[new][group])
            src_loc = np.where(settled, t.column("src_loc").fill_null(0).to_numpy(), loc[new][group])
            yield from table(run, d, loc, n, src_d, src_loc, later, (np.bincount(group, later | shared) > 0)[group]).to_batches()

    schema = "run long, _id long, loc long, n long, src_id long, src_loc long, shared boolean"
    rows = candidates.mapInArrow(emit, schema)
    return rows.repartition(rp.route("src_id is not null", "_id", "run")).sortWithinPartitions("run", "_id", "loc").mapInArrow(judge, schema)


_PLACES = "x long, y long, _id long, loc long, n long"


def _places(x, y, d, loc, n):
    return pa.Table.from_arrays([pa.array(v) for v in (x, y, d, loc, n)], ["x", "y", "_id", "loc", "n"])


def _edges(owners: DataFrame, k: int) -> DataFrame:
    """The edges of the owners' runs (x, y, _id, loc, n).

    n > 0: a stretch of n edges that a smaller id has too, from place y of its text x on.  n = 0: an
    edge of several documents at its source, from node x to node y.
    """

    def emit(batches):
        held: list[list[np.ndarray]] = []
        n_held = 0

        def flush():
            x, y, d, loc, shared = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.lexsort((loc, d, y, x))
            x, y, d, loc, shared = x[order], y[order], d[order], loc[order], shared[order]
            new = tk.run_starts(x, y)
            group = np.cumsum(new) - 1
            src_d, src_loc = d[new][group], loc[new][group]
            later = d > src_d
            several = (np.bincount(group, later | shared) > 0)[group]
            sd, sloc, n, sx, sy = _stretches(d[later], loc[later], src_d[later], src_loc[later])
            yield from _places(sx, sy, sd, sloc, n).to_batches(max_chunksize=100_000)
            left = ~later  # 0, or -1 where several documents have the edge
            yield from _places(x[left], y[left], d[left], loc[left], -several[left].astype(np.int64)).to_batches(max_chunksize=100_000)

        for b in batches:
            ids, dups, text, runs = (b.column(c) for c in ("_id", "_dup", "_text", "_runs"))
            for i, j in tk.slices(text):
                h, first = _units(text.slice(i, j - i))
                own, dup = ids.slice(i, j - i).to_numpy(), dups.slice(i, j - i).to_numpy()
                v = runs.slice(i, j - i).flatten()
                loc, n, shared = (v.field(c).to_numpy(zero_copy_only=False) for c in ("loc", "n", "shared"))
                no = np.repeat(np.arange(j - i), np.diff(tk.list_offsets(runs.slice(i, j - i))))
                mine = loc >> _DUP == dup[no]
                loc, n, shared, no = loc[mine], n[mine], shared[mine], no[mine]
                at = np.repeat(first[no] + (loc & ((1 << _DUP) - 1)), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                nodes, no = tk.as_long(tk.grams(h, k - 1)), np.repeat(no, n)
                if len(at):
                    held.append([nodes[at], nodes[at + 1], own[no], (dup[no] << _DUP) + at - first[no], np.repeat(shared, n)])
                n_held += len(at)
                if n_held >= rp.BUFFER_ROWS:
                    yield from flush()
                    held.clear()
                    n_held = 0
        if n_held:
            yield from flush()

    def judge(batches):
        for t in rp.whole_groups(batches, "x"):
            done = t.column("n").to_numpy() > 0
            if done.any():
                yield from t.filter(pa.array(done)).combine_chunks().to_batches()
            x, y, d, loc, n = (t.column(c).to_numpy()[~done] for c in ("x", "y", "_id", "loc", "n"))
            new = tk.run_starts(x, y)
            group = np.cumsum(new) - 1
            src_d, src_loc = d[new][group], loc[new][group]
            later = d > src_d
            edge = new & (np.bincount(group, later | (n < 0)) > 0)[group]
            if later.any():
                sd, sloc, m, sx, sy = _stretches(d[later], loc[later], src_d[later], src_loc[later])
                yield from _places(sx, sy, sd, sloc, m).to_batches()
            if edge.any():
                yield from _places(x[edge], y[edge], d[edge], loc[edge], np.zeros(int(edge.sum()), np.int64)).to_batches()

    rows = owners.mapInArrow(emit, _PLACES)
    # edges are dealt by both their nodes, as a node may have very many, stretches by their own id
    return rows.repartition(F.when(F.col("n") > 0, F.xxhash64("_id")).otherwise(F.xxhash64("x", "y"))).sortWithinPartitions("x", "y", "_id", "loc").mapInArrow(judge, _PLACES)


def _path_starts(edges: DataFrame) -> DataFrame:
    """(src_id, section, starts): first words of the graph's nonbranching paths, by sections of their source."""
    ends = edges.select(F.col("y").alias("node"), F.lit(1).alias("into"), "_id", "loc").union(edges.select("x", F.lit(0), "_id", "loc"))
    of = lambda column, into: F.max(F.when(F.col("into") == into, F.col(column)))  # noqa: E731  of the only one, where a node doesn't branch
    nodes = ends.groupBy("node").agg(F.sum("into").alias("n_in"), F.count(F.lit(1)).alias("n"), of("_id", 1).alias("before"), of("loc", 1).alias("left"), of("_id", 0).alias("_id"), of("loc", 0).alias("loc"))
    links = nodes.where("n_in = 1 and n = 2 and before = _id and left + 1 = loc").select("_id", "loc")
    starts = edges.select("_id", "loc").join(links, ["_id", "loc"], "left_anti")
    return starts.groupBy(F.col("_id").alias("src_id"), F.expr(f"loc div {SECTION}").alias("section")).agg(F.sort_array(F.collect_list("loc")).alias("starts"))


def _merged(stretches: DataFrame) -> DataFrame:
    """Stretches that follow each other in a document and in their source as one."""
    order = Window.partitionBy("_id").orderBy("loc")
    last = F.lag(F.struct("loc", "n", "src_id", "src_loc")).over(order)
    step = (F.col("loc") == last["loc"] + last["n"]) & (F.col("src_id") == last["src_id"]) & (F.col("src_loc") == last["src_loc"] + last["n"])
    numbered = stretches.withColumn("stretch", F.sum(F.when(step, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_id", "stretch").agg(F.min("loc").alias("loc"), F.sum("n").alias("n"), F.min("src_id").alias("src_id"), F.min("src_loc").alias("src_loc")).drop("stretch")


def _along_paths(stretches: DataFrame, starts: DataFrame) -> DataFrame:
    """The stretches in pieces that lie on one path each: cut where a path of their source begins."""
    sections = F.sequence(F.expr(f"src_loc div {SECTION}"), F.expr(f"(src_loc + n - 1) div {SECTION}"))
    parts = stretches.withColumn("section", F.explode(sections)).join(starts, ["src_id", "section"], "left")
    low, high = F.greatest(F.col("src_loc"), F.col("section") * SECTION), F.least(F.col("src_loc") + F.col("n"), (F.col("section") + 1) * SECTION)
    cuts = F.concat(F.array(low), F.coalesce(F.filter("starts", lambda x: (x > low) & (x < high)), F.array().cast("array<long>")), F.array(high))
    pieces = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda x, i: F.struct(x.alias("at"), (F.get(cuts, i + 1) - x).alias("n")))
    one = parts.select("_id", "loc", "src_id", F.col("src_loc").alias("whole"), F.explode(pieces).alias("p"))
    return one.select("_id", (F.col("loc") + F.col("p.at") - F.col("whole")).alias("loc"), "p.n", "src_id", F.col("p.at").alias("src_loc"))


def _digests(texts: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(_id, loc, n, digest): the words of each coordinate, by hashes independent of the edges'."""

    def read(batches):
        for b in batches:
            ids, dups, text, spans = (b.column(c) for c in ("_id", "_dup", "_text", "_spans"))
            for i, j in tk.slices(text):
                w = tk.Words(text.slice(i, j - i), tk.SPACE_WORDS)
                h = w.hashes(1)
                out: list[tuple] = []
                for r in range(i, j):
                    own, dup, base = ids[r].as_py(), dups[r].as_py(), int(w.offsets[r - i])
                    v = spans[r].values
                    for loc, n in zip(v.field("loc").to_pylist(), v.field("n").to_pylist(), strict=True):
                        if loc >> _DUP == dup:
                            a = base + (loc & ((1 << _DUP) - 1))
                            out.append((own, loc, n, hashlib.blake2b(h[a : a + n + k - 1].tobytes(), digest_size=16).digest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_id", "loc", "n", "digest"])

    wanted = paths.select("_id", "loc", "n").union(paths.select("src_id", "src_loc", "n")).distinct()
    wanted = wanted.groupBy("_id").agg(F.collect_list(F.struct("loc", "n")).alias("_spans"))
    return texts.join(wanted, "_id").mapInArrow(read, "_id long, loc long, n long, digest binary")


def repeated_paths(rows: Rows, id_col: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_id, loc, n) of every verified piece: `n` consecutive k-mers from word `loc` of row
    `loc >> 40` of `_id`, all of which also stand in a smaller document."""

    def find(text):
        h, first = _units(text)
        ok, least = rp.windows(h, first, window, anchor)
        return np.repeat(np.arange(len(first) - 1), np.diff(first)), ok, least

    texts = rp.numbered(rows, id_col)
    anchors = written(rp.repeated_anchors(rows, id_col, find), "anchors")
    runs = written(_runs(texts.join(anchors, "_id").select("_id", "_text", "_row", "_dup", "_anchors"), window, anchor), "runs")
    discard(anchors)
    owners = runs.where("src_id is null").groupBy("_id").agg(F.collect_list(F.struct("loc", "n", "shared")).alias("_runs"))
    graph = written(_edges(texts.join(owners, "_id").select("_id", "_text", "_row", "_dup", "_runs"), window), "graph")
    starts = written(_path_starts(graph.where("n = 0").select("_id", "loc", "x", "y")), "path-starts")
    stretches = runs.where("src_id is not null").select("_id", "loc", "n", "src_id", "src_loc").union(graph.where("n > 0").select("_id", "loc", "n", F.col("x").alias("src_id"), F.col("y").alias("src_loc")))
    pieces = written(_along_paths(_merged(stretches), starts), "pieces")
    discard(runs, graph, starts)
    digests = _digests(texts, pieces, window)
    here = digests.select("_id", "loc", "n", F.col("digest").alias("here"))
    there = digests.select(F.col("_id").alias("src_id"), F.col("loc").alias("src_loc"), "n", F.col("digest").alias("there"))
    verified = pieces.join(here, ["_id", "loc", "n"]).join(there, ["src_id", "src_loc", "n"]).where("here = there").select("_id", "loc", "n")
    out = written(verified, "verified")
    discard(pieces)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All columns of `docs`, and n_words, n_removed, kept_text (kept words, joined by one space).

    A word goes if a window of `window` words covers it that also starts in a document with a
    smaller id; words are runs of `[^\\x20\\x09-\\x0D]`, compared as they are.  Windows are judged
    on the input.  A null text has no words and gives an empty kept_text.  Ids are integers; other
    types are refused.  Rows without an id are kept whole and are nobody's source.  Rows of the
    same id are one document: they don't remove from each other, and each keeps its own row.  An
    input column with a result's name, in any case, is replaced.
    """
    added = "n_words long, n_removed long, kept_text string"
    rows = Rows(docs, text_col, ("n_words", "n_removed", "kept_text"))

    def cut(batches):
        for b in batches:
            text = b.column("_text")
            for i, j in tk.slices(text):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), *_cut(part, window)], ["_row", "_text", "n_words", "n_removed", "kept_text"])

    parts = rp.with_spans(rows, id_col, repeated_paths(rows, id_col, window, anchor))
    schema = schema_of(parts[0].select("_row", "_text"), added)
    out = parts[0].mapInArrow(cut, schema).union(parts[1].mapInArrow(cut, schema))
    return rows.result(out, "n_words", "n_removed", "kept_text")


def _cut(part: pa.RecordBatch, k: int) -> list[pa.Array]:
    w = tk.Words(part.column("_text"), tk.SPACE_WORDS)
    gone = np.zeros(len(w), bool)
    dups, spans = part.column("_dup").to_numpy(), part.column("_spans")
    for r in range(part.num_rows):
        if spans[r].is_valid and len(v := spans[r].values):
            loc, n = v.field("loc").to_numpy(), v.field("n").to_numpy()
            own = loc >> _DUP == dups[r]
            a, z = int(w.offsets[r]), int(w.offsets[r + 1])
            gone[a:z] = tk.covered(loc[own] & ((1 << _DUP) - 1), n[own] + k - 1, z - a)
    n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.offsets[:-1]) * (w.counts > 0) if part.num_rows else np.zeros(0, np.int64)
    data = w.bytes.tobytes()
    texts = []
    for r in range(part.num_rows):
        a, z = int(w.offsets[r]), int(w.offsets[r + 1])
        kept = np.flatnonzero(~gone[a:z]) + a
        texts.append(b" ".join([data[s:e] for s, e in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)]).decode())
    return [pa.array(w.counts.astype(np.int64)), pa.array(n_removed), pa.array(texts, pa.string())]
