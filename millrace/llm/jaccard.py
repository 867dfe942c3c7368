"""Near-duplicate join on word 5-gram sets with Bayesian pruning of candidates.

1. Each document becomes a set of shingle hashes, a digest of that set and a MinHash signature.
   Documents with equal sets are one node from here on.
2. Nodes that share a band of the signature are candidates.  Inside a bucket, signature bytes are
   compared a batch at a time; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below the tolerance.  A bucket emits a spanning forest
   of its surviving pairs, so its output is linear in its size.
3. The components of these forests hold every surviving pair.  Inside each component the sets are
   compared exactly; links are counted where they are found, and never listed.

Buckets and components beyond a block's size, in members or in shingles, are cut into blocks, and
every pair of blocks is a group of its own: no task holds more than two blocks, and no pair is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _repeats as rp
from millrace.llm import _tokens as tk
from millrace.llm._graph import components
from millrace.llm._shared import Rows, discard, written

#: Words of a shingle, and the least similarity of a link, as a ratio.
SHINGLE, THRESHOLD = 5, (4, 5)
#: Bands and rows of a signature: a pair at similarity 0.8 shares no band with probability 7e-10.
BANDS, ROWS = 40, 4
#: Signature bytes compared before each look at the posterior, and the posterior's least value.
BATCH, TOLERANCE = 32, 1e-6
#: Most nodes of a block of a bucket and of a component, and most shingles of the latter (2 MB of hashes).
BUCKET_BLOCK, COMPONENT_BLOCK, BLOCK_SHINGLES = 4096, 1024, 1 << 18

_N = BANDS * ROWS


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, their offsets by text)."""
    w = tk.Words(text, tk.SPACE_WORDS)
    h = w.hashes()
    whole = w.full(SHINGLE)
    g, no = tk.grams(h, SHINGLE)[whole], w.text[whole]
    for t in np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE)):
        one = tk.grams(h[w.offsets[t] : w.offsets[t + 1]], int(w.counts[t]))[:1]
        g, no = np.append(g, one), np.append(no, t)
    order = np.lexsort((g, no))
    g, no = g[order], no[order]
    new = tk.run_starts(no, g)
    g, no = g[new], no[new]
    return g, np.searchsorted(no, np.arange(len(text) + 1))


def least_matches(prior_cells: int = 2000) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): Bayes' rule under a uniform prior of the similarity.

    Two signature bytes agree with probability s + (1 - s) / 256.
    """
    s = (np.arange(prior_cells) + 0.5) / prior_cells
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, _N + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log(1 - p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, s >= THRESHOLD[0] / THRESHOLD[1]].sum(axis=1) / weight.sum(axis=1)
        out.append((n, int(np.argmax(posterior >= TOLERANCE))))
    return out


def _signed(rows: Rows, id_col: str) -> DataFrame:
    """(_id, _digest, node, size, keys, sig) for each row with an id."""

    def sign(batches):
        factors = tk.mix(np.arange(1, 2 * _N + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                part = b.slice(i, j - i)
                g, first = shingles(part.column("_text"))
                n, some = j - i, np.diff(first) > 0
                least = np.zeros((_N, n), np.uint64)
                if len(g):
                    at = first[:-1][some]
                    for k in range(_N):
                        least[k, some] = np.minimum.reduceat(g * factors[2 * k] + factors[2 * k + 1], at)
                keys = np.zeros((n, BANDS), np.uint64)
                for band in range(BANDS):
                    x = np.full(n, band + 1, np.uint64)
                    for r in range(ROWS):
                        x = tk.mix_step(x, least[band * ROWS + r])
                    keys[:, band] = tk.mix(x)
                sig = np.ascontiguousarray((least >> np.uint64(24)).astype(np.uint8).T).tobytes()
                nodes = [int.from_bytes(hashlib.blake2b(g[first[r] : first[r + 1]].tobytes(), digest_size=8).digest(), "little", signed=True) for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_digest"), pa.array(nodes, pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(tk.as_long(keys.ravel()))), pa.array([sig[r * _N : (r + 1) * _N] for r in range(n)], pa.binary())],
                    ["_id", "_digest", "node", "size", "keys", "sig"],
                )

    texts = rows.frame.where(rows.id(id_col).isNotNull()).select(rows.id(id_col).alias("_id"), digest(rows.text).alias("_digest"), rows.text)
    return texts.mapInArrow(sign, "_id long, _digest string, node long, size long, keys array<long>, sig binary")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def in_blocks(rows: DataFrame, key: str, member: str, block: int, weight: Column | None = None, most: int = 1) -> DataFrame:
    """Rows with `_group`, repeated for each pair of blocks of a key whose members or their weight exceed a block."""
    needed = F.ceil(F.count(F.lit(1)) / block)
    sizes = rows.groupBy(key).agg((needed if weight is None else F.greatest(needed, F.ceil(F.sum(weight) / most))).alias("_size")).where("_size > 1")
    parts = F.col("_size")
    own = F.pmod(F.xxhash64(member), parts)
    others = F.sequence(F.lit(0).cast("long"), parts - 1)
    pairs = F.when(F.col("_size").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(F.transform(others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))))
    out = rows.join(sizes, key, "left").withColumn("_pair", F.explode(pairs))
    return out.withColumn("_group", F.xxhash64(key, "_pair.i", "_pair.j")).withColumn("_part", F.when(F.col("_size").isNull(), F.lit(0)).otherwise(own)).drop("_size")


def forest(n: int, linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n members; linked(u, others) is a mask of u's partners among others."""
    out, rest, queue = [], np.arange(n), []
    while len(rest):
        if queue:
            u = queue.pop()
        else:
            u, rest = int(rest[0]), rest[1:]
        if len(rest):
            hit = linked(u, rest)
            found = rest[hit].tolist()
            out += [(u, v) for v in found]
            queue += found
            rest = rest[~hit]
    return out


def _survivors(nodes: DataFrame) -> DataFrame:
    """(a, b): spanning forests of the buckets' pairs that Bayesian pruning leaves."""
    looks = least_matches()

    def prune(batches):
        for t in rp.whole_groups(batches, "_group"):
            group, node = t.column("_group").to_numpy(), t.column("node").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, _N)
            at = np.append(np.flatnonzero(tk.run_starts(group)), len(group))
            a, b = [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if y - x < 2:
                    continue
                own = sig[x:y]

                def linked(u, others, own=own):
                    alive, same = np.arange(len(others)), np.zeros(len(others), np.int64)
                    for n, least in looks:
                        same[alive] += (own[others[alive], n - BATCH : n] == own[u, n - BATCH : n]).sum(axis=1)
                        alive = alive[same[alive] >= least]
                        if not len(alive):
                            break
                    out = np.zeros(len(others), bool)
                    out[alive] = True
                    return out

                for u, v in forest(y - x, linked):
                    a.append(node[x + u])
                    b.append(node[x + v])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    company = written(keys.join(shared, "key"), "buckets")
    rows = in_blocks(company, "key", "node", BUCKET_BLOCK).select("_group", "node").join(nodes.select("node", "sig"), "node")
    return rows.repartition("_group").sortWithinPartitions("_group", "node").mapInArrow(prune, "a long, b long").distinct()


def _verified(rows: Rows, nodes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(node, root, n_links) from exact comparison inside each component (or pair of its blocks)."""

    def sets(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                part = b.slice(i, j - i)
                g, first = shingles(part.column("_text"))
                raw = [g[first[r] : first[r + 1]].tobytes() for r in range(j - i)]
                node = part.column("node").to_numpy()
                # an id may repeat with another text: that row is not the node's
                own = [r for r in range(j - i) if int.from_bytes(hashlib.blake2b(raw[r], digest_size=8).digest(), "little", signed=True) == node[r]]
                yield pa.RecordBatch.from_arrays([pa.array(node[own], pa.int64()), part.column("comp").take(pa.array(own, pa.int64())), pa.array([raw[r] for r in own], pa.binary())], ["node", "comp", "set"])

    def compare(batches):
        for t in rp.whole_groups(batches, "_group"):
            group, node, part, i, j = (t.column(c).to_numpy() for c in ("_group", "node", "_part", "_i", "_j"))
            raw = t.column("set").to_pylist()
            at = np.append(np.flatnonzero(tk.run_starts(group)), len(group))
            out: list[tuple[int, int, int]] = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                keep = np.flatnonzero(tk.run_starts(node[x:y])) + x  # sorted by node: repeated rows stand together
                links = _links([np.frombuffer(raw[k], np.uint64) for k in keep])
                tree = forest(len(keep), lambda u, others, links=links: links[u, others])
                root = list(range(len(keep)))
                for u, v in tree:  # parents come first
                    root[v] = root[u]
                counted = links if i[x] == j[x] else links & (part[keep][:, None] != part[keep][None, :])
                out += [(int(node[k]), int(node[keep[root[n]]]), int(c)) for n, (k, c) in enumerate(zip(keep, counted.sum(axis=1), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "root", "n_links"])

    texts = rows.frame.where(rows.id(id_col).isNotNull()).select(rows.id(id_col).alias("_id"), rows.text)
    wanted = nodes.join(roots, "node").select(F.col("first_id").alias("_id"), "node", F.col("root").alias("comp"), "size")
    found = texts.join(wanted.drop("size"), "_id").select("_text", "node", "comp").mapInArrow(sets, "node long, comp long, set binary")
    # blocks are planned on the keys alone; the sets join the plan afterwards
    plan = in_blocks(wanted.select("node", "comp", "size"), "comp", "node", COMPONENT_BLOCK, F.col("size"), BLOCK_SHINGLES).select("node", "_group", "_part", F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"))
    placed = found.select("node", "set").join(plan, "node")
    return placed.repartition("_group").sortWithinPartitions("_group", "node").mapInArrow(compare, "node long, root long, n_links long")


def _links(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, which = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    distinct, column, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    column, which = rank[column[often]], which[often]
    order = np.argsort(column, kind="stable")
    column, which = column[order], which[order]
    common = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        x = np.zeros((n, 4096), np.float32)
        x[which[lo:hi], column[lo:hi] - c] = 1
        common += x @ x.T
    p, q = THRESHOLD
    shared = np.rint(common).astype(np.int64)
    out = (shared > 0) & ((p + q) * shared >= p * (sizes[:, None] + sizes[None, :]))
    np.fill_diagonal(out, False)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, class_id, copy_id, n_links), one row for each row of `docs`.

    copy_id is the smallest id with the same shingle set; class_id the smallest id that links of
    similarity 0.8 or more lead to; n_links the number of other shingle sets within 0.8 of the
    row's own, the same for all copies.  A text of fewer than five words has one shingle, all of
    it.  Texts without words (or null) and rows without id stand alone: their class is their own
    id and they have no links.  Rows may repeat; an id may repeat with other texts, whose rows are
    told apart by text_digest, the MD5 of the text.  Ids are integers; other types are refused.
    """
    rows = Rows(docs, text_col)
    signed = written(_signed(rows, id_col), "signed")
    some = signed.where("size > 0")
    nodes = written(some.groupBy("node").agg(F.min("_id").alias("first_id"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "nodes")
    candidates = written(_survivors(nodes), "candidates")
    roots = written(components(candidates), "components")
    checked = written(_verified(rows, nodes, roots, id_col), "checked")
    discard(candidates, roots)
    links = checked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    final = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(links, "node")
    named = nodes.select("node", "first_id").join(final, "node", "left").select("node", F.col("first_id").alias("copy_id"), F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    table = written(named.join(least, "root").select("node", "class_id", "copy_id", "n_links"), "classes")
    discard(checked, nodes)
    placed = signed.select("_id", "_digest", F.when(F.col("size") > 0, F.col("node")).alias("node")).join(table, "node", "left")
    nobody = F.lit(None).cast("long")
    without = rows.frame.where(rows.id(id_col).isNull()).select(nobody, digest(rows.text), nobody, nobody, F.lit(0).cast("long"))
    out = placed.select("_id", "_digest", F.coalesce("class_id", "_id"), F.coalesce("copy_id", "_id"), F.coalesce("n_links", F.lit(0)).cast("long")).union(without)
    return out.toDF(id_col, "text_digest", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class: that of the smallest id.  Rows without id all stay."""
    rows = Rows(docs, text_col)
    classes = near_duplicates(docs, id_col, text_col).toDF("_id", "_digest", "class_id", "copy_id", "n_links").where("_id = class_id").select("_id", "_digest").distinct()
    known = rows.frame.where(rows.id(id_col).isNotNull()).withColumns({"_id": rows.id(id_col), "_digest": digest(rows.text)})
    kept = known.join(classes, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select(*rows.frame.columns)
    return kept.union(rows.frame.where(rows.id(id_col).isNull())).toDF(*rows.names)
