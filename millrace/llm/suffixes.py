"""Suffix arrays by induced sorting, and exact deduplication of byte strings with them.

Repeated regions are found by anchors (see `_repeats`).  A region is cut into *runs*: consecutive
windows with one anchor, at most MOST_RUN of them.  Equal runs, by 128-bit digests, are one string
that belongs to their first document.  Different runs that share an anchor may still share windows:
they meet in shards, to which each gives the stretches that by their windows' hashes another
document may have too (equal stretches, byte by byte, are again one string).  Each shard's suffix
array is built by induced sorting, its permuted common prefixes are computed, and neighbours with a
common prefix of a window or more form classes, whose smallest document keeps the window.

A shard holds whole anchors up to about SHARD_BYTES of such stretches.  The windows of an anchor
whose runs have more bytes than that are dealt one by one, by their hash, after map tasks have
settled those they hold twice; their shards' suffix arrays compare each document's window with the
first equal one, so many bytes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _repeats as rp
from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, discard, schema_of, written

#: Bytes of a window, and of the grams among which its anchor is chosen.
WINDOW, ANCHOR = 50, 16
#: Most windows of a run, and most bytes of an anchor's runs, and of windows, that one suffix array sorts.
MOST_RUN, SHARD_BYTES = 4096, 1 << 20
#: Text bytes, or one text, whose windows a task hashes at once.
PIECE_BYTES = 1 << 19
_DUP = 40


# --- suffix arrays ---------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next one); the last symbol is a unique smallest."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n)
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(s[:-1] < s[1:], True)
    return smaller[ahead]


def _placed(s: np.ndarray, order: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The leftmost S-type suffixes at the ends of their symbols' ranges, in the given order."""
    sa = np.full(len(s), -1, np.int64)
    c = s[order]
    by = np.argsort(c, kind="stable")
    c = c[by]
    last = np.searchsorted(c, c, "right")
    sa[tails[c] - (last - np.arange(len(c)))] = order[by]
    return sa


def _induce(s: np.ndarray, is_s: np.ndarray, order: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Suffix order induced from the order of the leftmost S-type suffixes, one suffix at a time.

    `larger` and `smaller` hold, for each suffix, the symbol before it if that one's suffix is of
    the pass's type, else -1; their last entry serves the places of `sa` that are still -1.  The
    loops read places that they fill as they go.
    """
    sa = _placed(s, order, tails).tolist()
    larger = [-1, *np.where(is_s, -1, s).tolist()]
    larger[-1] = -1
    head = heads.tolist()
    for k in sa:
        if (c := larger[k]) >= 0:
            h = head[c]
            sa[h] = k - 1
            head[c] = h + 1
    smaller = [-1, *np.where(is_s, s, -1).tolist()]
    smaller[-1] = -1
    tail = tails.tolist()
    for k in reversed(sa):
        if (c := smaller[k]) >= 0:
            t = tail[c] - 1
            sa[t] = k - 1
            tail[c] = t
    return np.array(sa, np.int64)


def _induce_ranges(s: np.ndarray, is_s: np.ndarray, order: np.ndarray, heads: np.ndarray, tails: np.ndarray, marks: int) -> np.ndarray:
    """The same, a symbol's range at a time: for few symbols after the first `marks`, each of which occurs once.

    Suffixes that a range induces into itself form its next round, so a range takes as many rounds
    as its symbol's longest repetition.
    """
    sa = _placed(s, order, tails)
    head, tail = heads.copy(), tails.copy()

    def push(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append suffixes to their symbols' ranges, keeping their order."""
        c = s[found]
        by = np.argsort(c, kind="stable")
        found, c = found[by], c[by]
        nth = np.arange(len(c)) - np.searchsorted(c, c, "left")
        sa[at[c] + step * nth - (step < 0)] = found
        at += step * np.bincount(c, minlength=len(at))

    def before(entries: np.ndarray, small: bool) -> np.ndarray:
        found = entries[entries > 0] - 1
        return found[is_s[found] == small]

    push(before(sa[:marks], False), head, 1)  # a mark is smaller than all other symbols: nothing is induced among marks
    for c in range(marks, len(heads)):
        at = int(heads[c])
        while at < head[c]:
            upto = int(head[c])
            push(before(sa[at:upto], False), head, 1)
            at = upto
        rest = sa[at : tails[c]]
        push(before(rest[rest >= 0], False), head, 1)
    for c in range(len(heads) - 1, marks - 1, -1):
        at = int(tails[c])
        while at > tail[c]:
            upto = int(tail[c])
            push(before(sa[upto:at][::-1], True), tail, -1)
            at = upto
        push(before(sa[heads[c] : head[c]][::-1], True), tail, -1)
    fixed = np.flatnonzero(s < marks)
    sa[s[fixed]] = fixed
    return sa


def suffix_array(s: np.ndarray, marks: int = 0) -> np.ndarray:
    """Start of the suffixes in order; `s` holds integers from 0 and ends with its only 0.

    With `marks`, the symbols below it occur once each, and each is followed by a greater symbol.
    """
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].astype(np.int64)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    counts = np.bincount(s)
    tails = np.cumsum(counts)
    heads = tails - counts
    induce = _induce_ranges if marks else _induce
    extra = (marks,) if marks else ()
    sa = induce(s, is_s, lms, heads, tails, *extra)
    # name the leftmost S-type substrings in their induced order
    which = np.full(n, -1, np.int64)
    which[lms] = np.arange(len(lms))
    ordered = sa[which[sa] >= 0]
    ends = np.append(lms[1:], n - 1)
    length = (ends - lms + 1)[which[ordered]]
    same = np.append(False, length[1:] == length[:-1]) if len(ordered) else np.zeros(0, bool)
    active, k = np.flatnonzero(same), 0
    while len(active):
        active = active[k < length[active]]
        equal = s[ordered[active] + k] == s[ordered[active - 1] + k]
        same[active[~equal]] = False
        active, k = active[equal], k + 1
    names = np.cumsum(~same) - 1
    if len(names) and names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[which[ordered]] = names
        order = lms[suffix_array(reduced)]
    else:
        order = ordered
    return induce(s, is_s, order, heads, tails, *extra)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix (by start) with the one before it in the suffix array.

    A value is the one before it, less one, unless the two symbols before the pair differ; only
    those irreducible values are counted out, all of them one symbol at a time.
    """
    n = len(s)
    phi = np.full(n, n - 1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    start = np.ones(n, bool)
    start[1:] = s[:-1] != np.where(phi[1:] > 0, s[phi[1:] - 1], -1)
    start[np.minimum(np.flatnonzero(phi == n - 1) + 1, n - 1)] = True
    at = np.flatnonzero(start)
    value = np.zeros(len(at), np.int64)
    active, k = np.arange(len(at)), 0
    while len(active):
        a, b = at[active] + k, phi[at[active]] + k
        inside = (a < n) & (b < n)
        equal = np.zeros(len(active), bool)
        equal[inside] = s[a[inside]] == s[b[inside]]
        equal &= at[active] != phi[at[active]]
        active = active[equal]
        value[active] += 1
        k += 1
    last = np.cumsum(start) - 1
    return np.maximum(value[last] - (i - at[last]), 0)


def first_owners(texts: list[bytes], owner: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, smallest owner) of the windows that an owner smaller than the text's has too."""
    long = np.flatnonzero([len(t) >= window for t in texts])
    if not len(long):
        return long, long, long
    texts, owner = [texts[k] for k in long], owner[long]
    sizes = np.array([len(t) for t in texts])
    n_texts = len(texts)
    ends = np.cumsum(sizes + 1) - 1
    s = np.empty(int(ends[-1]) + 1, np.int64)
    body = np.ones(len(s), bool)
    body[ends] = False
    s[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + n_texts
    s[ends] = np.append(np.arange(1, n_texts), 0)  # each text ends with a mark of its own, the last with 0
    used = np.zeros(n_texts + 256, np.int64)  # symbols close up, so that no range is empty
    used[s] = 1
    s = (np.cumsum(used) - 1)[s]
    text = np.repeat(np.arange(n_texts), sizes + 1)
    sa = suffix_array(s, n_texts)
    lcp = permuted_lcp(s, sa)[sa]
    group = np.cumsum(lcp < window) - 1
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    at, group = sa[some], group[some]
    if not len(at):
        return at, at, at
    mine = owner[text[at]]
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, mine)
    later = mine > least[group]
    at = at[later]
    return long[text[at]], at - (ends - sizes)[text[at]], least[group][later]


# --- deduplication ---------------------------------------------------------------------------


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = tk.text_buffer(text)
    return raw, off


def _windowless(text: pa.Array) -> tk.Words:
    """The bytes and offsets of some texts, to hash spans of."""
    w = tk.Words.__new__(tk.Words)
    w.bytes, w.text_offsets = tk.text_buffer(text)
    w._sums = {}
    return w


class _Windows:
    """Byte windows of some texts: anchors, whole windows and span hashes."""

    def __init__(self, text: pa.Array, window: int, anchor: int):
        self.w, self.window = _windowless(text), window
        self.first = self.w.text_offsets
        n, g = len(self.w.bytes), self.w.byte_grams(anchor)
        self.anchor = tk.sliding_min(np.append(g, np.full(n - len(g), np.iinfo(np.uint64).max, np.uint64)), window - anchor + 1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of windows, text) of the longest runs of windows with one anchor."""
        n = len(self.anchor)
        new = np.ones(n + 1, bool)
        new[1:n] = self.anchor[1:] != self.anchor[:-1]
        new[self.first] = True
        new[np.maximum(self.first[:-1], self.first[1:] - self.window + 1)] = True  # no whole window from here on
        start = np.flatnonzero(new)
        size = np.diff(start)
        start = start[:-1]
        no = np.searchsorted(self.first, start, "right") - 1
        whole = start + self.window <= self.first[no + 1]
        return start[whole], size[whole], no[whole]


def _anchors(rows: Rows, id_col: str, window: int, anchor: int) -> DataFrame:
    def find(text):
        x = _Windows(text, window, anchor)
        start, _, no = x.runs()
        return no, np.ones(len(no), bool), x.anchor[start]

    return rp.repeated_anchors(rows, id_col, find, PIECE_BYTES)


def _runs(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, run, _id, loc, n, settled): runs of the repeated regions; settled: a smaller id has the same run.

    Equal runs are those of which run and a second, independent hash agree.
    """

    def emit(batches):
        held: list[list[np.ndarray]] = []
        n_held = 0

        def flush():
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()
            for k, x in enumerate(columns):
                columns[k] = np.concatenate(x)
                x.clear()
            order = tk.ordered(*columns[:4])
            for k, x in enumerate(columns):
                columns[k] = x[order]
            run, run2, d, loc, n, a = columns
            new = tk.run_starts(run, run2)
            settled = d > d[new][np.cumsum(new) - 1]
            arrays = [pa.array(x) for x in (a, run, run2, d, loc, n, settled)]
            yield from pa.Table.from_arrays(arrays, ["anchor", "run", "run2", "_id", "loc", "n", "settled"]).to_batches(max_chunksize=100_000)

        for b in batches:
            ids, dups, text, lists = (b.column(c) for c in ("_id", "_dup", "_text", "_anchors"))
            for i, j in tk.slices(text, PIECE_BYTES):
                x = _Windows(text.slice(i, j - i), window, anchor)
                start, n, no = x.runs()
                found = rp.marked(no, x.anchor[start], *tk.lists(lists.slice(i, j - i)))
                start, n, no = start[found], n[found], no[found]
                if not len(start):
                    continue
                parts = -(-n // MOST_RUN)  # a long run, as of a periodic text, is cut from its start on
                skip = MOST_RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                start, n, no = np.repeat(start, parts) + skip, np.minimum(np.repeat(n, parts) - skip, MOST_RUN), np.repeat(no, parts)
                own, dup = ids.slice(i, j - i).to_numpy(), dups.slice(i, j - i).to_numpy()
                run, run2 = (tk.mix(x.w.span_hashes(start, start + n + window - 1, f) ^ n.astype(np.uint64)) for f in (0, 1))
                held.append([tk.as_long(run), tk.as_long(run2), own[no], (dup[no] << _DUP) + start - x.first[no], n, tk.as_long(x.anchor[start])])
                n_held += len(start)
                if n_held >= rp.BUFFER_ROWS:
                    yield from flush()
                    n_held = 0
        if n_held:
            yield from flush()

    def judge(batches):
        for t in rp.whole_groups(batches, "run"):
            run, run2 = t.column("run").to_numpy(), t.column("run2").to_numpy()
            if np.any((run[1:] == run[:-1]) & (run2[1:] != run2[:-1])):
                order = np.lexsort((run2, run))
                t, run, run2 = t.take(pa.array(order)), run[order], run2[order]
            d, new = t.column("_id").to_numpy(), tk.run_starts(run, run2)
            least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
            settled = t.column("settled").to_numpy() | (d > least)
            t = t.set_column(t.schema.get_field_index("settled"), "settled", pa.array(settled)).drop_columns(["run2"])
            yield from t.combine_chunks().to_batches()

    rows = candidates.mapInArrow(emit, "anchor long, run long, run2 long, _id long, loc long, n long, settled boolean")
    routed = rows.repartition(rp.route("settled", "_id", "run")).sortWithinPartitions("run")  # one key: a radix sort
    return routed.mapInArrow(judge, "anchor long, run long, _id long, loc long, n long, settled boolean")


def _open_runs(runs: DataFrame, window: int) -> DataFrame:
    """Unsettled runs whose anchor has another run, with `crowd`: bytes of the anchor's runs."""
    free = runs.where("not settled").select("anchor", "run", "_id", "loc", "n")
    kinds = free.groupBy("anchor").agg(F.min("run").alias("lo"), F.max("run").alias("hi"), F.sum(F.col("n") + window - 1).alias("crowd")).where("lo <> hi")
    return free.join(kinds.select("anchor", "crowd"), "anchor").select("anchor", "_id", "loc", "n", "crowd")


_CONTENTS = "anchor long, _id long, loc long, crowd long, content binary"


def _contents(texts: DataFrame, runs: DataFrame, window: int, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema: str = _CONTENTS) -> DataFrame:
    """(anchor, _id, loc, crowd, content): the bytes of each run; or what `then` makes of these batches, of that schema.

    `then` runs in the same Python worker: a second step on workers would keep as many again in an executor.
    """

    def read(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text"), PIECE_BYTES):
                raw, off = tk.text_buffer(b.column("_text").slice(i, j - i))
                data = raw.tobytes()
                out: list[list] = [[], [], [], [], []]
                for r in range(i, j):
                    v = b.column("_runs")[r].values
                    own, dup, base = b.column("_id")[r].as_py(), b.column("_dup")[r].as_py(), int(off[r - i])
                    for a, loc, n, crowd in zip(*(v.field(c).to_pylist() for c in ("anchor", "loc", "n", "crowd")), strict=True):
                        if loc >> _DUP == dup:
                            at = base + (loc & ((1 << _DUP) - 1))
                            for x, y in zip(out, (a, own, loc, crowd, data[at : at + n + window - 1]), strict=True):
                                x.append(y)
                for k in range(0, len(out[0]), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 20_000], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "_id", "loc", "crowd", "content"])

    wanted = runs.groupBy("_id").agg(F.collect_list(F.struct("anchor", "loc", "n", "crowd")).alias("_runs"))
    return texts.join(wanted, "_id").select("_id", "_text", "_row", "_dup", "_runs").mapInArrow(lambda batches: then(read(batches)), schema)


def _spans(d: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
    """Removed windows as rows (_id, loc, n) of consecutive places."""
    order = np.lexsort((loc, d))
    d, loc = d[order], loc[order]
    keep = tk.run_starts(d, loc)
    d, loc = d[keep], loc[keep]
    new = tk.run_starts(d, loc - np.arange(len(loc)))
    n = np.diff(np.append(np.flatnonzero(new), len(d)))
    return pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(loc[new]), pa.array(n)], ["_id", "loc", "n"])


def _places(w: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start among all bytes) of each whole window."""
    count = np.maximum(np.diff(w.text_offsets) - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return text, w.text_offsets[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)


def _shared(texts: pa.Array, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, number of windows) of stretches of windows that by their hash another id has too."""
    w = _windowless(texts)
    text, at = _places(w, window)
    if not len(at):
        return at, at, at
    h = w.byte_grams(window)[at]
    order = np.argsort(h)
    new = tk.run_starts(h[order])
    d, first = ids[text[order]], np.flatnonzero(new)
    several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
    some = np.sort(order[several[np.cumsum(new) - 1]])
    text, at = text[some], at[some]
    new = np.flatnonzero(tk.run_starts(text, at - np.arange(len(at))))
    return text[new], (at - w.text_offsets[text])[new], np.diff(np.append(new, len(at)))


def _by_shard(contents: DataFrame, window: int, anchor: int) -> DataFrame:
    """(_id, loc, n) of windows that a smaller id has in another run, by suffix arrays of shards.

    What goes into a shard are the stretches of its texts that may be in another id's too; equal
    ones are one string, which belongs to the smallest id.
    """

    def spans(strings: dict[bytes, int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        d, loc, n, string = (np.concatenate(x) for x in zip(*held, strict=True))
        owner = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owner, string, d)
        copy = d > owner[string]
        yield pa.RecordBatch.from_arrays([pa.array(x[copy]) for x in (d, loc, n)], ["_id", "loc", "n"])
        text, place, _ = first_owners(list(strings), owner, window)
        place = place[np.argsort(text, kind="stable")]
        upto = np.cumsum(np.bincount(text, minlength=len(strings)))
        d, loc, string = d[~copy], loc[~copy], string[~copy]
        count = np.diff(upto, prepend=0)[string]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - upto[string], count)
        if len(nth):
            yield _spans(np.repeat(d, count), np.repeat(loc, count) + place[nth])

    def sort(batches):
        strings, held, size, n_held = {}, [], 0, 0
        for t in rp.whole_groups(batches, "anchor"):
            d, loc, content = t.column("_id").to_numpy(), t.column("loc").to_numpy(), t.column("content").combine_chunks()
            text, start, n = _shared(content, d, window)
            if not len(text):
                continue
            raw, first = tk.text_buffer(content)
            data, at, before = raw.tobytes(), first[text] + start, len(strings)
            string = np.array([strings.setdefault(data[i:j], len(strings)) for i, j in zip(at.tolist(), (at + n + window - 1).tolist(), strict=True)], np.int64)
            held.append((d[text], loc[text] + start, n, string))
            which, nth = np.unique(string, return_index=True)
            size += int((n[nth] + window - 1)[which >= before].sum())
            n_held += len(text)
            if size >= SHARD_BYTES or n_held >= rp.BUFFER_ROWS:
                yield from spans(strings, held)
                strings, held, size, n_held = {}, [], 0, 0
        if held:
            yield from spans(strings, held)

    rows = contents.select("anchor", "_id", "loc", "content")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "_id long, loc long, n long")


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """The rows again, those at a time that have at most so many bytes in a column, or one row."""
    held, size = [], 0
    for b in batches:
        _, offsets = tk.text_buffer(b.column(column))
        for i, j in tk.slices(b.column(column), most):
            n = int(offsets[j] - offsets[i])
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(b.slice(i, j - i))
            size += n
    if held:
        yield pa.Table.from_batches(held)


def _by_window(texts: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The same of runs whose anchor has more bytes than a shard takes: each window is dealt by its own hash."""

    names = ["hash", "hash2", "_id", "loc", "n", "settled", "content"]

    def emit(batches):
        for b in _pieces(batches, "content"):
            w = _windowless(b.column("content"))
            no, at = _places(w, window)
            d, loc = b.column("_id").to_numpy()[no], b.column("loc").to_numpy()[no] + at - w.text_offsets[no]
            h = tk.as_long(w.span_hashes(at, at + window))
            h2 = tk.as_long(w.span_hashes(at, at + window, 1))
            order = np.lexsort((loc, d, h2, h))
            at, h, h2, d, loc = at[order], h[order], h2[order], d[order], loc[order]
            new = tk.run_starts(h, h2)
            settled = d > d[new][np.cumsum(new) - 1]
            data = w.bytes
            spans = _spans(d[settled], loc[settled])  # settled windows travel as stretches, without their bytes
            k = spans.num_rows
            nothing = pa.array(np.zeros(k, np.int64))
            yield pa.RecordBatch.from_arrays([nothing, nothing, *spans.columns, pa.array(np.ones(k, bool)), pa.nulls(k, pa.binary())], names)
            at, h, h2, d, loc = (v[~settled] for v in (at, h, h2, d, loc))
            for i in range(0, len(at), 20_000):
                part = slice(i, i + 20_000)
                cut = np.lib.stride_tricks.sliding_window_view(data, window)[at[part]]
                content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(window), len(cut), [None, pa.py_buffer(np.ascontiguousarray(cut))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(v[part]) for v in (h, h2, d, loc)], pa.array(np.ones(len(cut), np.int64)), pa.array(np.zeros(len(cut), bool)), content], names)

    def sort(batches):
        for t in rp.whole_groups(batches, "hash"):
            settled = t.column("settled").to_numpy()
            if settled.any():
                yield from t.filter(pa.array(settled)).select(["_id", "loc", "n"]).combine_chunks().to_batches()
            t = t.filter(pa.array(~settled))
            if not t.num_rows:
                continue
            h, h2, d, loc = (t.column(c).to_numpy() for c in ("hash", "hash2", "_id", "loc"))
            # what the hashes call equal, a suffix array compares: each document's window with the first one's
            first = np.flatnonzero(tk.run_starts(h, h2))[np.cumsum(tk.run_starts(h, h2)) - 1]
            own = np.flatnonzero(tk.run_starts(h, h2, d))[np.cumsum(tk.run_starts(h, h2, d)) - 1]
            later = np.unique(own[d > d[first]])
            equal = np.zeros(len(h), bool)
            for i in range(0, len(later), SHARD_BYTES // window + 1):
                part = later[i : i + SHARD_BYTES // window + 1]
                both = np.concatenate([np.unique(first[part]), part])
                text, _, _ = first_owners(t.column("content").take(pa.array(both)).to_pylist(), d[both], window)
                equal[both[text]] = True
            gone = equal[own]
            if gone.any():
                yield _spans(d[gone], loc[gone])

    rows = _contents(texts, runs, window, emit, "hash long, hash2 long, _id long, loc long, n long, settled boolean, content binary")
    return rows.repartition(rp.route("settled", "_id", "hash")).sortWithinPartitions("hash", "hash2", "_id", "loc").mapInArrow(sort, "_id long, loc long, n long")


def repeated_windows(rows: Rows, id_col: str, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(_id, loc, n): n consecutive windows from byte `loc` of row `loc >> 40` of `_id` also start in a smaller id."""
    texts = rp.numbered(rows, id_col)
    anchors = written(_anchors(rows, id_col, window, anchor), "anchors")
    runs = written(_runs(texts.join(anchors, "_id").select("_id", "_text", "_row", "_dup", "_anchors"), window, anchor), "runs")
    open_runs = written(_open_runs(runs, window), "open")
    discard(anchors)
    parts = _by_shard(_contents(texts, open_runs.where(f"crowd <= {shard_bytes}"), window), window, anchor)
    if not open_runs.where(f"crowd > {shard_bytes}").isEmpty():
        parts = parts.union(_by_window(texts, open_runs.where(f"crowd > {shard_bytes}"), window))
    out = written(runs.where("settled").select("_id", "loc", "n").union(parts), "windows")
    discard(runs, open_runs)
    return out


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of `docs`, and n_bytes, n_removed, n_spans and kept (binary).

    A byte of the UTF-8 text goes if a string of `window` bytes covers it that also starts in a
    document with a smaller id; strings lie in one document and are judged on the input.  n_spans
    counts maximal removed runs.  A null text is empty.  Ids are integers; other types are refused.
    Rows without an id are kept whole and are nobody's source; rows of one id don't remove from each
    other.  `kept` may break a character.  An input column with a result's name, in any case, is
    replaced.
    """
    added = "n_bytes long, n_removed long, n_spans long, kept binary"
    rows = Rows(docs, text_col, ("n_bytes", "n_removed", "n_spans", "kept"))

    def cut(batches):
        for b in batches:
            for i, j in tk.slices(b.column("_text"), PIECE_BYTES):
                part = b.slice(i, j - i)
                raw, off = tk.text_buffer(part.column("_text"))
                dups, spans = part.column("_dup").to_numpy(), part.column("_spans")
                out: list[list] = [[], [], [], []]
                for r in range(j - i):
                    own_bytes = raw[off[r] : off[r + 1]]
                    gone = np.zeros(len(own_bytes), bool)
                    if spans[r].is_valid and len(v := spans[r].values):
                        loc, n = v.field("loc").to_numpy(), v.field("n").to_numpy()
                        own = loc >> _DUP == dups[r]
                        gone = tk.covered(loc[own] & ((1 << _DUP) - 1), n[own] + window - 1, len(own_bytes))
                    starts = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (1 if len(gone) and gone[0] else 0))
                    for x, y in zip(out, (len(own_bytes), int(gone.sum()), starts, own_bytes[~gone].tobytes()), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], ["_row", "_text", "n_bytes", "n_removed", "n_spans", "kept"])

    parts = rp.with_spans(rows, id_col, repeated_windows(rows, id_col, window, anchor, shard_bytes))
    schema = schema_of(parts[0].select("_row", "_text"), added)
    out = parts[0].mapInArrow(cut, schema).union(parts[1].mapInArrow(cut, schema))
    return rows.result(out, "n_bytes", "n_removed", "n_spans", "kept")
