"""Substring deduplication by words and by bytes, and near duplicates, against brute force."""

from __future__ import annotations

import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import _tokens as tk
from millrace.llm import jaccard, substrings, suffixes


def as_words(text):
    return brute.SPACE_WORDS.findall(text or "")


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    rows = brute.messy(seed)
    out = substrings.dedup_substrings(brute.frame(spark, rows))
    assert sorted(out.columns) == sorted({"doc_id", "text", "source", "n_words", "kept", "copies", "score", "labels", "n_removed", "odd.name", "kept_text"})
    found = {r["odd.name"]: (r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}
    gone = brute.removed_units(rows, substrings.WINDOW, as_words)
    assert len(found) == len(rows) and sum(map(sum, gone)) > 100
    for i, ((d, t), g) in enumerate(zip(rows, gone, strict=True)):
        w = as_words(t)
        assert found[i] == (d, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y))


@pytest.mark.parametrize(("shard_bytes", "most_run"), [(1 << 20, 4096), (1, 7)])
def test_bytes_equal_brute_force(spark, monkeypatch, shard_bytes, most_run):
    monkeypatch.setattr(suffixes, "MOST_RUN", most_run)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard_bytes)
    rows = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in brute.messy(3, 40)]
    out = suffixes.dedup_bytes(brute.frame(spark, rows), shard_bytes=shard_bytes)
    found = {r["odd.name"]: (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    gone = brute.removed_units(rows, suffixes.WINDOW, lambda t: (t or "").encode())
    assert len(found) == len(rows) and sum(map(sum, gone)) > 100
    for i, ((d, t), g) in enumerate(zip(rows, gone, strict=True)):
        b = (t or "").encode()
        spans = sum(y and not x for x, y in zip([False, *g], g, strict=False))
        assert found[i] == (d, len(b), sum(g), spans, bytes(x for x, y in zip(b, g, strict=True) if not y))


def test_a_shard_sorts_a_shared_stretch_once(spark, monkeypatch):
    """20 different texts have 60 bytes in common: these are sorted, not the texts."""
    common, original = bytes(range(65, 125)), suffixes.first_owners

    def counted(texts, owner, window):
        assert sum(map(len, texts)) == len(common)
        return original(texts, owner, window)

    monkeypatch.setattr(suffixes, "first_owners", counted)
    rows = [(5, i, 7, bytes([200 + i]) * 500 + common + bytes([220 + i]) * 500) for i in range(20)]
    contents = spark.createDataFrame(rows, "anchor long, _id long, loc long, content binary")
    found = suffixes._by_shard(contents, suffixes.WINDOW, suffixes.ANCHOR).collect()
    assert sorted((r["_id"], r["loc"], r["n"]) for r in found) == [(i, 507, 11) for i in range(1, 20)]


def python_steps(plan) -> tuple[int, int]:
    """Of a physical plan: most steps on Python workers in one task, and those in the last stage's."""
    plan = plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    below = [python_steps(plan.children().apply(k)) for k in range(plan.children().size())]
    here = sum(x for _, x in below) if plan.nodeName() != "Union" else max(x for _, x in below)
    here = 0 if "Exchange" in plan.nodeName() else here + (plan.nodeName() == "MapInArrow")
    return max([here, *(x for x, _ in below)]), here


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Workers stay in an executor's pool, where each keeps what it once took: two in a task double that."""
    steps, original = {}, suffixes.written

    def noted(df, name):
        steps[name], _ = python_steps(df._jdf.queryExecution().executedPlan())
        return original(df, name)

    monkeypatch.setattr(suffixes, "written", noted)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1)
    assert suffixes.dedup_bytes(brute.frame(spark, brute.messy(3, 40)), shard_bytes=1).count()
    assert steps == {"anchors": 1, "runs": 1, "open": 0, "windows": 1}


def test_pieces_are_bounded_in_bytes():
    batches = [pa.RecordBatch.from_pydict({"k": list(range(i, i + 9)), "content": pa.array([bytes([i + k]) * n for k, n in enumerate(sizes)], pa.binary())}) for i, sizes in ((0, [3] * 9), (9, [0, 1, 2, 90, 0, 4, 5, 6, 7]))]
    pieces = list(suffixes._pieces(iter(batches), "content", 10))
    assert [r for t in pieces for r in t.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert all(t.num_rows == 1 or sum(map(len, t["content"].to_pylist())) <= 10 for t in pieces) and len(pieces) <= 11


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 9)), max_size=30), st.integers(1, 9))
def test_orders_and_sliding_minima(rows, width):
    a, b, c = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    order = tk.ordered(a, b, c)
    assert sorted(order.tolist()) == list(range(len(rows))) and [rows[k] for k in order] == sorted(rows)
    assert tk.sliding_min(c, width).tolist() == [min(c[k : k + width].tolist()) for k in range(len(c))]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert substrings.dedup_substrings(empty).count() == 0
    assert suffixes.dedup_bytes(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.one_of_each(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=60))
def test_suffix_array_and_common_prefixes(symbols):
    s = np.array([*symbols, 0], np.int64)
    sa = suffixes.suffix_array(s)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    lcp = suffixes.permuted_lcp(s, sa)

    def common(a, b):
        n = 0
        while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        return n

    for before, at in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        assert lcp[at] == common(before, at)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab", max_size=20)), max_size=8))
def test_first_owners(items):
    texts, owner = [t.encode() for _, t in items], np.array([d for d, _ in items], np.int64)
    text, place, least = suffixes.first_owners(texts, owner, 4)
    first: dict = {}
    for d, t in zip(owner.tolist(), texts, strict=True):
        for i in range(len(t) - 3):
            first[t[i : i + 4]] = min(first.get(t[i : i + 4], d), d)
    expected = sorted((n, i, first[t[i : i + 4]]) for n, (d, t) in enumerate(zip(owner.tolist(), texts, strict=True)) for i in range(len(t) - 3) if first[t[i : i + 4]] < d)
    assert sorted(zip(text.tolist(), place.tolist(), least.tolist(), strict=True)) == expected


@pytest.mark.parametrize(("bucket", "component"), [(4096, 1024), (4, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, bucket, component):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", bucket)
    monkeypatch.setattr(jaccard, "COMPONENT_BLOCK", component)
    rows = brute.messy(4, 80)
    base = " ".join(f"u{i}" for i in range(40))
    rows += [(500 + i, base.replace(f"u{i * 3}", "v", 1) if i else base) for i in range(12)]
    out = jaccard.near_duplicates(brute.frame(spark, rows)).collect()
    found = sorted(((r["doc_id"], r["text_digest"], r["class_id"], r["copy_id"], r["n_links"]) for r in out), key=repr)
    expected = sorted(((d, hashlib.md5((t or "").encode()).hexdigest(), c, k, n) for (d, t), (_, c, k, n) in zip(rows, brute.near_classes(rows), strict=True)), key=repr)
    assert found == expected
    assert max(r["n_links"] for r in out) > 3


def test_one_of_each(spark):
    rows = brute.messy(5, 60)
    kept = jaccard.one_of_each(brute.frame(spark, rows)).collect()
    classes = brute.near_classes(rows)
    expected = {(d, t) for (d, t), (_, c, _, _) in zip(rows, classes, strict=True) if d is not None and c == d}
    assert {(r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None} == expected
    assert len(kept) == len(expected) + sum(d is None for d, _ in rows)
