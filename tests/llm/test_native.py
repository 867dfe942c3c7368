"""Quality rules and mixing: brute force over messy rows, and edge cases."""

from __future__ import annotations

import math
from collections import Counter

import brute
import pytest
import xxhash

from millrace.llm import mixing, quality


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_word(w: str) -> int:
    return xxhash.xxh64(w.encode(), seed=42).intdigest()


def hash_long(x: int, seed: int = 42) -> int:
    return xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest()


def grams(text: str | None) -> list[int]:
    h = [hash_word(w) for w in brute.SPACE_WORDS.findall(text or "")]
    out = []
    for i, x in enumerate(h):
        pair = hash_long(x)
        if i + 1 < len(h):
            pair = hash_long(h[i + 1], pair)
        out += [signed(x) % quality.BUCKETS, signed(pair) % quality.BUCKETS]
    return out


def base(text: str | None) -> tuple:
    text = text or ""
    w = brute.SPACE_WORDS.findall(text)
    lines = [x for x in text.split("\n") if brute.SPACE_WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside[i : i + 8] = [True] * 8
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(inside), n < 20 or 100 * sum(inside) > 30 * n


def test_quality_equals_brute_force(spark):
    rows = [*brute.messy(6), (900, "a b\na b\n\n a b\nc $$ |\n" * 6), (901, "same " * 300)]
    trusted = {3, 7, 15, 21, 33, 63}
    labels = spark.createDataFrame([(d, 1) for d in sorted(trusted)] + [(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = {r["odd.name"]: r for r in quality.quality(brute.frame(spark, rows), labels, threshold=0.0).collect()}
    raw, target = Counter(), Counter()
    for d, t in rows:
        g = grams(t)
        raw.update(g)
        if d in trusted:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = lambda n, total: math.log((n + quality.SMOOTHING) / (total + quality.SMOOTHING * quality.BUCKETS))
    verdicts = set()
    for i, (d, t) in enumerate(rows):
        r, g = out[i], grams(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t)
        llr = sum(share(target[b], n_target) - share(raw[b], n_raw) for b in g) / len(g) if g else 0.0
        assert r["llr"] == pytest.approx(llr, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= 0.0)
        verdicts.add(r["kept"])
    assert verdicts == {True, False} and len(out) == len(rows)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert quality.quality(empty, none).count() == 0
    r = quality.quality(brute.frame(spark, [(1, "a b c " * 10)]), none).first()
    assert r["llr"] == 0.0 and r["base_failed"]


def test_quality_has_no_python(spark):
    docs = brute.frame(spark, brute.messy(7, 6))
    plan = quality.quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_trusted_documents_count(spark):
    """Where all documents are trusted, however many, both multinomials are equal, so all scores are 0."""
    docs = spark.range(20_400).selectExpr("id AS doc_id", "concat_ws(' ', concat('w', id), concat('v', id % 77), 'end') AS text")
    out = quality.quality(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert out.where("llr <> 0.0").count() == 0


@pytest.mark.parametrize("ranges", [16, 4096])
def test_quantile_is_exact(spark, monkeypatch, ranges):
    monkeypatch.setattr(quality, "RANGES", ranges)
    values = spark.range(999).selectExpr("IF(id % 5 = 0, -0.25D, sin(id * id) * pow(10, id % 4)) AS llr").cache()
    for share in (0.01, 0.456):
        assert quality.quantile(values, share) == pytest.approx(values.selectExpr(f"percentile(llr, {share})").first()[0], abs=1e-12)
    assert quality.quantile(values.where("llr = -0.25"), 0.01) == -0.25 and quality.quantile(values.limit(0), 0.01) is None


def filled(sizes: dict) -> dict:
    """Targets by filling step by step."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap, pool, open_ = {s: 2 * sizes[s] for s in order}, 1.5 * sum(sizes.values()), set(order)
    target: dict = {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if pool * weight[s] / total >= cap[s]]
        if not over:
            target |= {s: pool * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(cap[s])
            open_.discard(s)
        pool -= sum(cap[s] for s in over)
    return target


def test_mixing_fills_to_caps_and_repeats(spark):
    rows = brute.messy(8, 90)
    docs = brute.frame(spark, rows).repartition(5)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = Counter()
    for i, (_, t) in enumerate(rows):
        size[["a", "b", None][i % 3]] += len(brute.SPACE_WORDS.findall(t or ""))
    target = filled(dict(size))
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 2 * r["size"]
    assert sorted(map(repr, mixing.mix(docs.coalesce(1)).collect())) == sorted(map(repr, out))
    copies = mixing.repeated(mixing.mix(docs)).groupBy("`odd.name`").count().collect()
    assert {r["odd.name"]: r["count"] for r in copies} == {r["odd.name"]: r["copies"] for r in out if r["copies"]}


def test_mixing_empty_and_wordless(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert mixing.mix(empty).count() == 0
    r = mixing.mix(brute.frame(spark, [(1, None), (2, "")])).collect()
    assert [x["taken"] for x in r] == [0, 0]


def test_a_filter_on_results_does_not_repeat_their_work(spark):
    """The time of one long text stays in proportion when only kept rows are asked for."""
    import time

    text = " ".join(f"w{i * i % 99_991}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text[:200])], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality(docs, labels, threshold=0.0)
    began = time.time()
    kept = out.where("kept").select("doc_id", "text").collect()
    assert time.time() - began < 20 and {r["doc_id"] for r in kept} == {r["doc_id"] for r in out.collect() if r["kept"]} == {1, 2}
