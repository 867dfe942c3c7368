"""Conversation repair and ranked search against brute force, language identification on held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import brute
import pytest
from conftest import SF_DIR

from millrace.llm import language, queries, repair, wand

# --- conversation repair -----------------------------------------------------------------------


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits; rows: (role, text, must go, truncated)."""
    paths = {("", ""): (0, "", [])}  # the last two role initials decide what may follow

    def allowed(last, c):
        return last[-1:] + c in ("s", "u", "su", "ua", "au")

    def better(a, b):
        return b if a is None or b[:2] < a[:2] else a

    def grown(found):
        new = dict(found)
        for _ in range(3):
            for (s, last), (cost, audit, out) in list(new.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if allowed(last, c):
                        key = (s, c)
                        new[key] = better(new.get(key), (cost + 2, audit + "I", [*out, (role, "")]))
        return new

    for role, text, must, truncated in rows:
        found = {}
        for (s, last), (cost, audit, out) in grown(paths).items():
            options = [((s, last), (cost + 3, audit + "D", out))]
            if not must:
                c = role[:1]
                if c and c in "sua" and allowed(last, c):
                    options.append(((s or c == "s", c), (cost + truncated, audit + "K", [*out, (role, text)])))
                options += [((s, x), (cost + 2 + truncated, audit + "R", [*out, (new, text)])) for x, new in (("u", "user"), ("a", "assistant")) if allowed(last, x)]
            for key, value in options:
                key = ("", key[1])
                found[key] = better(found.get(key), value)
        paths = found
    ends = [v for (_, last), v in grown(paths).items() if last in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def expected(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in rows}
    by = {}
    for c, t, r, x in damage(rows):
        by.setdefault(c, []).append((t, r, x))
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, r, x in own:
            shown = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (r, x) in seen else "" if shown[-1] in ".!?" else "truncated")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        n = Counter(faults)
        cost, audit, said = cheapest([(r, x, f in ("blank", "duplicate"), int(f == "truncated")) for (_, r, x), f in zip(own, faults, strict=True)])
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest())
    return out


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, t, t + 1, None]) if c % 3 == 0 else t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "-"]), r.choice(["Hi.", "no", "Yes!", "", " \n", None, "a? b", "é. ", "-!"])))
    rows += [(1000, t, ["user", "assistant", "system"][r.randrange(3)], f"t{r.randrange(40)}{r.choice(['.', ''])}") for t in range(300)]
    rows += [(1000, 7, "user", "same.")] * 50 + [(None, 1, "user", "q?"), (None, None, "assistant", "a."), (None, 1, "user", "q?")]
    return rows


@pytest.mark.parametrize("seed, size", [(1, 4096), (2, 3), (3, 1)])
def test_repair_equals_brute_force(spark, seed, size):
    """Segments of one or three rows give what whole conversations give."""
    rows = conversations(seed)
    turns = spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, text string, Audit string")
    got = repair.with_empty(repair.report(repair.repair(repair.damaged(turns), size)), turns)
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == expected(rows)


def test_repaired_turns_alternate(spark):
    turns = spark.createDataFrame(conversations(5), "conv_id long, turn long, role string, text string")
    rows = repair.repaired_turns(repair.repair(turns, 7)).orderBy("conv_id", "no", "place").collect()
    for _, own in itertools.groupby(rows, key=lambda r: r["conv_id"]):
        initials = "".join(r["role"][0] for r in own)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.with_empty(repair.report(repair.repair(repair.damaged(none))), none).count() == 0


# --- ranked search -----------------------------------------------------------------------------


def ranked(rows, items, k=50):
    words = lambda t: brute.ALNUM_WORDS.findall((t or "").translate(brute.UPPER))
    docs = [(d, Counter(words(t))) for d, t in rows if words(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, k", [(1 << 23, 50), (400, 5), (1, 3)])
def test_search_equals_brute_force(spark, monkeypatch, shard, k):
    monkeypatch.setattr(wand, "SHARD_BYTES", shard)
    rows = brute.messy(4, 80)
    items = [(1, "w1 W2 Größe"), (2, rows[3][1]), (3, None), (4, "none of these"), (5, ""), (None, "日本 w7"), (1, "w9"), (6, rows[10][1])]
    index = wand.build_index(brute.frame(spark, rows))
    got = wand.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted((tuple(r) for r in got), key=repr) == ranked(rows, items, k)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(wand, "BLOCK_PAIRS", 7)
    rows = brute.messy(8, 30)
    items = [(f"i{i}", f"w{i} w{i + 1} w{i + 2}") for i in range(20)]
    index = wand.build_index(brute.frame(spark, rows))
    got = wand.search(index, spark.createDataFrame(items, "item_id string, text string"), 4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == ranked(rows, items, 4)


def test_pivots_are_few():
    """With a threshold near the best score few documents are scored, and the best ones are among them."""
    import numpy as np

    r = np.random.default_rng(1)
    lists = []
    for share, top in ((0.9, 10), (0.5, 100), (0.01, 1000)):
        places = np.flatnonzero(r.random(10_000) < share)
        impacts = r.integers(1, top + 1, len(places))
        lists.append((places, impacts, int(impacts.max())))
    score = np.zeros(10_000, np.int64)
    for places, impacts, _ in lists:
        score[places] += impacts
    threshold = int(np.sort(score)[-20])
    pivots = wand._pivots(lists, threshold, 10_000)
    assert set(np.flatnonzero(score >= threshold)) <= set(pivots) and len(pivots) < 200
    assert (wand._scores(lists, pivots) == score[pivots]).all()


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert wand.search(wand.build_index(none), items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert wand.search(wand.build_index(docs), items.limit(0)).count() == 0


# --- language identification -------------------------------------------------------------------


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs}
    rows = queries.op12_language_id(spark, SF_DIR).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["lang_pred"] in {*lang.values(), "und"} for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert sum(not r["rejected"] for r in held) >= 0.8 * len(held)


def test_labels_of_held_out_rows_are_never_used(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    changed = docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 'zz' ELSE lang END AS lang", "text")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(x).collect()} for x in (docs, changed))
    assert a == b


def test_odd_rows_have_no_language(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("", "en"), ("12 -- !", "fr"), ("日本語", "ja"), ("the dog", None)] * 6)] + [(None, "le chien", "fr"), (0, "the cat", "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, SCORE string")
    out = language.identify(docs).collect()
    assert len(out) == len(rows) and all((r["lang_pred"] == "und") == (r["text"] in (None, "", "12 -- !")) for r in out)
    assert all(r["score"] == 0 and r["rejected"] for r in out if r["lang_pred"] == "und")
    assert {(r["text"], r["lang_pred"]) for r in out if r["text"] in ("日本語", "le chien", "the dog")} == {("日本語", "ja"), ("le chien", "fr"), ("the dog", "en")}
    none = language.identify(docs.withColumn("lang", docs.lang.substr(0, 0)).where("false"))
    assert none.count() == 0
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = "the quick brown fox " * 500
    whole = sum(c for _, c in language.gram_counts(pa.array([text])))
    monkeypatch.setattr(language.tk, "SLICE_BYTES", 2000)
    pieces = sum(c for _, c in language.gram_counts(pa.array([text])))
    assert 0 < np.abs(whole - pieces).sum() <= 3 * 5  # only n-grams across the four seams are missing
