"""Decontamination, license scan, toxicity, chat formatting and HTML extraction."""

from __future__ import annotations

import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat, decontaminate, html_text, licenses, queries, toxicity


def lower_words(text):
    return brute.ALNUM_WORDS.findall((text or "").translate(brute.UPPER))


# --- decontamination -------------------------------------------------------------------------


def contaminated(rows, items, k):
    """(n_words, n_hit, sorted item ids) of each row."""
    out = []
    for _, t in rows:
        w, hit, ids = lower_words(t), set(), set()
        for item, text in items:
            u = lower_words(text)
            n = min(k, len(u))
            windows = {tuple(u[i : i + n]) for i in range(len(u) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("bits", [(64, 23, 27), (1, 4, 4)])
def test_decontamination_equals_brute_force(spark, monkeypatch, bits):
    """A bitmap that is almost full lets everything through to the joins."""
    for name, value in zip(("BITS_EACH", "BITS_LEAST", "BITS_MOST"), bits, strict=True):
        monkeypatch.setattr(decontaminate, name, value)
    rows = brute.messy(9, 40)
    r = random.Random(1)
    items = [(i, " ".join(lower_words(rows[r.randrange(40)][1])[: r.choice([2, 5, 12, 13, 14, 30])])) for i in range(12)]
    items += [(20, None), (21, ""), (22, "W1"), (20, "w2 W3"), (None, "w1 w2"), (1, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = {x["odd.name"]: x for x in decontaminate.decontaminate(brute.frame(spark, rows), benchmark).collect()}
    expected = contaminated(rows, items, decontaminate.WINDOW)
    assert len(out) == len(rows) and sum(n for _, n, _ in expected) > 100
    for i, (n, hit, ids) in enumerate(expected):
        assert (out[i]["n_words"], out[i]["n_hit"], out[i]["items"]) == (n, hit, ids)
        assert out[i]["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_documents_join_hits_the_same_way_however_few(spark):
    """A join that is a broadcast for few hits and a shuffle for many doesn't grow in proportion."""
    benchmark = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    out = decontaminate.decontaminate(spark.createDataFrame([(1, "x a b"), (2, None)], "doc_id long, text string"), benchmark)
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["n_hit"] for r in out.collect()} == {1: 2, 2: 0}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(brute.frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert [(x["n_hit"], x["items"], x["contaminated"]) for x in out] == [(0, [], False)] * 2
    assert decontaminate.decontaminate(spark.createDataFrame([], brute.SCHEMA), none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=4, max_size=40), st.integers(0, 30), st.integers(4, 10))
def test_equal_windows_have_equal_fingerprints(words, start, length):
    """Any shared span of a window or more has a common fingerprint, so the join can't miss it."""
    import pyarrow as pa

    item = words[start : start + length]
    whole, part = (decontaminate.Windows(pa.array([" ".join(x)]), 2) for x in (words, item))
    for i in part.places(4).tolist():
        at = [j for j in whole.places(4).tolist() if words[j : j + 4] == item[i : i + 4]]
        assert at and {whole.fingerprints(4, False)[j] for j in at} == {part.fingerprints(4, False)[i]}
        assert {tuple(x[j] for x in whole.hashes(4)) for j in at} == {tuple(x[i] for x in part.hashes(4))}


def test_one_word_over_and_over(spark):
    """A million places of one window travel as one run."""
    import time

    rows = [(1, "w " * 1_000_000), (2, "w " * 30), (3, "v w")]
    benchmark = spark.createDataFrame([(i, "w " * n) for i, n in enumerate((1_000_000, 20, 12, 1))], "item_id long, text string")
    began = time.time()
    out = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in decontaminate.decontaminate(brute.frame(spark, rows), benchmark).collect()}
    assert out == {1: (1_000_000, 1_000_000, ["0", "1", "2", "3"]), 2: (30, 30, ["0", "1", "2", "3"]), 3: (2, 1, ["3"])}
    assert time.time() - began < 60


# --- licenses --------------------------------------------------------------------------------


def places(text):
    w = lower_words(text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_places_equal_brute_force(spark):
    r = random.Random(2)
    pool = ["GNU", "general", "public", "license", "Apache", "MIT", "cc", "BY", "-", "x", "Ünï"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.choice([0, 1, 3, 30, 300])))) for i in range(60)] + [(None, None), (7, "MIT License"), (7, "MIT License")]
    out = {x["odd.name"]: x for x in licenses.scan_licenses(brute.frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, (_, t) in enumerate(rows):
        x = out[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == places(t)
        assert set(x["base_labels"].split(",")) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
        assert (x["score"] > 0) == bool(x["labels"])


def test_license_notices_are_found_in_place(spark):
    for label, notice, _ in licenses.TEMPLATES:
        changed = notice.replace("license", "LICENSE", 1)
        rows = [(1, f"some code\n\n{notice}\n\nmore code"), (2, f"x = 1  # {changed}"), (3, " ".join(reversed(notice.split())))]
        out = {x["doc_id"]: x for x in licenses.scan_licenses(brute.frame(spark, rows)).collect()}
        assert label in out[1]["labels"].split(",") and out[1]["score"] > 0.9
        assert label in out[2]["labels"].split(",")
        assert label not in set(out[3]["labels"].split(",")) - set(out[3]["base_labels"].split(","))


def license_labels(texts):
    import pyarrow as pa

    return [set(x.split(",")) - {""} for x in licenses.scan_slice(pa.array(texts), licenses.RareWordIndex())["labels"]]


def test_numbered_bulleted_and_shortened_notices():
    bsd = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    numbered = bsd.replace("met: ", "met:\n\n  1. ")
    bulleted = bsd.replace("met: ", "met:\n\n  (a) ")
    named = bsd.replace("conditions are met", "conditions set by Some Company are met")
    shorter = bsd.replace("with or without modification, ", "")
    assert license_labels([numbered, bulleted, named, shorter, f"a b c\n{numbered} d e"]) == [{"bsd"}] * 5


@pytest.mark.parametrize("marker", ["dnl ", "REM ", "c     ", " * ", "# "])
@pytest.mark.parametrize("width", [30, 72])
def test_notices_with_a_word_before_each_line(marker, width):
    import textwrap

    for label, notice, _ in licenses.TEMPLATES:
        lines = [marker + x for x in textwrap.wrap(notice, width)]
        if len(lines) > 1:
            assert label in license_labels(["\n".join(["x = 1", *lines, "y = 2"])])[0], (label, lines)


def test_notices_of_other_licenses_and_far_phrases_have_no_label():
    by = {label: t for label, t, _ in licenses.TEMPLATES}
    assert license_labels([by["lgpl"], by["boost"], by["isc"]]) == [{"lgpl"}, {"boost"}, {"isc"}]
    keys = next(k for label, _, k in licenses.TEMPLATES if label == "bsd")
    assert license_labels([f"{keys[0]} {'other words ' * 40} {keys[1]}", f"{keys[1]} {keys[0]}", keys[0]]) == [set()] * 3


def test_licenses_of_nothing(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], brute.SCHEMA)).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def bags(spark, n=400):
    """Half of the documents hold one bad sentence among harmless ones."""
    r = random.Random(3)
    good, bad = [f"word{i}" for i in range(60)], [f"vile{i}" for i in range(6)]
    rows, labels = [], []
    for d in range(n):
        sentences = [" ".join(r.choice(good) for _ in range(8)) + "." for _ in range(r.randrange(2, 12))]
        if d % 2:
            words = [r.choice(good) for _ in range(6)]
            words[2] = r.choice(bad)
            sentences.insert(r.randrange(len(sentences)), " ".join(words) + ".")
        rows.append((d, " ".join(sentences)))
        labels.append((d, d % 2))
    return rows, labels


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rows, labels = bags(spark)
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    rows += [(1000, None), (1001, ""), (None, "vile1 word2."), (1, rows[1][1]), (2000, "word1 word2. " * 5000)]
    out = toxicity.toxicity(brute.frame(spark, rows), table).collect()
    assert len(out) == len(rows)
    from zlib import crc32

    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 400 and crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert held and all(x["held_out"] for x in held)
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in held) >= 0.95 * len(held)
    hit = sum(any("vile" in x["text"].encode()[s:].decode().split(".")[0] for s in x["offending"]) for x in held if x["doc_id"] % 2)
    assert hit >= 0.9 * sum(x["doc_id"] % 2 for x in held)
    by_id = {x["doc_id"]: x for x in out}
    assert by_id[1000]["score"] == by_id[1001]["score"] == 0.0 and not by_id[None]["held_out"]
    assert by_id[2000]["predicted"] == 0 and by_id[2000]["offending"] == []  # however many harmless sentences
    again = toxicity.toxicity(brute.frame(spark, rows).repartition(3), table).collect()
    assert {x["odd.name"]: x["score"] for x in again} == {x["odd.name"]: x["score"] for x in out}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(brute.frame(spark, [(1, "a b. c"), (2, None)]), none).collect()
    assert all(x["predicted"] == 0 for x in out)
    assert toxicity.toxicity(spark.createDataFrame([], brute.SCHEMA), none).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(r["score"], labels[r["doc_id"]]) for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.9
    assert sum((s >= 0.3) == bool(y) for s, y in out) >= 0.9 * len(out)


# --- chat ------------------------------------------------------------------------------------

hostile = st.text(st.sampled_from(list("\\#<>/tun A:\n\r\t\u2028\x00é日")), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(hostile, hostile), max_size=6))
def test_chat_round_trip(turns):
    program = chat.compile_template()
    text = "".join(s for s, _ in program({"messages": ({"role": r, "text": t} for r, t in turns)}))
    assert chat.read_turns(text) == turns
    masked = [chat.unescape(s) for s, m in program({"messages": ({"role": "assistant", "text": t} for _, t in turns)}) if m]
    assert masked == [t for _, t in turns]


def test_chat_edge_rows(spark):
    long = "x<" * 100_000
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", "a"), (1, None, None, "first"), (None, 1, "user", "q"), (2, 1, "assistant", long), (2, 2, "user", long), (2, 2, "user", long)]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    import hashlib

    def digest(pairs):
        return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()

    assert out[1]["turns_sha256"] == digest([("", "first"), ("user", ""), ("user", "a"), ("assistant", "b")])
    assert out[2]["turns_sha256"] == digest([("assistant", long), ("user", long), ("user", long)]) and out[2]["n_turns"] == 3
    assert out[2]["loss_chars"] == len(long) and out[2]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert out[None]["n_turns"] == 1 and out[None]["loss_chars"] == 0
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_template_language():
    run = lambda source, **scope: "".join(s for s, _ in chat.compile_template(source)(scope))
    assert run("{{ 'a' + 'b' }}{% if x == 1 %}one{% elif x %}some{% else %}none{% endif %}", x=2) == "absome"
    assert run("{% for m in ms %}{{ m.t|esc }};{% endfor %}", ms=[{"t": "<"}, {"t": "\\"}]) == "\\<;\\\\;"
    assert chat.fold(chat.parse("{% if 1 == 1 and not '' %}a{{ 'b' }}{% else %}{{ x }}{% endif %}c")) == [("text", "abc")]
    for bad in ("{{ f() }}", "{{ x.__class__ }}x{% nope %}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x|open }}", "{{ 1 + }}", "{{ x[0] }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


# --- HTML ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a <b>b</b>\n c<p>d", "a b c\n\nd"),
        ("<head><title>t</title></head><body>x<script>if (a < b) {}</script><!-- no -->y</body>", "xy"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>v</table>", "k         value\nlong key  v"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<div hidden>x</div><div style='display: none'>y</div><span aria-hidden=true>z</span>w", "w"),
        ("a &amp; b &lt;c&gt; &#233;", "a & b <c> é"),
        ("one<br>two<br/>three", "one\ntwo\nthree"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("</p></div>x</b>", "x"),
        ("<p>a < b", "a < b"),
        ("<noscript>x</noscript><template>y</template>z", "z"),
    ],
)
def test_pages(page, text):
    assert html_text.page_text(page) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("<>/ab lip\"'=-!&;\n")), max_size=80))
def test_any_markup_renders(page):
    html_text.page_text(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<head><meta charset=utf-8>\n<link rel=x><style>a{}</style><script>b</script>\nHello <b>you</b>", "Hello you"),
        ("<head><title>T</title><noscript>n</noscript><template>t</template><!-- c --> <h1>a</h1>b", "a\n\nb"),
        ("<head>&nbsp;x</head>y", "\xa0xy"),
        ("<head><title>T</title><body>a<head><title>U</title>b", "ab"),
    ],
)
def test_content_ends_an_open_head(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("depth", [10, 399, 500, 5_000])
def test_depth_keeps_hidden_state_end_tags_and_layout(depth):
    opened, closed = "<div>" * depth, "</div>" * depth
    assert html_text.page_text(f"{opened}a<div hidden>secret</div><p style='display:none'>secret</p>b{closed}c") == "ab\nc"
    assert html_text.page_text(f"<div hidden>{opened}secret{closed}secret</div>shown") == "shown"
    assert html_text.page_text(f"{opened}<pre>a\n  b</pre><ul><li>c<li>d</ul><table><tr><th>k<th>value<tr><td>long<td>v</table>{closed}") == "a\n  b\n\n- c\n- d\n\nk     value\nlong  v"


def test_deep_long_and_empty_pages(spark):
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    lists = "<ul><li>" * 2_000 + "y"
    tables = "<table><tr><td>" * 2_000 + "z"
    rows = [(1, deep, "c"), (2, None, "c"), (3, "", "c"), (None, "<p>q", "c"), (None, "<p>q", "c"), (4, "<p>w</p>" * 50_000, "c"), (5, lists, "c"), (6, tables, "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumnRenamed("page_id", "page.id")
    out = html_text.extract_text(pages).collect()
    found = {r["page.id"]: r["text"] for r in out}
    assert len(out) == len(rows) and found[1] == "x" and found[2] == found[3] == "" and found[None] == "q"
    assert found[4].count("w") == 50_000 and "y" in found[5] and "z" in found[6]
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<b hidden>" + "<div>" * 1000 + "secret</b>visible", "visible"),
        ("<div style='visibility:hidden'>a<span style='visibility: visible'>b</span>c</div>d", "b\nd"),
        ("<div hidden>a<p style='visibility:visible'>b</p></div>c", "c"),
        ("<b style='visibility:hidden'>a<div>b</b>c</div>d", "c\nd"),
        ("<svg><title>t</title><text>w<tspan>x</tspan></text><desc>d</desc></svg>y", "wxy"),
        ("<math><mi>x</mi><annotation>a</annotation></math>", "x"),
        ("<!-- x --!>b", "b"),
        ("a<!-->b-->c", "ab-->c"),
        ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
        ("<details>a<summary>b</summary>c<summary>d</summary></details>e", "b\ne"),
        ("<div hidden><details><summary>a</summary></details><svg><text>b</text></svg></div>c", "c"),
        ("<details open>a</details>", "a"),
        ("<input value=a> <input type=hidden value=b> <input type=checkbox value=c>", "a"),
    ],
)
def test_visibility_rules(page, text):
    assert html_text.page_text(page) == text


def test_layout_without_bounds_keeps_every_indent():
    page = "<ul><li>" * 30 + "x"
    free = html_text.Layout(None, None, None)
    assert html_text.page_text(page, free).splitlines()[-1].endswith("- x") and len(html_text.page_text(page, free).splitlines()[-1]) > len(html_text.page_text(page).splitlines()[-1])
    table = "<table><tr><td>" * 9 + "a<td>b"
    assert "a  b" in html_text.page_text(table, free) and "a  b" not in html_text.page_text(table)
