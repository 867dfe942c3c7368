"""HTML extraction against an independent renderer of random trees, and toxicity's scores against plain Python."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import html_text, queries, toxicity

INLINE, BLOCKS = ("span", "b", "em"), ("div", "p", "section")


def tree(r: random.Random, depth: int = 0) -> list:
    """Children: words, or (tag, hidden, children)."""
    out: list = []
    for _ in range(r.randrange(1, 5)):
        if depth > 4 or r.random() < 0.4:
            out.append(f"w{r.randrange(1000)}")
        else:
            tag = r.choice(INLINE if r.random() < 0.4 else BLOCKS)
            inside = tree(r, depth + 1)
            if tag == "p" or tag in INLINE:  # what may stand inside them
                inside = [x for x in inside if isinstance(x, str) or x[0] in INLINE]
            out.append((tag, r.random() < 0.2, inside))
    return out


def markup(r: random.Random, children: list) -> str:
    parts = []
    for x in children:
        if isinstance(x, str):
            parts.append(f" {x} ")
        else:
            tag, hidden, inside = x
            attribute = r.choice([" hidden", " style='display:none'", " aria-hidden=true", " hidden data-x=/a/"]) if hidden else r.choice(["", " class=\"a>b\"", " data-y"])
            parts.append(f"<{tag}{attribute}>{markup(r, inside)}</{tag}>")
    return "".join(parts)


def shown(children: list) -> str:
    """Words on lines; blocks stand on lines of their own, set apart by a blank line if p or section."""
    lines: list[list[str]] = [[]]
    gaps = {0: False}

    def brk(blank):
        if lines[-1]:
            lines.append([])
            gaps[len(lines) - 1] = False
        gaps[len(lines) - 1] = gaps[len(lines) - 1] or blank

    def walk(nodes):
        for x in nodes:
            if isinstance(x, str):
                lines[-1].append(x)
            elif not x[1]:
                if x[0] in BLOCKS:
                    brk(x[0] != "div")
                    walk(x[2])
                    brk(x[0] != "div")
                else:
                    walk(x[2])

    walk(children)
    text = "\n".join(("\n" if gaps[i] and i else "") + " ".join(line) for i, line in enumerate(lines) if line)
    return text.strip("\n")


def test_pages_equal_an_independent_renderer(spark, tmp_path):
    r = random.Random(7)
    trees = [tree(r) for _ in range(400)]
    rows = [(i, "u", markup(r, t)) for i, t in enumerate(trees)]
    spark.createDataFrame([*rows, (9999, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {x["page_id"]: x["text"] for x in queries.op1_html_text(spark, str(tmp_path)).collect()}
    assert out.pop(9999) == "" and len(out) == len(trees)
    assert any(y[1] for t in trees for y in t if not isinstance(y, str))
    for i, t in enumerate(trees):
        assert out[i] == shown(t), rows[i][2]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "<b hidden>secret</b>x", "<ul><li>" * 20_000 + "x", "<table>" * 50_000 + "x", "<table><tr><td>" * 20_000 + "x", "<a " * 300_000, "<a b='" * 100_000, "<table><tr>" + "<td>x" * 5000 + "<td>" + "<br>y" * 5000])
def test_hard_pages_take_time_in_proportion(page):
    import time

    began = time.time()
    text = html_text.page_text(page)
    assert time.time() - began < 30 and "secret" not in text and len(text) <= 20 * len(page)
    assert ("x" in text) == ("x" in page)


def test_scores_equal_plain_python():
    texts = ["good vile one. fine day! vile vile worse? ok", "nothing here", "", "vile", None, "vileness. vile\nvile"]
    words = pa.array(["vile", "worse", "good"])
    keys = np.sort(np.concatenate([toxicity.Bags(words.slice(i, 1)).feature for i in range(3)]))
    weight, bias = np.linspace(0.5, 2.0, len(keys)), -2.0
    got, _ = toxicity.score(pa.array(texts), (keys, weight, bias))
    for t, p in zip(texts, got, strict=True):
        kept = 1.0
        for sentence in re.split(r"[\n!.?]", t or ""):
            if not re.search(r"[0-9a-z]", sentence):
                continue
            features = set(toxicity.Bags(pa.array([sentence])).feature.tolist())
            logit = bias + sum(w for k, w in zip(keys.tolist(), weight.tolist(), strict=True) if k in features)
            own, none = math.log1p(math.exp(logit)), math.log1p(math.exp(bias))
            kept *= math.exp(-max(0.0, own - none))
        assert p == pytest.approx(1 - kept)
