"""Columns whose names clash with results or with the operators' own, and ids that aren't integers."""

from __future__ import annotations

import pytest

from millrace.llm import decontaminate, html_text, jaccard, language, licenses, mixing, quality, substrings, suffixes, toxicity

EXTRA = ["_h", "_runs", "_items", "_row", "_id", "digest", "Score", "N_Words", "KEPT", "Labels", "Taken", "a`b", "a.b", "c0", "any"]


def tables(spark):
    text = "GNU General Public License w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"
    rows = [(i, t, "s", f"<p>{t}", *["x"] * len(EXTRA)) for i, t in enumerate([text, text, None, "", "other"])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "html", *[f"e{i}" for i in range(len(EXTRA))]]).toDF("doc_id", "text", "source", "html", *EXTRA)
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    return docs, labels, benchmark


OPERATORS = {
    "html": lambda d, lab, b: html_text.extract_text(d), "quality": lambda d, lab, b: quality.quality(d, lab), "substrings": lambda d, lab, b: substrings.dedup_substrings(d), "decontaminate": lambda d, lab, b: decontaminate.decontaminate(d, b),
    "mixing": lambda d, lab, b: mixing.repeated(mixing.mix(d)), "jaccard": lambda d, lab, b: jaccard.one_of_each(d), "licenses": lambda d, lab, b: licenses.scan_licenses(d), "suffixes": lambda d, lab, b: suffixes.dedup_bytes(d), "toxicity": lambda d, lab, b: toxicity.toxicity(d, lab),
    "language": lambda d, lab, b: language.identify(d, lang_col="source"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_column_names(spark, name):
    docs, labels, benchmark = tables(spark)
    out = OPERATORS[name](docs, labels, benchmark)
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower)
    results = {c.lower() for c in out.columns if c not in docs.columns}
    assert {c for c in docs.columns if c.lower() not in results and c != "html"} <= set(out.columns)
    rows = out.collect()
    assert rows and all(r["a`b"] == r["a.b"] == r["_row"] == "x" for r in rows)


def test_ids_that_are_not_integers(spark):
    docs = spark.createDataFrame([("a", "w1 w2"), (None, "w1 w2")], "doc_id string, text string")
    for f in (substrings.dedup_substrings, suffixes.dedup_bytes, jaccard.near_duplicates):
        with pytest.raises(TypeError):
            f(docs)
    none = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    items = spark.createDataFrame([("i", "w1")], "item_id string, text string")
    assert [r["items"] for r in decontaminate.decontaminate(docs, items).collect()] == [["i"], ["i"]]
    assert quality.quality(docs, none).count() == toxicity.toxicity(docs, none).count() == licenses.scan_licenses(docs).count() == 2
