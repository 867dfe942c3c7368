"""Each stage of the pipeline against brute force over its own input, and the whole run."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from conftest import SF_DIR
from test_native import base
from test_texts import contaminated


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], SF_DIR), name.replace(" ", "-")))
    assert all(x.columns == columns for x in kept[:-1])
    raw, good, single, cut, clean = ([(r["doc_id"], r["text"]) for r in x.orderBy("doc_id").collect()] for x in kept[:-1])
    assert set(good) <= {row for row in raw if not base(row[1])[5]}
    assert single == [row for row, (d, c, _, _) in zip(good, brute.near_classes(good), strict=True) if d == c]
    words = [brute.SPACE_WORDS.findall(t) for _, t in single]
    gone = brute.removed_units(single, 13, brute.SPACE_WORDS.findall)
    assert cut == [(d, t if not any(g) else " ".join(x for x, y in zip(w, g, strict=True) if not y)) for (d, t), w, g in zip(single, words, gone, strict=True)]
    assert clean == [row for row, (n, hit, _) in zip(cut, contaminated(cut, items, 13), strict=True) if not (hit and 20 * hit >= n)]
    mixed = kept[-1].collect()
    copies = Counter(r["doc_id"] for r in mixed)
    assert all(copies[r["doc_id"]] == r["copies"] <= 2 for r in mixed) and set(copies) <= {d for d, _ in clean}
