"""Small messy tables and plain Python statements of the operators' rules."""

from __future__ import annotations

import random
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: doc_id and text, and columns whose names are those of results
SCHEMA = "doc_id long, text string, source string, n_words string, kept string, copies string, score string, labels string, n_removed string, `odd.name` int"


def messy(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows (doc_id, text): copies, near copies, shared passages, repeated rows and ids, nulls, blanks, one long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Größe", "naïve", "日本", "A-B", "x.y", "#", "…"]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    texts: list[str | None] = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 12, 13, 14, 40, 80]))]
        text = r.choice([" ", "  ", "\n", "\t"]).join(words)
        if i % 6 == 1:
            text = texts[r.randrange(i)] or ""
        elif i % 6 == 2:
            old = (texts[r.randrange(i)] or "").split(" ")
            old[r.randrange(len(old))] = "changed"
            text = " ".join(old)
        elif i % 6 == 3:
            text = f"{text} {passage} {text}"
        elif i % 6 == 4:
            text = "same " * r.randrange(10, 60)
        texts.append(text)
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    extra = [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, passage), (None, None), rows[0], rows[1], rows[1], (rows[2][0], f"other {passage}"), (n + 3, " ".join(r.choice(vocabulary) for _ in range(20_000))), (n + 4, passage), (-5, passage)]
    return rows + extra


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(d, t, ["a", "b", None][i % 3], "x", "y", None, "z", "l", None, i) for i, (d, t) in enumerate(rows)], SCHEMA)


def removed_units(rows: list[tuple], k: int, units) -> list[list[bool]]:
    """For each row, which of its units lie in a k-window that also starts in a smaller id."""
    split = [units(t) for _, t in rows]
    first: dict = {}
    for (d, _), u in zip(rows, split, strict=True):
        if d is not None:
            for i in range(len(u) - k + 1):
                w = tuple(u[i : i + k])
                first[w] = min(first.get(w, d), d)
    out = []
    for (d, _), u in zip(rows, split, strict=True):
        gone = [False] * len(u)
        if d is not None:
            for i in range(len(u) - k + 1):
                if first[tuple(u[i : i + k])] < d:
                    gone[i : i + k] = [True] * k
        out.append(gone)
    return out


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = SPACE_WORDS.findall(text or "")
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_classes(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, copy_id, n_links) of each row."""
    first: dict = {}
    for d, t in rows:
        if d is not None and (s := shingle_set(t)):
            first[s] = min(first.get(s, d), d)
    sets = list(first)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least: dict = {}
    for i, s in enumerate(sets):
        least[root(i)] = min(least.get(root(i), first[s]), first[s])
    place = {s: i for i, s in enumerate(sets)}
    out = []
    for d, t in rows:
        s = shingle_set(t)
        out.append((d, d, d, 0) if d is None or not s else (d, least[root(place[s])], first[s], links[place[s]]))
    return out
