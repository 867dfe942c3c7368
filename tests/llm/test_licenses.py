"""License labels and scores against a plain statement of the rule, without index, hashes or arrays."""

from __future__ import annotations

import math
import random
from collections import Counter

import brute
import pytest

from millrace.llm import licenses as lic


def words(text):
    return brute.ALNUM_WORDS.findall((text or "").translate(brute.UPPER))


def starts(text, phrase):
    n = len(phrase)
    return [i for i in range(len(text) - n + 1) if text[i : i + n] == phrase]


class Template:
    def __init__(self, label, text, keys, df, n):
        self.label, self.words, self.keys = label, words(text), [words(k) for k in keys]
        idf = {w: math.log(1 + n / df[w]) for w in set(self.words)}
        first = {w: self.words.index(w) for w in idf}
        rare = sorted(idf, key=lambda w: (-idf[w], first[w]))[: max(lic.RARE_LEAST, int(lic.RARE_SHARE * len(idf)))]
        self.rare = [(i, w, idf[w]) for i, w in enumerate(self.words) if w in rare]
        self.total = sum(x for _, _, x in self.rare)
        self.band = max(lic.BAND_LEAST, int(lic.BAND_SHARE * len(self.words)))
        self.offsets = [starts(self.words, k)[0] for k in self.keys]

    def may_stand_in(self, text):
        """Some three neighbouring bands of relative positions hold enough of the rare words' weight."""
        bands: dict[int, set] = {}
        for at, w in enumerate(text):
            for i, (place, own, _) in enumerate(self.rare):
                if own == w:
                    bands.setdefault((at - place) // self.band, set()).add(i)
        for b in {x - back for x in bands for back in range(3)}:
            found = set().union(*(bands.get(b + k, set()) for k in range(3)))
            if sum(self.rare[i][2] for i in found) / self.total >= lic.AGREE - 1e-9:
                return True
        return False

    def share(self, text):
        """The greatest share of the rare words' weight near a place where all key phrases stand in order; None without one."""
        best = None
        for p in starts(text, self.keys[0]) if self.may_stand_in(text) else []:
            start = p - self.offsets[0]
            past, good = p + len(self.keys[0]), True
            for key, offset in zip(self.keys[1:], self.offsets[1:], strict=True):
                at = [i for i in starts(text, key) if i >= max(past, start + offset - self.band)]
                if not at or at[0] > start + offset + self.band:
                    good = False
                    break
                past = at[0] + len(key)
            if good:
                found = {i for i, (place, w, _) in enumerate(self.rare) for at in range(max(0, start + place - self.band), min(len(text), start + place + self.band + 1)) if text[at] == w}
                best = max(best or 0.0, sum(self.rare[i][2] for i in found) / self.total)
        return best


def without_markers(text):
    """The words but those that begin a line as the line before or after it begins; None if there are none."""
    lines = [w for line in (text or "").split("\n") if (w := words(line))]
    gone = [i for i in range(len(lines)) if i and lines[i][0] == lines[i - 1][0] or i + 1 < len(lines) and lines[i][0] == lines[i + 1][0]]
    return [w for i, line in enumerate(lines) for w in (line[1:] if i in gone else line)] if gone else None


def verdict(text, templates):
    own, labels, score = words(text), set(), 0.0
    for phrase, label in lic.PHRASES.items():
        if starts(own, words(phrase)):
            labels.add(label)
            score = 0.5
    for read in (own, without_markers(text)):
        for t in templates if read else []:
            s = t.share(read)
            if s is not None and s >= lic.AGREE:
                labels.add(t.label)
                score = max(score, min(1.0, 0.5 + 0.5 * s))
    return ",".join(sorted(labels)), score


def texts(seed):
    r = random.Random(seed)
    out = [None, "", "the mit license", "Apache License; cc by 4.0", "cc by nc", *[t for _, t, _ in lic.TEMPLATES]]
    noise = [w for _, t, _ in lic.TEMPLATES for w in words(t)] + ["foo", "Größe", "x1"]
    for _, text, _ in lic.TEMPLATES * 3:
        w = text.split()
        for _ in range(r.randrange(0, 1 + len(w) // 4)):
            i = r.randrange(len(w))
            kind = r.randrange(3)
            w[i : i + 1] = [w[i], r.choice(noise)] if kind == 0 else [] if kind == 1 else [r.choice(noise)]
            w = w or ["x"]
        step = r.choice([3, 6, 10_000])
        mark = r.choice(["// ", "dnl ", "* ", ""])
        body = "\n".join(mark + " ".join(w[i : i + step]) for i in range(0, len(w), step))
        out.append(" ".join(r.choice(noise) for _ in range(r.randrange(30))) + "\n" + body + "\n" + " ".join(r.choice(noise) for _ in range(r.randrange(30))))
    return out + [" ".join(r.choice(noise) for _ in range(200)) for _ in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_and_scores_equal_the_plain_rule(spark, seed):
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = Counter(w for _, t, _ in lic.TEMPLATES for w in set(words(t)))
    df.update(w for _, t in rows for w in set(words(t)))
    templates = [Template(*t, df, len(rows) + len(lic.TEMPLATES)) for t in lic.TEMPLATES]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in lic.scan_licenses(docs).collect()}
    named = 0
    for i, t in rows:
        labels, score = verdict(t, templates)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), t
        named += score > 0.5
    assert named > 30
