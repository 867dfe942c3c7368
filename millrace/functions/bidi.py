"""Cleaning of mixed right-to-left and Latin replies.

Small scanners over a reply's characters, each in one vectorised UDF; replies are short.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Isolate, pop and right-to-left marks; what a Latin run begins with, holds and ends with;
# marks that follow a closing bracket without a space.
LRI, PDI, RLM = "\u2066", "\u2069", "\u200f"
ALNUM = frozenset(string.ascii_letters + string.digits)
RUN_FIRST, RUN_INSIDE, RUN_LAST = ALNUM | {"("}, ALNUM | set(" -/().&%:+"), ALNUM | set("%)")
AFTER_BRACKET = frozenset(").,،؛:؟!-")


def _past_space(s: str, i: int) -> int:
    while i < len(s) and s[i].isspace():
        i += 1
    return i


def _without_outer(s: str) -> str:
    """No opening bracket whose next brackets are a whole pair."""
    at = [i for i, c in enumerate(s) if c in "()"]
    gone, k = set(), 0
    while k + 2 < len(at):
        if s[at[k]] == s[at[k + 1]] == "(" and s[at[k + 2]] == ")":
            gone.add(at[k])
            k += 3
        else:
            k += 1
    return "".join(c for i, c in enumerate(s) if i not in gone)


def _single_brackets(s: str) -> str:
    """One bracket for two or more of a kind, spaces between them included."""
    out, i = [], 0
    while i < len(s):
        c, j = s[i], i + 1
        if c in "()":
            run = j
            while c == ")" and run < len(s) and s[run] == c:
                run += 1
            k = _past_space(s, run)
            if k < len(s) and s[k] == c:
                j = k + 1
                while c == "(" and j < len(s) and s[j] == c:
                    j += 1
            else:
                j = run
        out.append(c)
        i = j
    return "".join(out)


def _spaced_brackets(s: str) -> str:
    """Spaces outside brackets and none inside, nor a dash that only leads or trails there."""
    out: list[str] = []

    def drop_space() -> bool:
        n = len(out)
        while out and out[-1].isspace():
            out.pop()
        return len(out) < n

    i = 0
    while i < len(s):
        c = s[i]
        i += 1
        if c == "(":
            if out and not out[-1].isspace() and out[-1] != "(":
                out.append(" ")
            out.append(c)
            i = _past_space(s, i)
            if s[i : i + 1] == "-" and s[i + 1 : i + 2].isspace():
                i = _past_space(s, i + 1)
        elif c == ")":
            drop_space()
            if len(out) > 1 and out[-1] == "-" and out[-2].isspace():
                out.pop()
                drop_space()
            out.append(c)
            if i < len(s) and not s[i].isspace() and s[i] not in AFTER_BRACKET:
                out.append(" ")
        else:
            out.append(c)
    return "".join(out)


def _punctuated(s: str) -> str:
    s = "\n".join(line[1:].lstrip() if line.startswith(":") else line for line in s.split("\n"))
    s = _spaced_brackets(_single_brackets(_without_outer(s))).strip()
    if s[:1] == "-" and s[1:2].isspace():
        s = s[1:].lstrip()
    if s[-1:] == "-" and s[-2:-1].isspace():
        s = s[:-1].rstrip()
    return "".join(" " if c in " \t" else c for i, c in enumerate(s) if not (c in " \t" and i and s[i - 1] in " \t"))


def _isolated(s: str) -> str:
    """Latin runs between an isolate and a pop mark."""
    s = "".join(c for c in s if c not in (LRI, PDI))
    out, i = [], 0
    while i < len(s):
        if s[i] not in RUN_FIRST:
            out.append(s[i])
            i += 1
            continue
        end = i + 1
        while end < len(s) and s[end] in RUN_INSIDE:
            end += 1
        while end > i + 1 and s[end - 1] not in RUN_LAST:
            end -= 1
        out.append(f"{LRI}{s[i:end]}{PDI}")
        i = end
    return "".join(out)


@F.pandas_udf(StringType())
def normalize_punctuation(x: pd.Series) -> pd.Series:
    return x.map(_punctuated, na_action="ignore")


@F.pandas_udf(StringType())
def isolate_latin(x: pd.Series) -> pd.Series:
    return x.map(_isolated, na_action="ignore")


def paragraph_spacing(x: Column) -> Column:
    """A blank line after each sentence of a text that is one line."""
    return F.when(F.contains(x, F.lit("\n")), x).otherwise(F.regexp_replace(x, r"(?U)([.؟!])[ \t]+(?=\S)", "$1\n\n"))


def _side(ch: str) -> str:
    kind = unicodedata.bidirectional(ch) if ch else ""
    return "R" if kind in ("AL", "R") else "L" if kind in ("L", "EN") else ""


def _anchors(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return not ch.isspace() and kind not in ("Ps", "Pe") and (kind[0] == "P" or unicodedata.bidirectional(ch) in ("ON", "CS", "ES", "ET"))


def _anchored(s: str) -> str:
    """Runs of punctuation that touch a right-to-left letter, between right-to-left marks."""
    s = "".join(c for c in s if c not in (LRI, PDI, RLM))
    runs: list[list[str]] = []
    for c in s:
        if runs and _anchors(c) and _anchors(runs[-1][-1]):
            runs[-1].append(c)
        else:
            runs.append([c])
    near = lambda i: 0 <= i < len(runs) and _side(runs[i][-1 if i < k else 0]) == "R"
    out = []
    for k, run in enumerate(runs):
        text = "".join(run)
        out.append(RLM + text + RLM if _anchors(run[0]) and (near(k - 1) or near(k + 1)) else text)
    return "".join(out)


def _spaced(s: str) -> str:
    """A space wherever the script changes direction without one."""
    return "".join((" " if i and {_side(s[i - 1]), _side(c)} == {"L", "R"} else "") + c for i, c in enumerate(s))


@F.pandas_udf(StringType())
def anchor_punctuation(x: pd.Series) -> pd.Series:
    return x.map(_anchored, na_action="ignore")


@F.pandas_udf(StringType())
def script_spacing(x: pd.Series) -> pd.Series:
    return x.map(_spaced, na_action="ignore")


def sanitize(x: Column) -> Column:
    """All rewrites in their order."""
    return isolate_latin(paragraph_spacing(script_spacing(anchor_punctuation(normalize_punctuation(x)))))
