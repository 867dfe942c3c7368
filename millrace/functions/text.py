"""Text functions as Columns: chunk texts, tokens, clauses, numbers, fenced JSON and ids.

Fields are `array<struct<key:string,value:string>>`: maps give no order, and order decides here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that tokens drop, letters that fold, prefixes that come off, in order.
TOKEN_PUNCTUATION = r"""[؟،؛!.,()\[\]{}"'/\\-]"""
HAMZA_ALIFS, ALIF = "أإآ", "ا"
ATTACHED_PREFIXES = ("بال", "وال", "فال", "كال", "لل", "ال", "و", "ف", "ب", "ل", "ك")
TATWEEL = "ـ"
STOP_WORDS = ("في", "من", "على", "الى", "إلى", "عن", "مع", "أو", "او", "و", "ال", "هل", "لا", "غير", "متاح", "متاحة", "بتاعه", "بتاعت")
NUMBER = r"(?U)\d+(?:[:.,]\d+)*"
FENCED_JSON = r"(?s)```json\s*(.*?)\s*```"

FIELDS = "array<struct<key:string,value:string>>"


def stripped(x: Column | str) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapsed(x: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.btrim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def display(x: Column) -> Column:
    """Collapsed and lower-cased, as names are compared."""
    return F.lower(collapsed(x))


def without_tatweel(x: Column) -> Column:
    return F.translate(x, TATWEEL, "")


def file_stem(name: Column) -> Column:
    """File name without folders and its last extension."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)


def chunk_text(fields: Column, source_file: Column) -> Column:
    """`[Document: stem] label: value. label2: value2`."""
    body = F.array_join(F.transform(fields, lambda f: F.concat(f["key"], F.lit(": "), f["value"])), ". ")
    return F.concat(F.lit("[Document: "), file_stem(source_file), F.lit("] "), body)


def parse_chunk(text: Column) -> Column:
    """Fields of a chunk text; parts without `: ` or with a blank side are dropped."""
    parts = F.split(F.regexp_replace(text, r"^\[Document:[^\]]*\]\s*", ""), r"\. ")
    pair = lambda p: F.struct(stripped(F.substring_index(p, ": ", 1)).alias("key"), stripped(F.substr(p, F.instr(p, ": ") + 2)).alias("value"))
    return F.filter(F.transform(F.filter(parts, lambda p: F.instr(p, ": ") > 0), pair), lambda f: (f["key"] != "") & (f["value"] != ""))


def unprefixed(token: Column) -> Column:
    """A token without the first attached prefix that leaves two characters or more."""
    out = F.when(F.lit(False), token)
    for p in ATTACHED_PREFIXES:
        out = out.when(token.startswith(p) & (F.length(token) > len(p) + 1), F.substr(token, F.lit(len(p) + 1)))
    return out.otherwise(token)


def tokens(x: Column) -> Column:
    """Set of comparison tokens of a text."""
    clean = F.translate(F.regexp_replace(x, TOKEN_PUNCTUATION, " "), HAMZA_ALIFS, ALIF * len(HAMZA_ALIFS))
    bare = F.transform(F.split(display(clean), " "), unprefixed)
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 2) | t.rlike(r"(?U)^\d+$")))


def significant_tokens(x: Column) -> Column:
    """Letter runs of three or more, without stop words."""
    runs = F.regexp_extract_all(without_tatweel(F.coalesce(x, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def first_difference(a: Column, b: Column) -> Column:
    """Place, from 1, of the first tokens that differ; 0 if none do."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)


def common_prefix(lists: Column) -> Column:
    """Leading tokens that all lists share; none if a list is empty."""

    def shared(a: Column, b: Column) -> Column:
        differs = first_difference(a, b)
        return F.slice(a, 1, F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int"))

    return F.aggregate(lists, F.get(lists, 0), shared)


def numbers(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(NUMBER), F.lit(0))


def reply_clauses(x: Column) -> Column:
    """Clauses of a reply: lines without list markers, cut after sentence marks and commas; no questions."""
    lines = F.split(x, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    cut = F.flatten(F.transform(lines, lambda s: F.split(F.regexp_replace(s, r"(?U)^\s*\d+[-.\)]\s+", ""), r"(?U)(?<=[.!؟?,،])\s+")))
    return _statements(cut)


def sentences(x: Column) -> Column:
    """Sentences of a training text, without questions."""
    return _statements(F.split(x, r"(?U)(?<=[.!؟?])\s+"))


def _statements(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: (s != "") & ~s.endswith("؟") & ~s.endswith("?"))


def contains_any(x: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(x, m))


def first_field(fields: Column, prefix: str) -> Column:
    """Collapsed value of the first field whose label starts with the prefix and whose value isn't blank."""
    found = F.filter(fields, lambda f: stripped(without_tatweel(f["key"])).startswith(prefix) & (stripped(f["value"]) != ""))
    return collapsed(F.get(found, 0)["value"])


def clarification(category: Column, options: Column) -> Column:
    """The question that offers the options of an ambiguous name."""
    lines = F.transform(options, lambda o: F.concat(F.lit("- "), o))
    return F.concat_ws("\n", F.concat(F.lit("متاح لدينا أكتر من نوع من "), category, F.lit("، منها:")), F.array_join(lines, "\n"), F.lit("تحب أي نوع فيهم؟"))


def substituted(template: Column, values: dict[str, Column]) -> Column:
    """`{name}` in a template replaced by the named columns."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def history_text(turns: Column, last: int = 6) -> Column:
    """The last turns as `role: content` lines; turns are array<struct<role,content>>."""
    tail = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), last)
    return F.array_join(F.transform(tail, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def truncated(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("…")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-<first 20 hex digits of SHA-1 of the parts joined by |>."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20))


# --- JSON in replies -------------------------------------------------------------------------


def fenced_json(x: Column) -> Column:
    """The text of the first fenced JSON block; null if there is none or it doesn't parse."""
    block = F.when(x.rlike(FENCED_JSON), F.regexp_extract(x, FENCED_JSON, 1))
    return F.when(parsed(block).isNotNull(), block)


def phrasing(x: Column) -> Column:
    """What follows the first fenced block, or all of it."""
    after = F.regexp_extract(x, r"(?s)```json\s*.*?\s*```(.*)", 1)
    return F.regexp_replace(F.when(x.rlike(FENCED_JSON), after).otherwise(x), r"(?U)^\s+|\s+$", "")


def section(x: Column, heading: str) -> Column:
    """Text from `## HEADING:` to the next such heading."""
    return stripped(F.regexp_extract(x, rf"(?s)## {heading}:\s*(.*?)\s*(?=## [A-Z ]+:|\z)", 1))


def last_object(x: Column) -> Column:
    """The last flat {...} of a text as map<string,string>; null if none parses."""
    return F.from_json(F.try_element_at(F.regexp_extract_all(x, F.lit(r"\{[^{}]*\}"), F.lit(0)), F.lit(-1)), "map<string,string>")


ENTRIES = "array<struct<source:int,fields:map<string,string>>>"


def parsed(json: Column) -> Column:
    """The value of a JSON text; null unless it's all of the text.

    Spark's parser takes a value for the whole of a text that goes on behind it.  What goes on
    can't end both an array and an object, so the text must parse inside either.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("}"))).isNotNull()
    return F.when(inside, F.try_parse_json(json))


def is_object(json: Column) -> Column:
    return F.coalesce(stripped(json).startswith("{"), F.lit(False)) & parsed(json).isNotNull()


def is_list(json: Column) -> Column:
    return F.coalesce(stripped(json).startswith("["), F.lit(False)) & parsed(json).isNotNull()


def json_values(json: Column) -> Column:
    """All values of an object, or of the `fields` of a list of sources, joined by spaces."""
    flat = F.array_join(F.map_values(F.from_json(json, "map<string,string>")), " ")
    nested = F.array_join(F.flatten(F.transform(F.from_json(json, ENTRIES), lambda e: F.coalesce(F.map_values(e["fields"]), F.array().cast("array<string>")))), " ")
    return F.when(is_list(json), nested).when(is_object(json), flat).otherwise("")


def flattened(json: Column) -> Column:
    """One map of a list of sources' fields; later sources win."""
    entries = F.flatten(F.transform(F.from_json(json, ENTRIES), lambda e: F.map_entries(e["fields"])))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.when(is_list(json), F.map_from_entries(last)).otherwise(F.from_json(json, "map<string,string>"))


def json_is_empty(json: Column) -> Column:
    """{} and lists whose entries have no fields are empty; null is not."""
    nothing = F.forall(F.from_json(json, ENTRIES), lambda e: F.coalesce(F.size(e["fields"]) <= 0, F.lit(True)))
    return F.when(json.isNull(), False).when(is_object(json), F.size(F.from_json(json, "map<string,string>")) == 0).when(is_list(json), nothing).otherwise(False)


def canonical_json(json: Column) -> Column:
    """Key order doesn't matter at any depth: a variant's objects are sorted by key; other text stays as it is."""
    return F.coalesce(F.to_json(parsed(json)), json)


def first_json(x: Column) -> Column:
    """struct<json, end> of the first fenced block, else of the first balanced bracket; null if none parses.

    `end` is the place behind it, from 0.  Only the first bracket's kind is counted, outside strings.
    """

    @F.pandas_udf("struct<json:string,end:int>")
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_first_json(t) for t in texts], columns=["json", "end"]).astype({"end": "Int32"})

    found = find(x)
    return F.when(parsed(found["json"]).isNotNull(), found)


def _first_json(text: str | None) -> tuple[str | None, int | None]:
    if text is None:
        return None, None
    begin = text.find("```json")
    if begin >= 0 and (close := text.find("```", begin + 7)) >= 0:
        return text[begin + 7 : close].strip(), close + 3
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None, None
    opening, closing = text[at], "}" if text[at] == "{" else "]"
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in (opening, closing):
            depth += 1 if c == opening else -1
            if not depth:
                return text[at : i + 1], i + 1
    return None, None
