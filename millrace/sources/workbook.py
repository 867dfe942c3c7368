"""Workbooks and other files as tables.

An .xlsx file is a zip of XML parts.  `read_workbooks` parses a file in one task, which holds its
shared strings; `read_large_workbooks` cuts the parts into pieces that many tasks parse, and joins
the strings.  Both give the same rows.  Every cell is a string, as spreadsheets are read here.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import small

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Texts that stand for no value in a spreadsheet.
NOT_AVAILABLE = frozenset(("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))
# Fixed value: a log line that a context block follows.
CONTEXT_HEADER = r"\[context\] query='(.*)' full_context_block=$"
SCHEMA = "source_file string, sheet_name string, ord long, fields array<struct<key:string,value:string>>"


def workbook_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the folder's files named *.xlsx, case-sensitive."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)


def workbook_file(spark: SparkSession, path: str) -> DataFrame:
    """The same columns of one file, whatever its name."""
    return spark.read.format("binaryFile").load(path)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def _cell(c, strings: list[str]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        text = _text(c)
    elif v is None or v.text is None:
        return None
    else:
        text = strings[int(v.text)] if kind == "s" else str(v.text == "1") if kind == "b" else v.text
    return None if text in NOT_AVAILABLE else text


def _header(cells: dict[int, str | None]) -> dict[int, str]:
    """Names of the columns: a blank one is told by its place, a repeated one by a number."""
    out, seen = {}, {}
    for i in range(max(cells, default=-1) + 1):
        name = cells.get(i) or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out[i] = f"{name}.{n}" if n else name
    return out


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[dict]]]:
    """(sheet, ord, fields) of each row under a sheet's header that has a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(_REL)]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            header: dict[int, str] | None = None
            at = 0
            with z.open(path) as part:
                for _, row in ElementTree.iterparse(part):
                    if row.tag != f"{_NS}row":
                        continue
                    cells = {_column(c.get("r")) if c.get("r") else i: _cell(c, strings) for i, c in enumerate(row.iter(f"{_NS}c"))}
                    row.clear()
                    if header is None:
                        header = _header(cells)
                        continue
                    names = header | {i: f"Unnamed: {i}" for i, v in sorted(cells.items()) if i not in header and v is not None}
                    fields = [{"key": name, "value": cells.get(i)} for i, name in names.items()]
                    if any(f["value"] is not None for f in fields):
                        kept = [f for f in fields if f["key"] != "sheet_name"]
                        yield sheet.get("name"), at, [*kept, {"key": "sheet_name", "value": sheet.get("name")}]
                        at += 1


def read_workbooks(files: DataFrame) -> DataFrame:
    """Rows (source_file, sheet_name, ord, fields) of all sheets of binary files."""

    def parse(batches):
        kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = sheet_rows(content.as_py())
                while chunk := [r for r, _ in zip(rows, range(5000), strict=False)]:
                    sheet, order, fields = zip(*chunk, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(chunk)), pa.array(sheet), pa.array(order, pa.int64()), pa.array(fields, kind)], ["source_file", "sheet_name", "ord", "fields"])

    return files.select("path", "content").mapInArrow(parse, SCHEMA)


#: Bytes of XML, or one row, that a task parses at once.
PIECE_BYTES = 4 << 20


def _pieces(stream, tag: bytes, most: int) -> Iterator[bytes]:
    """The XML of a part, cut between the elements `tag` into documents of about `most` bytes; nothing but those elements is kept.

    A part is UTF-8 XML without comments or CDATA around its elements, as spreadsheets write it.
    """
    begin = re.compile(rb"<(?:\w+:)?" + tag + rb"[\s/>]")
    end = re.compile(rb"</(?:\w+:)?" + tag + rb"\s*>|<(?:\w+:)?" + tag + rb"(?:\s[^<>]*)?/>")
    held, root = b"", None
    while True:
        read = stream.read(min(most, 1 << 20))
        held += read
        if root is None and (m := re.search(rb"<([^\s<>?!/]+)[^<>]*>", held)):
            root = m
        if root is not None and (len(held) >= most or not read):
            last = max((m.end() for m in end.finditer(held)), default=0)
            first = begin.search(held)
            if last and first:
                yield root[0] + held[first.start() : last] + b"</" + root[1] + b">"
                held = held[last:]
        if not read:
            return


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def one(path: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if "xl/sharedStrings.xml" in z.namelist():
                with z.open("xl/sharedStrings.xml") as part:
                    for n, xml in enumerate(_pieces(part, b"si", most)):
                        yield path, -1, None, n, xml
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for no, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
                target = targets[sheet.get(_REL)]
                with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                    for n, xml in enumerate(_pieces(part, b"row", most)):
                        yield path, no, sheet.get("name"), n, xml

    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            for row in one(path, content.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["path", "sheet_no", "sheet_name", "piece", "xml"])


def _parse_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, piece, xml in zip(b.column("path").to_pylist(), b.column("piece").to_pylist(), b.column("xml"), strict=True):
            texts = [_text(si) for si in ElementTree.fromstring(xml.as_py()).iter(f"{_NS}si")]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array([piece] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["path", "piece", "i", "string"])


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("col", pa.int32()), ("text", pa.string()), ("string", pa.int64())]))

    def cell(at: int, c) -> dict:
        v = c.find(f"{_NS}v")
        if c.get("t") == "s" and v is not None and v.text is not None:
            return {"col": at, "text": None, "string": int(v.text)}
        return {"col": at, "text": _cell(c, []), "string": None}

    for b in batches:
        heads = list(zip(*[b.column(c).to_pylist() for c in ("path", "sheet_no", "sheet_name", "piece")], strict=True))
        for (path, no, name, piece), xml in zip(heads, b.column("xml"), strict=True):
            rows = [[cell(_column(c.get("r")) if c.get("r") else i, c) for i, c in enumerate(row.iter(f"{_NS}c"))] for row in ElementTree.fromstring(xml.as_py()).iter(f"{_NS}row")]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([no] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array([piece] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(rows, kind)], ["path", "sheet_no", "sheet_name", "piece", "i", "cells"])


def _before(counts: DataFrame, *of: str) -> DataFrame:
    """counts(*of, piece, n) with `base`: the sum of n of the pieces before; a row for each piece."""
    earlier = Window.partitionBy(*of).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")


def read_large_workbooks(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of `read_workbooks`, where one file's sheets are parsed by many tasks.

    One task inflates a file, which can't be split, and cuts its parts between rows and strings; the
    pieces are dealt to all tasks and parsed there.  Shared strings are a table that cells join by
    number, so no task holds a file's strings.  `files` is read twice, for the strings and the rows.
    """
    pieces = files.select("path", "content").mapInArrow(lambda batches: _cut(batches, piece_bytes), "path string, sheet_no int, sheet_name string, piece int, xml binary")
    dealt = pieces.repartition("path", "sheet_no", "piece")
    strings = dealt.where("sheet_no < 0").mapInArrow(_parse_strings, "path string, piece int, i long, string string")
    numbered = strings.join(_before(strings.groupBy("path", "piece").agg(F.count(F.lit(1)).alias("n")), "path"), ["path", "piece"])
    numbered = numbered.select(F.col("path").alias("_path"), (F.col("i") + F.col("base")).alias("_string"), F.col("string").alias("shared"))
    rows = dealt.where("sheet_no >= 0").mapInArrow(_parse_rows, "path string, sheet_no int, sheet_name string, piece int, i long, cells array<struct<col:int,text:string,string:long>>")
    row = ["path", "sheet_no", "sheet_name", "piece", "i"]
    cells = rows.select(*row, F.posexplode_outer("cells").alias("nth", "c")).select(*row, "nth", "c.*")
    told = cells.join(numbered, (F.col("path") == F.col("_path")) & (F.col("string") == F.col("_string")), "left").withColumn("text", F.coalesce("text", "shared"))
    value = F.when(~F.col("text").isin(*sorted(NOT_AVAILABLE)), F.col("text"))
    whole = told.groupBy(*row).agg(F.sort_array(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "nth", value.alias("text"))))).alias("cells"))
    # of two cells of one column the last counts
    at = lambda cells, i: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(cells, lambda c: c["col"] == i), lambda c: c["text"])), -1)
    blank = lambda i: F.concat(F.lit("Unnamed: "), i.cast("string"))
    is_header = (F.col("piece") == 0) & (F.col("i") == 0)
    last = F.coalesce(F.array_max(F.transform("cells", lambda c: c["col"])), F.lit(-1))
    columns = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    header = whole.where(is_header).select("path", "sheet_no", F.transform(columns, lambda i: F.coalesce(at(F.col("cells"), i), blank(i))).alias("h"))
    again = lambda n, i: F.size(F.filter(F.slice("h", 1, i), lambda x: x == n))
    header = header.select("path", "sheet_no", F.transform("h", lambda n, i: F.when(again(n, i) > 0, F.concat(n, F.lit("."), again(n, i).cast("string"))).otherwise(n)).alias("names"))
    x = whole.where(~is_header).join(small(header), ["path", "sheet_no"])
    known = F.transform("names", lambda n, i: F.struct(n.alias("key"), at(F.col("cells"), i).alias("value")))
    beyond = F.array_sort(F.array_distinct(F.transform(F.filter("cells", lambda c: (c["col"] >= F.size("names")) & c["text"].isNotNull()), lambda c: c["col"])))
    fields = F.concat(known, F.transform(beyond, lambda i: F.struct(blank(i).alias("key"), at(F.col("cells"), i).alias("value"))))
    x = x.withColumn("fields", fields).where(F.exists("fields", lambda f: f["value"].isNotNull()))
    kept = F.concat(F.filter("fields", lambda f: f["key"] != "sheet_name"), F.array(F.struct(F.lit("sheet_name").alias("key"), F.col("sheet_name").alias("value"))))
    sheet = ["path", "sheet_no"]
    counts = _before(x.groupBy(*sheet, "piece").agg(F.count(F.lit(1)).alias("n")), *sheet)
    nth = F.row_number().over(Window.partitionBy(*sheet, "piece").orderBy("i")) - 1
    out = x.withColumn("nth", nth).join(counts, [*sheet, "piece"])
    return out.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "sheet_name", (F.col("nth") + F.col("base")).cast("long").alias("ord"), kept.alias("fields"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; keep a field that is an object or a list as string."""
    return spark.read.schema(schema).json(path)


def context_blocks(lines: DataFrame) -> DataFrame:
    """(file, query, seq, block): the lines after a context header, up to the next timestamp.

    lines(file, line_no, text).  Block numbers are running counts inside a file.
    """
    header = F.col("text").rlike(CONTEXT_HEADER)
    stamped = F.col("text").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} ")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("seq", F.sum(F.when(header | stamped, 1).otherwise(0)).over(order))
    inside = Window.partitionBy("file", "seq")
    x = x.withColumn("query", F.max(F.when(header, F.regexp_extract("text", CONTEXT_HEADER, 1))).over(inside)).where(F.col("query").isNotNull())
    body = F.transform(F.sort_array(F.collect_list(F.when(~header, F.struct("line_no", "text")))), lambda r: r["text"])
    return x.groupBy("file", "seq", "query").agg(F.array_join(body, "\n").alias("block"))
