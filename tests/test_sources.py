"""Workbooks read by many tasks against the reader of one task, and mirroring into a versioned store."""

from __future__ import annotations

import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from millrace.operators import ingest
from millrace.sources import listing, sinks, versions, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
FIELDS = "array<struct<key:string,value:string>>"


def letters(i: int) -> str:
    return chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)


def write(path, sheets: dict[str, list[list]], prefix: str = "", seed: int = 0) -> None:
    """A workbook whose texts are shared strings, inline strings or numbers; some cells have no reference."""
    r, strings = random.Random(seed), []
    p = f"{prefix}:" if prefix else ""
    ns = NS.replace("xmlns=", f"xmlns:{prefix}=") if prefix else NS

    def cell(value, i, at):
        ref = f' r="{letters(i)}{at}"'
        if value is None:
            return r.choice(["", f"<{p}c{ref}/>"])
        if value is True:
            return f'<{p}c{ref} t="b"><{p}v>1</{p}v></{p}c>'
        if isinstance(value, int):
            return f"<{p}c{ref}><{p}v>{value}</{p}v></{p}c>"
        if r.random() < 0.3:
            return f'<{p}c{ref} t="inlineStr"><{p}is><{p}t>{escape(value)}</{p}t></{p}is></{p}c>'
        strings.append(value)
        return f'<{p}c{ref} t="s"><{p}v>{len(strings) - 1}</{p}v></{p}c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<{p}sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<{p}workbook {ns}><{p}sheets>{names}</{p}sheets></{p}workbook>")
        links = "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<{p}row r="{n + 1}">' + "".join(cell(v, c, n + 1) for c, v in enumerate(row)) + f"</{p}row>" if row else f'<{p}row r="{n + 1}"/>' for n, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<{p}worksheet {ns}><{p}sheetViews/><{p}sheetData>{body}</{p}sheetData><{p}rowBreaks count="0"/></{p}worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0"?><{p}sst {ns}>' + "".join(f"<{p}si><{p}t>{escape(s)}</{p}t></{p}si>" for s in strings) + f"</{p}sst>")


def sheet(seed: int, n: int) -> list[list]:
    r = random.Random(seed)
    value = lambda: r.choice([None, "NA", "é <&> \n x", "yes", f"t{r.randrange(50)}", r.randrange(9), True, ""])
    return [["name", None, "name", "sheet_name", "size"], *[[value() for _ in range(r.choice([0, 3, 5, 7]))] for _ in range(n)]]


def rows(frame):
    return sorted((r["source_file"], r["sheet_name"], r["ord"], tuple((f["key"], f["value"]) for f in r["fields"])) for r in frame.collect())


@pytest.mark.parametrize("piece", [200, 5000, workbook.PIECE_BYTES])
def test_pieces_give_the_rows_of_whole_files(spark, tmp_path, piece):
    write(tmp_path / "a.xlsx", {"S": sheet(1, 60), "T": sheet(2, 5), "Empty": [], "Head": [["only"]]})
    write(tmp_path / "b.xlsx", {"S": sheet(3, 40)}, prefix="x", seed=4)
    write(tmp_path / "c.xlsx", {"N": [["k"], [1], [2]]})
    files = workbook.workbook_files(spark, str(tmp_path))
    want = rows(workbook.read_workbooks(files))
    assert len(want) > 70 and rows(workbook.read_large_workbooks(files, piece)) == want


def test_one_file_is_parsed_by_several_tasks(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"S": sheet(1, 3000)})
    files = workbook.workbook_files(spark, str(tmp_path))
    pieces = files.select("path", "content").mapInArrow(lambda b: workbook._cut(b, 20_000), "path string, sheet_no int, sheet_name string, piece int, xml binary")
    tasks = pieces.repartition(4, "path", "sheet_no", "piece").selectExpr("spark_partition_id() AS t", "length(xml) AS n").where("n > 0")
    assert tasks.select("t").distinct().count() == 4 and tasks.selectExpr("max(n)").first()[0] < 45_000
    assert rows(workbook.read_large_workbooks(files, 20_000)) == rows(workbook.read_workbooks(files))


def test_mirror_commits_staging_and_chunks_at_once(spark, tmp_path):
    staged = f"client_id string, source_file string, sheet_name string, ord long, fields {FIELDS}"
    cell = lambda k, v: [{"key": k, "value": v}]
    new = spark.createDataFrame([("c", "new.xlsx", "S", 1, cell("a", "1")), ("c", "bad.xlsx", "T", 1, cell("a", "2"))], staged)
    old = spark.createDataFrame([("c", "new.xlsx", "S", 9, cell("a", "0")), ("c", "bad.xlsx", "T", 9, cell("b", "0")), ("c", "gone.xlsx", "S", 9, cell("a", "0"))], staged)
    registry = spark.createDataFrame([("c", "T", ["b"], ["b"])], "client_id string, sheet_name string, columns array<string>, mandatory_fields array<string>")
    config = spark.createDataFrame([("c", {"x": "X"})], "client_id string, brand_value_aliases map<string,string>")
    listed = spark.createDataFrame([("c", "new.xlsx"), ("c", "bad.xlsx")], "client_id string, source_file string")
    chunks = ingest.chunk_rows(old, registry, config)
    for ok in (True, False):
        store = versions.Store(spark, f"{tmp_path}/{ok}")
        store.commit({"staging": old, "chunks": chunks})
        first = store.manifest()
        rejected = ingest.mirror_into(store, new, listed, registry, config, ok, ("sync", 0))
        want = ingest.mirror_sync(new, listed, old, chunks, registry, config, ok)
        for name, table in zip(("staging", "chunks"), want, strict=False):
            assert sorted(map(str, store.read(name).collect())) == sorted(map(str, table.select(store.read(name).columns).collect()))
        assert rejected.collect() == want[2].collect() and store.read("staging", first).count() == 3
        ingest.mirror_into(store, new, listed, registry, config, ok, ("sync", 0))  # delivered again
        assert store.versions() == [1, 2]


def test_listings_of_many_pages(spark, tmp_path):
    """Pages in, files out; folders, other names and a failing tenant don't count."""
    write(tmp_path / "a.xlsx", {"S": [["k"], ["v"]]})
    content = (tmp_path / "a.xlsx").read_bytes()
    file = lambda i, n: {"id": i, "name": n, "file": {}}
    pages = {
        "b/drives/d/items/f/children": {"value": [file("1", "a.xlsx"), {"id": "2", "name": "sub.xlsx", "folder": {}}], "@odata.nextLink": "b/page2"},
        "b/page2": {"value": [file("3", "B.XLSX"), file("4", "c.xlsx"), {"id": "5"}], "@odata.nextLink": "b/page3"},
        "b/page3": {"value": []},
        "b/drives/e/items/g/children": {"value": [file("6", "e.xlsx")], "@odata.nextLink": "b/drives/e/items/g/children"},
    }

    def get(client, url):
        import json

        if url.endswith("/content"):
            return content
        return json.dumps(pages[url]).encode()

    listed = listing.listed_files(spark, [("c0", "d", "f"), ("c1", "x", "y"), ("c2", "e", "g")], "b", get)
    found = {(r["client_id"], r["item_id"], r["name"]) for r in listed.collect() if not r["error"]}
    assert found == {("c0", "1", "a.xlsx"), ("c0", "4", "c.xlsx"), ("c2", "6", "e.xlsx")}
    assert sorted((r["client_id"], r["error"][:23]) for r in listed.collect() if r["error"]) == [("c1", "KeyError: 'b/drives/x/i"), ("c2", "ValueError: the listing")]
    assert {tuple(r) for r in listing.complete(listed).collect()} == {("c0", "a.xlsx"), ("c0", "c.xlsx")}
    files = listing.fetched(listed.where("client_id = 'c0'"), "b", get, 4)
    assert [(r["source_file"], r["fields"][0]["value"]) for r in workbook.read_workbooks(files).orderBy("source_file").collect()] == [("a.xlsx", "v"), ("c.xlsx", "v")]
    assert listing.listed_files(spark, [], "b", get).count() == 0


def test_judged_records_go_to_two_folders(spark, tmp_path):
    judged = spark.createDataFrame([(1, True, None, None), (2, False, "invented_key", "grounding")], "id int, accepted boolean, rejection_reason string, rejection_stage string")
    for _ in range(2):
        sinks.write_judged(judged, str(tmp_path))
    assert [r.asDict() for r in spark.read.json(f"{tmp_path}/accepted").collect()] == [{"id": 1}]
    assert [r.asDict() for r in spark.read.json(f"{tmp_path}/rejected").collect()] == [{"id": 2, "rejection_reason": "invented_key", "rejection_stage": "grounding"}]
