import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veriloom.sources import files, sinks
from veriloom.streaming import jobs as streams

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="表1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>地区</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" s="1"><v>0.5</v></c></row><row r="2"><c r="B2"><f>SUM(B1:B1)</f></c></row></sheetData><autoFilter ref="broken"/></worksheet>')
    return out.getvalue()


def test_registry_and_cells(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.xlsx").write_bytes(workbook())
    (root / "copy.xlsx").write_bytes(workbook())
    (root / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (root / "fake.docx").write_bytes(b"no")
    (root / "~$t.xlsx").write_bytes(b"no")
    (root / "c.txt").write_bytes(b"no")
    f = files.discover(spark, str(root))
    r = {x["name"]: x for x in files.register(f, "kb").collect()}
    assert set(r) == {"a.xlsx", "copy.xlsx", "b.pdf", "fake.docx"}
    assert r["a.xlsx"]["source_id"] == r["copy.xlsx"]["source_id"] and r["a.xlsx"]["format_ok"] and r["b.pdf"]["format_ok"] and not r["fake.docx"]["format_ok"]
    assert files.first_per_format(f, 1).filter("suffix = 'xlsx'").count() == 1
    c = {(x["row"], x["col"]): x for x in files.cells(f.filter("name = 'a.xlsx'")).collect()}
    assert c[1, 1]["value"] == "地区" and c[1, 28]["format"] == "0.00%" and c[2, 2]["value"] is None and c[2, 2]["formula"] == "=SUM(B1:B1)"
    bad = files.cells(f.filter("name = 'fake.docx'")).collect()
    assert len(bad) == 1 and bad[0]["error"]
    before = spark.createDataFrame(files.register(f, "kb").select("path", "length", "source_sha256").collect())
    (root / "b.pdf").write_bytes(b"%PDF-1.7 y")
    assert [x["problem"] for x in files.changed_sources(before, files.register(files.discover(spark, str(root)), "kb")).collect()] == ["changed"]
    assert sinks.inventory(spark, str(root)).count() == 6


def test_lines_lexicon_and_sinks(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.json_lines(spark, str(p), "a int").agg(F.sum("a")).first()[0] == 3
    lex = tmp_path / "lex.txt"
    lex.write_text("b\na\n\nb\n")
    assert [r["term"] for r in files.lexicon(spark, str(lex)).orderBy("idx").collect()] == ["b", "a"]
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    sinks.write_facts(df, str(tmp_path / "facts"))
    with pytest.raises(Exception):
        sinks.write_facts(df, str(tmp_path / "facts"))
    assert sinks.new_rows(df, spark.createDataFrame([(2,)], "id int"), ["id"]).count() == 1
    pointer = str(tmp_path / "current.json")
    sinks.activate(pointer, "v2", {"smoke": True})
    assert sinks.current(pointer) == "v2" and json.load(open(pointer))
    with pytest.raises(ValueError):
        sinks.activate(pointer, "v3", {"smoke": False})
    assert "| 2 | b |" in sinks.markdown(df.filter("id = 2"), "t")


def test_streams(spark, tmp_path):
    schema = "job_id string, file_id string, seq int, stage string, status string"
    spark.createDataFrame([("j", "a", 1, "parsed", "running"), ("j", "a", 2, "published", "completed"), ("j", "a", 3, "parsed", "failed"), ("j", "b", 4, "chunked", "running")], schema).write.parquet(str(tmp_path / "ev"))
    q = streams.file_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["file_id"], r["status"], r["stage"]) for r in spark.sql("select * from states").collect()} == {("a", "completed", "published"), ("b", "running", "chunked")}


def test_index_build_resumes(spark, tmp_path):
    src, to, cp = (str(tmp_path / x) for x in ("chunks", "index", "cp"))
    make = lambda b: b.withColumn("n", F.length("t"))
    stream = lambda: spark.readStream.schema("t string").parquet(src)
    spark.createDataFrame([("a",), ("bb",)], "t string").write.parquet(src)
    streams.build_index(stream(), to, cp, make)
    spark.createDataFrame([("ccc",)], "t string").write.mode("append").parquet(src)
    streams.build_index(stream(), to, cp, make)
    assert sorted(r["n"] for r in spark.read.parquet(to).collect()) == [1, 2, 3]
