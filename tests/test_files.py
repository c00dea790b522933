from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.catalog import load_types
from foliary.functions.encode import tagged_json
from foliary.schema import field
from foliary.sinks import files as sinks
from foliary.sources import files as sources

SHAPE = T.StructType([field("a", required=True), field("n", "bigint")])


@pytest.fixture
def folder(tmp_path):
    for name, text in {"x.PDF": b"%PDF-1", "y.txt": b"plain", "sub/z.md": b"deep", "sub/skip.docx": b"no", ".txt": b"hidden"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text)
    return tmp_path


def names(frame):
    return sorted(r.path.rsplit("/", 1)[-1] for r in frame.select("path").collect())


def test_scan(spark, folder):
    assert names(sources.scan_documents(spark, str(folder))) == ["x.PDF", "y.txt"]
    assert names(sources.scan_documents(spark, str(folder), recurse=True)) == ["x.PDF", "y.txt", "z.md"]


def test_flat_scan_beside_folders_that_look_like_partitions(spark, tmp_path):
    (tmp_path / "k=v" / "w").mkdir(parents=True)
    (tmp_path / "a b.txt").write_text("top")
    (tmp_path / "k=v" / "b.txt").write_text("deep")
    (tmp_path / "k=v" / "w" / "c.txt").write_text("deeper")
    assert names(sources.scan_documents(spark, str(tmp_path))) == ["a b.txt"]
    assert names(sources.scan_documents(spark, str(tmp_path), recurse=True)) == ["a b.txt", "b.txt", "c.txt"]


def test_odd_file_names(spark, tmp_path):
    for name in ("a b.csv", "c[1].csv", "d%20e.csv", "ü+.csv"):
        (tmp_path / name).write_text(f"id,nöte\n1,é {name[0]}\n", encoding="utf-8")
    (tmp_path / "old.csv").write_bytes("id,nöte\n2,“é”\n".encode("cp1252"))
    rows = sources.read_text_table(spark, str(tmp_path), "id int, note string")
    assert sorted(r.note for r in rows.collect()) == ["é a", "é c", "é d", "é ü", "“é”"]
    for name in ("x y.json", "p%20q+[1].json", "ß.json"):
        (tmp_path / name).write_text("{}")
    assert names(sources.read_records(spark, str(tmp_path))) == ["p%20q+[1].json", "x y.json", "ß.json"]


def test_replacement_characters_and_fractions_stay(spark):
    from foliary.functions.encode import cell
    from foliary.functions.text import decoded

    rows = spark.createDataFrame([(b"a\xef\xbf\xbdb",), (b"\xffa\xef\xbf\xbdb\xc3",), (b"plain",), (b"\xe2\x82",)], "c binary")
    assert [r[0] for r in rows.select(decoded(F.col("c"))).collect()] == ["a\ufffdb", "a\ufffdb", "plain", ""]
    shape = T.StructType.fromDDL("t timestamp, n struct<at: timestamp_ntz, days: array<date>>")
    one = spark.sql("SELECT timestamp'2024-01-02 10:00:00.123456' t, named_struct('at', timestamp_ntz'2024-01-02 10:00:00', 'days', array(date'2024-01-03')) n")
    text = one.select(tagged_json(F.lit("k"), F.struct("t", "n"), shape)).first()[0]
    assert json.loads(text) == {"record_type": "k", "t": "2024-01-02T10:00:00.123456", "n": {"at": "2024-01-02T10:00:00", "days": ["2024-01-03"]}}
    assert spark.sql("SELECT 12345678.5D d").select(cell(F.col("d"), T.DoubleType())).first()[0] == "12345678.5"


def test_scan_without_content_reads_none(spark, folder):
    plan = sources.scan_or_failure(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_empty_folder_is_one_failure(spark, tmp_path):
    (tmp_path / "only.docx").write_text("x")
    rows = sources.scan_or_failure(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].status == "failed" and "No supported input files" in rows[0].error_message


def test_table_in_two_encodings(spark, tmp_path):
    (tmp_path / "new.csv").write_text('id,note\n1,"é – ""quoted""\nline"\n', encoding="utf-8")
    (tmp_path / "old.csv").write_bytes("id,note\n2,“caf” – €\n3,\n".encode("cp1252"))
    rows = {r.id: r.note for r in sources.read_text_table(spark, str(tmp_path), "id int, note string").collect()}
    assert rows == {1: 'é – "quoted"\nline', 2: "“caf” – €", 3: None}


def test_records_round_trip_and_bad_files_stay(spark, tmp_path):
    rows = spark.createDataFrame([("r/1", "x", 1), ("2", "y", None)], "path string, a string, n bigint")
    made = rows.select(
        sinks.json_target(F.col("path"), F.lit("t")).alias("out_path"),
        tagged_json(F.lit("t"), F.struct("a", "n"), SHAPE).alias("content"),
    )
    sinks.write_files(made, str(tmp_path))
    sinks.write_files(made, str(tmp_path))
    assert json.loads((tmp_path / "r" / "1_t.json").read_text()) == {"record_type": "t", "a": "x", "n": 1}
    (tmp_path / "bad.json").write_text("{")
    read = sources.parsed_records(sources.read_records(spark, str(tmp_path), recurse=True), SHAPE)
    got = {r.path.rsplit("/", 1)[-1]: (r.record.a if r.record else None, len(r.errors)) for r in read.collect()}
    assert got == {"1_t.json": ("x", 0), "2_t.json": ("y", 0), "bad.json": (None, 1)}
    assert not list(tmp_path.rglob("*.part"))


def test_package_copies_bytes(spark, folder, tmp_path):
    scan = sources.scan_documents(spark, str(folder), recurse=True)
    rows = scan.select("path")
    made = sinks.package_manifest(rows, F.array(F.lit("Agreement"), F.lit("Terms")), F.lit("doc"), ["path"])
    out = tmp_path / "out"
    sinks.copy_sources(made, str(out))
    files = {p.name: p.read_bytes() for p in (out / "Agreements" / "Terms").iterdir()}
    assert sorted(files) == ["doc.pdf", "doc_1.pdf", "doc_2.pdf"] and b"deep" in files.values()


def test_a_further_package_overwrites_nothing(spark, folder, tmp_path):
    scan = sources.scan_documents(spark, str(folder), recurse=True).select("path")
    out = tmp_path / "out k=v"
    assert sources.stems_in(spark, str(out)).count() == 0
    for _ in range(2):
        there = sources.stems_in(spark, str(out))
        made = sinks.package_manifest(scan, F.array(F.lit("Agreement"), F.lit("Terms")), F.lit("doc"), ["path"], existing=there)
        sinks.copy_sources(made, str(out))
    names = sorted(p.name for p in (out / "Agreements" / "Terms").iterdir())
    assert names == ["doc.pdf", *[f"doc_{i}.pdf" for i in range(1, 6)]]
    (out / "top.a.json").write_text("{}")
    (out / "other.txt").write_text("x")
    found = {tuple(r) for r in sources.stems_in(spark, str(out)).collect()}
    assert ("", "top.a") in found and ("Agreements/Terms", "doc_5") in found and len(found) == 7


def test_classification_table(spark):
    rows = spark.createDataFrame([("p", "b", ["a", "b"]), ("q", "c", ["c"])], "path string, type_key string, selection_path array<string>")
    table = sinks.classification_table(rows)
    assert table.columns == ["file_path", "model_name", "path_level_1", "path_level_2"]
    assert sorted(map(tuple, table.collect())) == [("p", "b", "a", "b"), ("q", "c", "c", "")]
    assert sinks.classification_table(rows.where("false")).columns == ["file_path", "model_name"]


def test_written_index(spark, tmp_path):
    docs = spark.createDataFrame([("f", f"T{i}", f"{i:02}.md", i) for i in range(20)], "folder string, title string, file string, n int")
    sinks.write_index(sinks.index_lines(docs, "folder", "title", "file", ["n"]), "folder", str(tmp_path / "index"))
    parts = sorted((tmp_path / "index" / "folder=f").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[:4] == ["# Documents", "", "| Title | N | File |", "| --- | --- | --- |"]
    assert lines[4:] == [f"| T{i} | {i} | [{i:02}.md]({i:02}.md) |" for i in range(20)]


def test_types_from_files(spark, tmp_path):
    (tmp_path / "my_Type.json").write_text(SHAPE.json())
    assert load_types(spark, str(tmp_path)) == {"my_Type": SHAPE}


def test_failed_writes_are_rows(spark, tmp_path):
    (tmp_path / "taken").write_text("a file, not a folder")
    rows = spark.createDataFrame([("ok/a.txt", "x"), ("taken/b.txt", "y")], "out_path string, content string")
    done = {r.path: (r.status, r.error_message) for r in sinks.write_files(rows, str(tmp_path)).collect()}
    assert done["ok/a.txt"] == ("ok", None) and (tmp_path / "ok" / "a.txt").read_text() == "x"
    assert done["taken/b.txt"][0] == "failed" and done["taken/b.txt"][1]
    copies = spark.createDataFrame([(f"file://{tmp_path}/ok/a.txt", "c/a.txt"), (f"file://{tmp_path}/none", "c/n.txt")], "path string, document_target string")
    states = {r.path: r.status for r in sinks.copy_sources(copies, str(tmp_path)).collect()}
    assert states == {"c/a.txt": "ok", "c/n.txt": "failed"}
