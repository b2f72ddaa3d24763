"""Landing files, manifests, documents, header rows, job status and merge-before-write."""
import datetime as dt
import os
import tempfile

from tidemark.operators.schema import column_mapping_report, find_header_row
from tidemark.operators.window import changed_since
from tidemark.sources.curated import merge_latest_and_publish, publish, read_curated
from tidemark.sources.files import PERMIT_FILE_GLOBS, file_manifest, match_files, read_documents, read_landing
from tidemark.sources.status import append_status, latest_status, read_status


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_landing_csv_all_text(spark):
    d = tempfile.mkdtemp(prefix="tm-csv-")
    _write(f"{d}/a.csv", "HULLNO,STDATE\n2601,26/05/06 08:00\n S2602 ,\n")
    _write(f"{d}/_skip.csv", "HULLNO,STDATE\nX,Y\n")
    df = read_landing(spark, d, "csv", glob="*.csv")
    assert dict(df.dtypes)["HULLNO"] == "string"
    assert sorted((r.HULLNO, r.STDATE) for r in df.collect()) == [(" S2602 ", None), ("2601", "26/05/06 08:00")]
    assert set(df.columns) >= {"_file", "_mtime", "_seq"}


def test_manifest_documents_and_globs(spark):
    d = tempfile.mkdtemp(prefix="tm-docs-")
    _write(f"{d}/ptw/20260819_PTWLIST.xlsx", "x")
    _write(f"{d}/ptw/notes.txt", "line one\nline two")
    m = file_manifest(spark, f"{d}/ptw")
    got = {r.file_name: (r.section, r.length) for r in m.collect()}
    assert got == {"20260819_PTWLIST.xlsx": ("ptw", 1), "notes.txt": ("ptw", 17)}
    flags = {r.file_name: r.ok for r in m.select("file_name", match_files("file_name", PERMIT_FILE_GLOBS).alias("ok")).collect()}
    assert flags == {"20260819_PTWLIST.xlsx": True, "notes.txt": False}
    docs = read_documents(spark, f"{d}/ptw", glob="*.txt").collect()
    assert [(r.stem, r.text) for r in docs] == [("notes", "line one\nline two")]


def test_find_header_row(spark):
    cells = [("f1", 0, "title", None), ("f1", 1, "PJT", "인도년"), ("f1", 2, "SN1", "2026"),
             ("f2", 0, "호선", "x"), ("f2", 1, "SN2", "2027")]
    df = spark.createDataFrame(cells, "file string, seq int, c0 string, c1 string")
    out = find_header_row(df, "file", "seq", ["c0", "c1"])
    got = sorted((r.file, r.c0, list(r._header)) for r in out.collect())
    assert got == [("f1", "SN1", ["PJT", "인도년"]), ("f2", "SN2", ["호선", "x"])]


def test_column_mapping_report(spark):
    rep = column_mapping_report(spark, ["호선(선박)", "작업 시작일", "팀장명"])
    kinds = {(r.standard, r.raw): r.kind for r in rep.collect()}
    assert kinds[("PJT", "호선(선박)")] == "exact"
    assert kinds[("STDATE", "작업 시작일")] == "partial"
    assert kinds[(None, "팀장명")] == "unused"
    assert kinds[("TEAMNM", None)] == "unmapped"


def test_changed_since(spark):
    T = dt.datetime
    files = spark.createDataFrame([("a", T(2026, 1, 1)), ("b", T(2026, 1, 2)), ("c", None)],
                                  "file_name string, modification_time timestamp_ntz")
    seen = spark.createDataFrame([("a", T(2026, 1, 1)), ("b", T(2026, 1, 1))],
                                 "file_name string, modification_time timestamp_ntz")
    assert sorted(r.file_name for r in changed_since(files, seen).collect()) == ["b", "c"]


def test_job_status_and_merge_before_write(spark):
    root = tempfile.mkdtemp(prefix="tm-status-")
    append_status(spark, root, "import", False, "first", "boom", dt.datetime(2026, 1, 1))
    append_status(spark, root, "import", True, "second", "", dt.datetime(2026, 1, 2))
    append_status(spark, root, "weather", True, "w", "", dt.datetime(2026, 1, 1))
    latest = {r.job: (r.ok, r.summary) for r in latest_status(read_status(spark, root)).collect()}
    assert latest == {"import": (True, "second"), "weather": (True, "w")}
    publish(spark.createDataFrame([("k1", "a")], "work string, keyword string"), root, "mapping")
    add = spark.createDataFrame([("k2", "b")], "work string, keyword string")
    merge_latest_and_publish(spark, root, "mapping", lambda base: base.unionByName(add))
    assert sorted(tuple(r) for r in read_curated(spark, root, "mapping").collect()) == [("k1", "a"), ("k2", "b")]
