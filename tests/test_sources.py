"""Readers and writers over small files, malformed ones among them."""

import datetime
import json
import zipfile

from kappaforge.operators import costs, mapping, matching
from kappaforge.sources import readers, writers


def test_csv_text(spark, tmp_path):
    path = tmp_path / "pilot.csv"
    path.write_bytes('id,"first name",note\n007,Zo\xeb,"a ""quoted"", line\nand one more"\n8,,\n'.encode("latin-1"))
    rows = readers.pilot_csv(spark, str(path), ["id", "first name", "note"]).collect()
    assert [tuple(r) for r in rows] == [("007", "Zoë", 'a "quoted", line\nand one more'), ("8", None, None)]


def test_notes(spark, tmp_path):
    day = datetime.date(2024, 1, 5)
    rows = [(1, 10, day, 5, "kept"), (2, 11, day, 5, "not of the cohort"), (3, 10, None, 6, None), (4, 10, day, 7, "of no known class")]
    spark.createDataFrame(rows, readers.NOTE).write.parquet(str(tmp_path / "note"))
    spark.createDataFrame([(5, "Letter"), (5, "Letter"), (6, "Report")], readers.CONCEPT).write.parquet(str(tmp_path / "concept"))
    cohort = spark.createDataFrame([(10,), (10,), (12,)], "person_id long")
    got = readers.notes(spark, str(tmp_path / "note"), cohort, str(tmp_path / "concept")).collect()
    assert sorted((r.note_id, r.note_class) for r in got) == [(1, "Letter"), (3, "Report"), (4, None)]
    assert sorted((r.note_id, r.note_class) for r in readers.notes(spark, str(tmp_path / "note"), cohort).collect()) == [(1, "5"), (3, "6"), (4, "7")]


def test_run_metadata(spark, tmp_path):
    whole = {"episode_id": "e1", "model": "m", "elapsed_seconds": 2.5, "prompt_tokens": 7, "completion_tokens": 3, "n_llm_calls": 2, "surplus": [1]}
    for name, text in {"a/e1": json.dumps(whole, indent=1), "a/e2": '{"episode_id": "e2", "elapsed', "b/deep/e3": json.dumps({"episode_id": "e3"}), "b/e4": "[]"}.items():
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        (folder / "run_metadata.json").write_text(text)
        (folder / "other.json").write_text("{}")
    got = readers.run_metadata(spark, str(tmp_path / "runs")).collect()
    assert [(r.episode_id, r.elapsed_seconds, r.n_llm_calls) for r in got] == [("e1", 2.5, 2)]


def test_run_folders(spark, tmp_path):
    for folder, text in {"P-01_20240105": "old", "P-01_20240301": "new", "P2_notaday": "odd", "nofolder": "lost"}.items():
        (tmp_path / "runs" / folder).mkdir(parents=True)
        (tmp_path / "runs" / folder / "stage2_output.json").write_text(json.dumps({"episode_id": folder, "labels": [{"text": text, "qualifier": "Diagnoses"}]}))
    got = {r.key: r for r in readers.run_folders(spark, str(tmp_path / "runs")).collect()}
    assert got.keys() == {"P01", "P2"} and got["P01"].labels[0].text == "new" and got["P01"].adm == datetime.date(2024, 3, 1) and got["P01"].nid == "1" and got["P2"].adm is None


LINES = [
    ["id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId", "mapGroup", "mapPriority", "mapRule", "mapAdvice", "mapTarget", "correlationId", "mapCategoryId"],
    ["u1", "20240101", "1", "m", "999002271000000101", "111", "1", "1", "TRUE", "ALWAYS A01", "A010", "c", "k"],
    ["u2", "20240101", "0", "m", "999002271000000101", "111", "1", "2", "TRUE", "", "A020", "c", "k"],
    ["u3", "20240101", "1", "m", "1", "111", "1", "2", "TRUE", "", "A030", "c", "k"],
    ["u4", "20240101", "1", "m", "1891651000000103", "222", "x", "1", "TRUE", "", "B100", "c", "k"],
    ["too", "short"],
]


def test_rf2_map(spark, tmp_path):
    text = "".join("\t".join(x) + "\r\n" for x in LINES)
    (tmp_path / "map").mkdir()
    for name in ("der2_ExtendedMapSnapshot_1.txt", "der2_ExtendedMapFull_1.txt", "der2_SimpleMapSnapshot_1.txt"):
        (tmp_path / "map" / name).write_text(text, newline="")
    with zipfile.ZipFile(tmp_path / "release.zip", "w") as z:
        for name in ("a/der2_ExtendedMapSnapshot_1.txt", "a/der2_ExtendedMapFull_1.txt"):
            z.writestr(name, text)
    for rows in (readers.rf2_map(spark, str(tmp_path / "map")), readers.rf2_map_zip(spark, str(tmp_path / "release.zip"))):
        assert sorted((r.refset, r.sctid, r.map_group, r.target) for r in rows.collect()) == [("diagnosis", "111", 1, "A010"), ("procedure", "222", None, "B100")]


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t> Date </t></is></c></row>
<row r="2"><c r="A2"><v>7</v></c><c r="AB2"><v>45296</v></c><c r="C2"/></row><row r="3"><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>"""


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Patient</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", SHEET)
    cells = readers.workbook_cells(spark, str(tmp_path / "book.xlsx"))
    assert sorted((r.row, r.col, r.value) for r in cells.collect()) == [(1, 1, "Patient"), (1, 28, " Date "), (2, 1, "7"), (2, 28, "45296"), (3, 1, "rich text")]
    rows = readers.sheet_rows(cells, ["Patient", "Date"]).orderBy("ord").collect()
    assert [(r.ord, r.Patient, r.Date) for r in rows] == [(2, "7", "45296"), (3, "rich text", None)]


def test_bundles_are_overwritten_by_id(spark, tmp_path):
    path, one = str(tmp_path / "bundles"), "episode_id string, notes array<struct<note_date:string,note_class:string,is_anchor:boolean,text:string>>"
    for rows in ([("001", [("2024-01-05", "Letter", True, "a")]), ("e2", [])], [("e2", [("2024-02-01", None, False, "b")])]):
        writers.bundle_json(spark.createDataFrame(rows, one), path)
    got = {r.episode_id: r.notes for r in readers.bundles(spark, path).collect()}
    assert got.keys() == {"001", "e2"} and got["001"][0].text == "a" and got["e2"][0].text == "b"
    assert [r.episode_id for r in readers.bundles(spark, path, exclude=["e2"]).collect()] == ["001"]


def test_results_logs_and_documents(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "model string, kappa double")
    writers.result_csv(table, str(tmp_path / "csv"))
    writers.result_csv(table, str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.csv_text(spark, str(tmp_path / "csv"), ["model", "kappa"]).collect()] == [("a", "1.5"), ("b", None)]
    writers.result_parquet(table, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    for run in ("r1", "r2"):
        writers.append_log(table, str(tmp_path / "log"), run)
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("run_id").count().count() == 2
    writers.stage_documents(spark.createDataFrame([("e", "stage1", '{"x": 1}'), ("e", "stage2", "two")], "episode_id string, stage string, body string"), str(tmp_path / "docs"))
    assert {(r.stage, r.value) for r in spark.read.text(str(tmp_path / "docs")).collect()} == {("stage1", '{"x": 1}'), ("stage2", "two")}


def test_lookup_is_read_back(spark, tmp_path):
    targets = spark.createDataFrame([("diagnosis", "111", "A01.0", "A01.0"), ("procedure", "222", "B10", "B10;B11")], "refset string, sctid string, code string, candidates string")
    writers.lookup(targets, str(tmp_path / "lookup"))
    got = readers.lookup(spark, str(tmp_path / "lookup"))
    assert sorted((r.refset, r.sctid, r.code, r.candidates) for r in got.collect()) == [tuple(r) for r in targets.collect()]
    labels = spark.createDataFrame([("Diagnoses", "111"), ("Procedures", "999")], "qualifier string, snomed_ct string")
    assert sorted((r.icd10 or "", r.opcs4 or "") for r in mapping.classified(labels, got).collect()) == [("", ""), ("A01.0", "")]
    none = readers.lookup(spark, str(tmp_path / "nowhere"))
    assert none.count() == 0 and mapping.classified(labels, none).count() == 2


def test_linkage_keeps_the_unlinked(spark):
    episodes = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "nid string, episode string")
    links = spark.createDataFrame([("1", 10), ("3", 30)], "nid string, person_id int")
    assert sorted((r.episode, r.person_id) for r in matching.linked(episodes, links).collect()) == [("a", 10), ("b", None), ("c", None)]


def test_study():
    read = readers.study('output_dir = "out"\n[models]\nname = "m"\n', {"KAPPAFORGE_OUTPUT_DIR": "elsewhere"})
    assert read.output_dir == "elsewhere" and read.settings["models"]["name"] == "m"
    assert readers.study("").output_dir == "results" and readers.study('output_dir = "out"').output_dir == "out"


def test_tally_and_usage(spark):
    runs = spark.createDataFrame([("a", None), ("b", "timeout"), ("c", None)], "episode_id string, error string")
    assert {r.status: r.n for r in costs.tally(runs).collect()} == {"ok": 2, "failed": 1}


def test_notes_in_buckets_are_not_shuffled(spark, tmp_path):
    """A cohort, notes of which are wanted, and what is done by person afterwards: no exchange stands above the notes."""
    day = datetime.date(2024, 1, 5)
    rows = [(k, k % 40, day, 5, f"text {k}") for k in range(400)] + [(900, None, day, 5, "nobody")]
    spark.sql("drop table if exists notes_here")
    table = spark.createDataFrame(rows, readers.NOTE)
    writers.notes_by_person(table, "notes_here", 8)
    try:
        cohort = spark.createDataFrame([(3,), (3,), (17,), (99,)], "person_id long")
        found = readers.notes_of_table(spark, "notes_here", cohort)
        assert sorted(r.note_id for r in found.collect()) == sorted(k for k in range(400) if k % 40 in (3, 17))
        by_person = found.join(spark.table("notes_here").groupBy("person_id").count().hint("merge"), "person_id").select("note_id", "count")
        assert {r["count"] for r in by_person.collect()} == {10}
        for df in (found, by_person):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "notes_here" in plan and "Bucketed: true" in plan
            # an exchange and the scan that it deals out: only the cohort's
            lines = plan.split("== Initial Plan ==")[0].splitlines()
            depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
            for k, line in enumerate(lines):
                if "Scan parquet" in line:
                    above = [x for n, x in enumerate(lines[:k]) if depth(x) < depth(line) and all(depth(y) > depth(x) for y in lines[n + 1 : k + 1])]
                    assert not any("Exchange" in x for x in above), plan
    finally:
        spark.sql("drop table if exists notes_here")
