"""Sources of a study: extracts, notes, run folders, maps and workbooks.

Every reader takes an explicit schema or reads text; nothing is inferred. Paths
may lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import itertools
import os
import re
import tomllib
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaforge.sources import archives, keyed

#: reference sets of the two maps (fixed values)
REFSETS = {"999002271000000101": "diagnosis", "1891651000000103": "procedure"}
NOTE = "note_id long, person_id long, note_date date, note_class_concept_id long, note_text string"
CONCEPT = "concept_id long, concept_name string"
RUN_METADATA = (
    "episode_id string, model string, model_key string, provider string, temperature double, seed int, reasoning_effort string, timestamp string, elapsed_seconds double, "
    "prompt_tokens long, completion_tokens long, n_llm_calls long, total_tokens long, estimated_cost_usd double, n_notes int, n_input_chars int"
)
BUNDLE = "episode_id string, notes array<struct<note_date:string,note_class:string,is_anchor:boolean,text:string>>"
STAGE = "episode_id string, stage string, labels array<struct<text:string,context:string,qualifier:string,laterality:string,presence:string,primary_secondary:string,experiencer:string,treatment_stage:string,snomed_ct:string,icd10:string,opcs4:string,classification_candidates:string>>"


def csv_text(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """Named columns of a CSV file, all as text; empty cells are null."""
    rows = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*(F.col(f"`{c}`") for c in columns))


def pilot_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Latin-1 extract of the pilot."""
    return csv_text(spark, path, columns, encoding="ISO-8859-1")


def of_cohort(rows: DataFrame, persons: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Notes of the persons of a cohort (person_id), with note_class from ``concepts`` (concept_id, concept_name), else the concept's number."""
    rows = rows.join(persons.select("person_id"), "person_id", "left_semi")
    if concepts is None:
        return rows.withColumn("note_class", F.col("note_class_concept_id").cast("string")).drop("note_class_concept_id")
    names = concepts.dropDuplicates(["concept_id"]).select(F.col("concept_id").alias("note_class_concept_id"), F.col("concept_name").alias("note_class"))
    return rows.join(names, "note_class_concept_id", "left").drop("note_class_concept_id")


def notes_of_table(spark: SparkSession, table: str, persons: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """of_cohort for a table of writers.notes_by_person: the notes stay where they lie, only the cohort is dealt to their buckets."""
    return of_cohort(spark.table(table), persons.select("person_id").distinct().hint("merge"), concepts)


def notes(spark: SparkSession, path: str, persons: DataFrame, concepts: str | None = None) -> DataFrame:
    """Notes of the persons of a cohort from parquet files, with note_class from those of the concept table."""
    return of_cohort(spark.read.schema(NOTE).parquet(path), persons, concepts and spark.read.schema(CONCEPT).parquet(concepts))


SEARCH = "episode_id string, label_idx int, term string, round int, items array<struct<term:string,id:string>>"


def bundle_store(spark: SparkSession, path: str) -> keyed.Store:
    return keyed.Store(spark, path, ["episode_id"], BUNDLE)


def search_store(spark: SparkSession, path: str) -> keyed.Store:
    return keyed.Store(spark, path, ["episode_id", "label_idx", "round"], SEARCH)


def bundles(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """Episode bundles without excluded ids (a stated list): what writers.bundle_json wrote, else one JSON document a file."""
    store = bundle_store(spark, path)
    one = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").schema(BUNDLE)
    rows = store.read() if store.commits() else one.json(path)
    return rows.where(~F.col("episode_id").isin(exclude)) if exclude else rows


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Answers of searches as writers.search_results left them."""
    return search_store(spark, path).read()


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All run_metadata.json files below a folder; malformed ones, and ones without elapsed_seconds, are left out."""
    schema = T._parse_datatype_string(RUN_METADATA + ", _corrupt string")
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run_metadata.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(path)
    return rows.where("_corrupt is null and elapsed_seconds is not null").drop("_corrupt")


def run_folders(spark: SparkSession, path: str, stage: str = "stage2") -> DataFrame:
    """Stage documents of run folders <patient>_<date>, the later folder of a patient winning.

    Adds key (letters and digits of the patient), nid (digits) and adm.
    """
    from kappaforge.functions.codes import alnum_id, norm_id
    from kappaforge.operators.matching import last_per_key

    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{stage}_output.json").schema(STAGE).json(path)
    named = rows.withColumn("folder", F.element_at(F.split("_metadata.file_path", "/"), -2))
    patient, day = F.regexp_extract("folder", "^(.*)_([^_]*)$", 1), F.regexp_extract("folder", "^(.*)_([^_]*)$", 2)
    keyed = named.where(patient != "").withColumn("key", alnum_id(patient)).withColumn("nid", norm_id(patient)).withColumn("adm", F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date"))
    return last_per_key(keyed, "key", "folder")


def _map_rows(lines: DataFrame, refsets: dict[str, str]) -> DataFrame:
    c = F.split("value", "\t")
    used = lines.where((F.size(c) >= 11) & (F.get(c, F.lit(2)) == "1") & F.get(c, F.lit(4)).isin(*refsets))
    kind = F.create_map(*(F.lit(x) for kv in refsets.items() for x in kv))
    return used.select(
        F.element_at(kind, F.get(c, F.lit(4))).alias("refset"), F.get(c, F.lit(5)).alias("sctid"), F.get(c, F.lit(6)).try_cast("int").alias("map_group"), F.get(c, F.lit(7)).try_cast("int").alias("priority"),
        F.get(c, F.lit(8)).alias("map_rule"), F.get(c, F.lit(9)).alias("advice"), F.get(c, F.lit(10)).alias("target"), "ord",
    )


def rf2_map(spark: SparkSession, path: str, glob: str = "*ExtendedMap*Snapshot*.txt", refsets: dict[str, str] = REFSETS) -> DataFrame:
    """Active rows of a release's extended map in a folder. Only the snapshot is read, as full and delta files repeat it."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return _map_rows(lines.withColumn("ord", F.monotonically_increasing_id()), refsets)


def _on_workers(path: str) -> bool:
    """Whether a path names no store of its own, so that every worker opens it as a file."""
    return not re.match(r"[A-Za-z][\w+.-]*://", path) or path.startswith("file:///")


def rf2_map_zip(spark: SparkSession, path: str, pattern: str = r"ExtendedMap.*Snapshot.*\.txt$", refsets: dict[str, str] = REFSETS) -> DataFrame:
    """The same from a release's zip files, a task for each member; in other stores a task for each zip."""
    if _on_workers(path):
        return _map_rows(archives.register(spark).read.format("kappaforge_zip_lines").option("pattern", pattern).load(path), refsets)
    lines = _unpacked(spark, path, archives.ZipLines({"pattern": pattern}))
    return _map_rows(lines, refsets)


def workbook_cells(spark: SparkSession, path: str, sheet: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """(sheet, sheet_ord, row, col, value) of .xlsx and .xlsb workbooks, a task for each sheet; in other stores a task for each workbook.

    Values are stored text, dates serial numbers. A malformed sheet fails the read;
    with mode PERMISSIVE what stands before the fault is kept.
    """
    options = {"mode": mode} | ({"sheet": sheet} if sheet is not None else {})
    if _on_workers(path):
        cells = archives.register(spark).read.format("kappaforge_workbook").options(**options).load(path)
    else:
        cells = _unpacked(spark, path, archives.WorkbookSource(options))
    return cells.drop("path")


def _unpacked(spark: SparkSession, path: str, source: archives.WorkbookSource | archives.ZipLines) -> DataFrame:
    """The rows of ``source`` from archives that Spark reads as a whole, as stores have no files to open."""
    names, kinds = zip(*source.columns)
    permissive = source.options.get("mode", "").upper() == "PERMISSIVE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for k, (name, member) in enumerate(source.members(where, z)):
                        rows = source.rows(z, archives.Member(where, name, member, k))
                        while part := list(_whole_ones(itertools.islice(rows, archives.BATCH), permissive)):
                            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, source.schema())


def _whole_ones(rows: Iterator[tuple], permissive: bool) -> Iterator[tuple]:
    """``rows`` up to the first fault, which is raised unless ``permissive``."""
    try:
        yield from rows
    except archives.Malformed:
        if not permissive:
            raise


def sheet_rows(cells: DataFrame, columns: list[str], header: int = 1) -> DataFrame:
    """Named columns of a one-sheet workbook as text, with ord, the row number."""
    names = cells.where(F.col("row") == header).select("sheet", "col", F.trim("value").alias("name")).where(F.col("name").isin(columns))
    body = cells.where(F.col("row") > header).join(F.broadcast(names), ["sheet", "col"])  # as many rows as columns asked for
    return body.groupBy("sheet", F.col("row").alias("ord")).pivot("name", columns).agg(F.first("value"))


LOOKUP = "refset string, sctid string, code string, candidates string"


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """Chosen map targets as writers.lookup left them; an empty table where nothing lies at ``path``, so that all labels stay unmapped."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOOKUP)
    return spark.read.schema(LOOKUP).parquet(path)


@dataclass
class Study:
    """A study's configuration, read on the driver."""

    output_dir: str
    settings: dict = field(default_factory=dict)


def study(text: str, environment: Mapping[str, str] = os.environ) -> Study:
    """The configuration from TOML text; output_dir is results if not given, and KAPPAFORGE_OUTPUT_DIR of ``environment`` goes before both."""
    settings = tomllib.loads(text)
    return Study(environment.get("KAPPAFORGE_OUTPUT_DIR") or settings.get("output_dir", "results"), settings)
