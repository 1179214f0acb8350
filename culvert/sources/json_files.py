"""Folders of JSON files: one extraction or tile state per file, and looser folders.

File names route a file: ``p14_r0_c1.json`` is an extraction, ``p14_r0_c1.json.meta.json`` its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EXTRACTION_NAME = r"^p\d+_(?:r\d+_c\d+|a\d+)\.json$"
STATE_NAME = r"^p\d+_(?:r\d+_c\d+|a\d+)\.json\.meta\.json$"

INVERT = "struct<direction:string,pipe_size:string,pipe_type:string,elevation:double,source_text_ids:array<int>>"
EXTRACTION = (
    "tile_id string, page_number int, sheet_type string, utility_types_present array<string>, "
    f"structures array<struct<id:string,structure_type:string,size:string,station:string,offset:string,rim_elevation:double,tc_elevation:double,fl_elevation:double,inverts:array<{INVERT}>,is_existing:boolean,notes:string,source_text_ids:array<int>>>, "
    "pipes array<struct<pipe_type:string,size:string,material:string,length_lf:double,slope:double,from_station:string,to_station:string,from_structure_hint:string,to_structure_hint:string,notes:string,source_text_ids:array<int>>>, "
    "callouts array<struct<callout_type:string,text:string,station:string,offset:string,reference_sheet:string,reference_detail:string,elevation:double,source_text_ids:array<int>>>, "
    "street_names array<string>, lot_numbers array<int>, extraction_notes string"
)
STATE = "tile_id string, page_number int, status string, sanitized boolean, coherence_score double, model string, usage struct<cost:double>"


def _files(spark: SparkSession, folder: str, schema: str, name: str, mode: str) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(f"{folder}/*.json")
    return df.select("*", F.col("_metadata.file_name").alias("file_name")).filter(F.col("file_name").rlike(name))


def extraction_files(spark: SparkSession, folder: str) -> DataFrame:
    """Extractions; a malformed file fails the read."""
    return spark.read.schema(EXTRACTION).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "p*[0-9].json").json(folder).select("*", F.col("_metadata.file_name").alias("file_name")).filter(F.col("file_name").rlike(EXTRACTION_NAME))


def state_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tile states; an id missing in the file is taken from its name."""
    df = spark.read.schema(STATE).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.meta.json").json(folder).select("*", F.col("_metadata.file_name").alias("file_name"))
    return df.filter(F.col("file_name").rlike(STATE_NAME)).withColumn("tile_id", F.coalesce("tile_id", F.regexp_replace("file_name", r"\.json\.meta\.json$", "")))


def loose_files(spark: SparkSession, folder: str, schema: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """All JSON objects of a folder but the named files and tile states; corrupt files are left out."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*.json")
    df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
    return df.filter(F.col("_corrupt").isNull() & ~F.col("file_name").endswith(".meta.json") & ~F.col("file_name").isin(*skip)).drop("_corrupt")


def _records_before(files: DataFrame, name: str) -> DataFrame:
    """``(file_name, _before)``: records of the files whose names sort before."""
    counts = files.groupBy("file_name").agg(F.sum(F.coalesce(F.size(name), F.lit(0))).alias("n")).withColumn("group", F.substring("file_name", 1, 6))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = groups.select("group", before(W.partitionBy(F.lit(1)).orderBy("group")).alias("_offset"))
    return counts.select("file_name", "group", before(W.partitionBy("group").orderBy("file_name")).alias("_within")).join(offsets, "group").select("file_name", (F.col("_offset") + F.col("_within")).alias("_before"))


def tables_of(extractions: DataFrame, states: DataFrame, plan_id: str) -> dict[str, DataFrame]:
    """The engine's tables from a folder of extractions, with ids in order of file name and position.

    Records are counted per file; an id is the number of records in the files before plus the position, so no two are
    the same.  The running sum is over one row a file, in two levels: within groups of names, then over the groups.
    """
    e = extractions.select("file_name", "tile_id", "page_number", F.lit(plan_id).alias("plan_id"), "sheet_type", "structures", "pipes", "callouts")
    out = {}
    for name, key in (("structures", "obs_id"), ("pipes", "pipe_id"), ("callouts", "callout_id")):
        t = e.join(_records_before(e, name), "file_name").select("plan_id", "tile_id", "page_number", "_before", F.posexplode(name).alias("_pos", "_r")).select("plan_id", "tile_id", "page_number", (F.col("_before") + F.col("_pos")).alias(key), "_r.*")
        out[name] = t.withColumnRenamed("offset", "offset_txt") if "offset" in t.columns else t
    sheet = e.select("tile_id", "page_number", "sheet_type")
    s = states.select("tile_id", "status", "sanitized", "coherence_score", "model", F.col("usage.cost").alias("usage_cost"))
    now = F.lit(None).cast("timestamp")
    out["tiles"] = sheet.join(s, "tile_id", "full_outer").withColumns({"plan_id": F.lit(plan_id), "ingested_at": now, "extracted_at": now, "status": F.coalesce("status", F.lit("ok"))})
    return out


def pair_with_layers(tiles: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles that have a text layer, and tiles that have none."""
    key = ["plan_id", "tile_id"]
    return tiles.join(layers.select(*key), key, "left_semi"), tiles.join(layers.select(*key), key, "left_anti")


def page_tiers(manifest: DataFrame) -> DataFrame:
    """Model tier per page; the last registered sheet wins, ``standard`` where none is given."""
    order = F.struct(F.coalesce("revision", F.lit(-1)).alias("a"), F.col("registered_at").cast("timestamp").alias("b"), F.coalesce("model_tier", F.lit("")).alias("c"))
    return manifest.filter("plan_id is not null and page_number is not null").groupBy("plan_id", "page_number").agg(F.coalesce(F.max_by("model_tier", order), F.lit("standard")).alias("model_tier"))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 of every file."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))
