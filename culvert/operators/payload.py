"""Payloads as models return them: recovery of the JSON, the record sanitizer, metadata correction.

Edge cases: a payload without an object gives null; lists that are not lists count as empty; null elements are dropped
and counted; water fittings without an offset lie on the centre line; ids that are no integers are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert import config as C
from culvert.functions import scalars as S

RAW = (
    "tile_id string, page_number string, sheet_type string, utility_types_present array<string>, street_names array<string>, lot_numbers array<string>, extraction_notes string, "
    "structures array<struct<id:string,structure_type:string,size:string,station:string,offset:string,rim_elevation:string,tc_elevation:string,fl_elevation:string,is_existing:string,notes:string,source_text_ids:array<string>,"
    "inverts:array<struct<direction:string,pipe_size:string,pipe_type:string,elevation:string,source_text_ids:array<string>>>>>, "
    "pipes array<struct<pipe_type:string,size:string,material:string,length_lf:string,slope:string,slope_unit:string,from_station:string,to_station:string,from_structure_hint:string,to_structure_hint:string,notes:string,source_text_ids:array<string>>>, "
    "callouts array<struct<callout_type:string,text:string,station:string,offset:string,elevation:string,reference_sheet:string,reference_detail:string,source_text_ids:array<string>>>"
)


def filled(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def integer_ids(ids: Column) -> Column:
    return F.coalesce(F.filter(F.transform(ids, lambda v: v.try_cast("int")), lambda v: v.isNotNull()), F.array().cast("array<int>"))


def parsed(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Adds ``candidate`` and the struct ``p`` of the recovered object."""
    return payloads.withColumn("candidate", S.json_candidate(F.col(text))).withColumn("p", F.from_json("candidate", RAW))


def sanitized(payloads: DataFrame) -> DataFrame:
    """Good structures, pipes and callouts of each parsed payload, and how many were dropped of each kind."""
    water = lambda s: S.norm_type(s["structure_type"]).isin(*C.WATER_FITTINGS)
    good_structure = lambda s: s.isNotNull() & filled(s["structure_type"]) & filled(s["station"]) & (water(s) | filled(s["offset"]))
    good_invert = lambda i: i.isNotNull() & filled(i["direction"]) & filled(i["pipe_size"]) & i["elevation"].isNotNull()
    good_pipe = lambda p: p.isNotNull() & filled(p["pipe_type"]) & filled(p["size"])
    good_callout = lambda c: c.isNotNull() & filled(c["callout_type"]) & filled(c["text"])
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    with_ids = lambda r: r.withField("source_text_ids", integer_ids(r["source_text_ids"]))
    kept = F.filter("p.structures", good_structure)
    raw_inverts = F.flatten(F.transform(kept, lambda s: F.coalesce(s["inverts"], F.array())))
    clean = F.transform(
        kept,
        lambda s: s.withField("offset", F.when(~filled(s["offset"]), "0' CL").otherwise(s["offset"]))
        .withField("inverts", F.transform(F.filter(F.coalesce(s["inverts"], F.array()), good_invert), lambda i: i.withField("source_text_ids", integer_ids(i["source_text_ids"]))))
        .withField("is_existing", S.is_existing(s["is_existing"]))
        .withField("source_text_ids", integer_ids(s["source_text_ids"])),
    )
    return payloads.filter("p is not null").select(
        *[c for c in payloads.columns if c not in ("p", "candidate")],
        clean.alias("structures"),
        F.transform(F.filter("p.pipes", good_pipe), with_ids).alias("pipes"),
        F.transform(F.filter("p.callouts", good_callout), with_ids).alias("callouts"),
        *[F.col(f"p.{c}").alias(c) for c in ("sheet_type", "utility_types_present", "street_names", "extraction_notes") if c not in payloads.columns],
        *([integer_ids(F.col("p.lot_numbers")).alias("lot_numbers")] if "lot_numbers" not in payloads.columns else []),
        (size(F.col("p.structures")) - size(kept)).alias("dropped_structures"),
        (size(raw_inverts) - size(F.filter(raw_inverts, good_invert))).alias("dropped_inverts"),
        (size(F.col("p.pipes")) - size(F.filter("p.pipes", good_pipe))).alias("dropped_pipes"),
        (size(F.col("p.callouts")) - size(F.filter("p.callouts", good_callout))).alias("dropped_callouts"),
    )


def corrected_metadata(payloads: DataFrame) -> DataFrame:
    """Tile id and page of the payload, corrected from the record they arrived with; names of corrected fields."""
    page = F.coalesce(S.page_of_tile(F.col("tile_id")), F.lit(None).cast("int"))
    said_tile, said_page = F.nullif(F.trim("p.tile_id"), F.lit("")), F.nullif(F.trim("p.page_number"), F.lit("")).try_cast("int")
    fields = F.array_sort(F.array_compact(F.array(F.when(said_tile.isNull() | (said_tile != F.col("tile_id")), F.lit("tile_id")), F.when(page.isNotNull() & (said_page.isNull() | (said_page != page)), F.lit("page_number")))))
    return payloads.filter("p is not null and tile_id is not null").select("raw_id", "tile_id", F.coalesce(page, said_page).alias("page_number"), fields.alias("corrected_fields"))


def prompt_items(layers: DataFrame) -> DataFrame:
    """Spans slimmed for a prompt: id, text and box rounded to whole points; incomplete spans left out."""
    ok = lambda i: i.isNotNull() & i["text_id"].isNotNull() & filled(i["text"]) & (F.size(i["bbox_local"]) == 4)
    slim = F.transform(F.filter("text_items", ok), lambda i: F.struct(i["text_id"].alias("id"), i["text"].alias("t"), F.transform(i["bbox_local"], lambda v: F.round(v, 0).cast("int")).alias("b")))
    return layers.filter("text_items is not null").select("layer_id", F.to_json(slim).alias("items"), F.size(slim).alias("n_items"))
