"""Small tables with the schemas of the plan-set data."""

from datetime import datetime

INVERTS = "array<struct<direction:string,pipe_size:string,pipe_type:string,elevation:double,source_text_ids:array<int>>>"
SCHEMAS = {
    "sheets": "plan_id string, page_number int, sheet_label string, sheet_type string, description string, model_tier string, revision int, registered_at timestamp_ntz, voided_at timestamp_ntz",
    "tiles": "plan_id string, tile_id string, page_number int, sheet_type string, street_names array<string>, extraction_notes string, status string, sanitized boolean, coherence_score double, model string, structures_count int, pipes_count int, callouts_count int, dropped_invalid_counts struct<structures:int,inverts:int,pipes:int,callouts:int>, usage_cost double, extracted_at timestamp_ntz, ingested_at timestamp_ntz",
    "text_layers": "layer_id bigint, plan_id string, tile_id string, page_number int, text_items array<struct<text_id:int,text:string,bbox_local:array<double>,bbox_global:array<double>,font:string,font_size:double>>, created_at timestamp_ntz, retired_at timestamp_ntz",
    "structures": f"obs_id bigint, plan_id string, tile_id string, page_number int, id string, structure_type string, size string, station string, offset_txt string, rim_elevation double, tc_elevation double, fl_elevation double, inverts {INVERTS}, is_existing boolean, notes string, source_text_ids array<int>, extracted_at timestamp_ntz, ingested_at timestamp_ntz",
    "pipes": "pipe_id bigint, plan_id string, tile_id string, page_number int, pipe_type string, size string, material string, length_lf double, slope double, slope_unit string, from_station string, to_station string, from_structure_hint string, to_structure_hint string, notes string, source_text_ids array<int>, extracted_at timestamp_ntz, ingested_at timestamp_ntz",
    "callouts": "callout_id bigint, plan_id string, tile_id string, page_number int, callout_type string, callout_text string, reference_sheet string, reference_detail string, extracted_at timestamp_ntz",
    "detail_register": "detail_code string, title string, agency string, registered_at timestamp_ntz, withdrawn_at timestamp_ntz",
    "merged_structures": "merged_id bigint, run_id string, plan_id string, node_id string, size string, rim_elevation double, notes string, sanitized boolean, variants_count int, rim_elevation_values array<double>, merged_at timestamp_ntz",
    "surveyed_assets": "asset_id bigint, asset_tag string, asset_kind string, street_name string, chainage string, lateral_txt string, rim_level double, crew string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, plan_id string, created_at timestamp_ntz",
    "raw_extractions": "raw_id bigint, plan_id string, tile_id string, record_kind string, payload string",
    "canon_values": "list_name string, canon_code string, title string",
    "mix_targets": "source_name string, target_share double, max_repeats int",
}
DEFAULTS = {"plan_id": "P", "tile_id": "p1_r0_c0", "page_number": 1}


def day(n: int) -> datetime:
    return datetime(2024, 1, 1 + n)


def make(spark, name: str, rows: list[dict], **defaults):
    """A table of dict rows; columns that are not given are null (or the default)."""
    names = [c.split()[0] for c in _split(SCHEMAS[name])]
    base = {k: v for k, v in {**DEFAULTS, **defaults}.items() if k in names}
    return spark.createDataFrame([tuple({**base, **r}.get(c) for c in names) for r in rows], SCHEMAS[name])


def _split(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def inv(direction, size, elevation, ids=()):
    return (direction, size, "SD", elevation, list(ids))


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
