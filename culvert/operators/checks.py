"""Consistency checks over the networks; each gives findings of one schema.

Edge cases: unknown elevations, lengths and slopes are never findings; orphan anchors have no elevation; a
network without structure nodes is reported once and not checked further; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert import config as C
from culvert.functions import scalars as S
from culvert.operators.edges import with_ends

FINDING = ["plan_id", "utility", "finding_type", "severity", "description", "source_sheets", "source_text_ids", "node_ids", "edge_ids", "expected_value", "actual_value", "extraction_confidence", "check_confidence"]
NODE_COLUMNS = ["representative", "inverts", "station_ft", "offset_ft", "source_text_ids", "page_number", "sanitized", "min_coherence", "crown_suspects"]


def _finding(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {"expected_value": F.lit(None).cast("string"), "actual_value": F.lit(None).cast("string")}
    for name, kind in (("source_sheets", "array<int>"), ("source_text_ids", "array<int>"), ("node_ids", "array<string>"), ("edge_ids", "array<string>")):
        empty[name] = F.array().cast(kind)
    cols = empty | columns
    return df.select("plan_id", "utility", *[cols[c].alias(c) for c in FINDING[2:]])


def directional_invert(me: str, other: str) -> Column:
    """The invert of end ``me`` that points to end ``other``: by direction and size, by direction, else the lowest."""
    delta = F.col(f"{other}_station_ft") - F.col(f"{me}_station_ft")
    mine, theirs = F.abs(f"{me}_offset_ft"), F.abs(f"{other}_offset_ft")
    dirs = lambda *d: F.array(*[F.lit(x) for x in d])
    prefer = (
        F.when(delta > C.STATION_DELTA_FT, dirs("E", "NE", "SE"))
        .when(delta < -C.STATION_DELTA_FT, dirs("W", "NW", "SW"))
        .when(theirs > mine, dirs("N", "NE", "NW"))
        .when(theirs < mine, dirs("S", "SE", "SW"))
    )
    size = S.norm_size(F.col("size"))
    usable = lambda i: F.array_contains(prefer, F.upper(F.coalesce(i["direction"], F.lit("")))) & i["elevation"].isNotNull()
    pointed = F.filter(F.col(f"{me}_inverts"), usable)
    sized = F.filter(pointed, lambda i: (size != "") & (S.norm_size(i["pipe_size"]) == size))
    return F.when(prefer.isNotNull(), F.coalesce(F.get(sized, F.lit(0))["elevation"], F.get(pointed, F.lit(0))["elevation"], F.col(f"{me}_representative"))).otherwise(F.col(f"{me}_representative"))


def edges_with_inverts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_ends(edges, nodes, NODE_COLUMNS).withColumns({"upstream": directional_invert("u", "v"), "downstream": directional_invert("v", "u")})


def _pages() -> Column:
    return S.distinct_sorted(F.concat("source_pages", F.array("u_page_number", "v_page_number")))


def _texts() -> Column:
    none = F.array().cast("array<int>")
    return S.distinct_sorted(F.concat("source_text_ids", F.coalesce("u_source_text_ids", none), F.coalesce("v_source_text_ids", none)))


def _node_confidence() -> Column:
    least = F.least(F.lit(1.0), F.coalesce("u_min_coherence", F.lit(1.0)), F.coalesce("v_min_coherence", F.lit(1.0)))
    return S.extraction_confidence(least, F.coalesce("u_sanitized", F.lit(False)) | F.coalesce("v_sanitized", F.lit(False)))


def _edge_confidence() -> Column:
    return S.extraction_confidence(F.col("source_coherence"), F.col("sanitized"))


def check_slope(ends: DataFrame) -> DataFrame:
    """Labelled slope against the slope between the inverts of both ends."""
    calc = F.abs(F.col("upstream") - F.col("downstream")) / F.col("length_lf")
    e = ends.filter("length_lf > 0 and slope is not null and upstream is not null and downstream is not null").withColumn("calc", calc).filter(F.abs(F.col("calc") - F.col("slope")) > C.SLOPE_TOL)
    flagged = F.col("crown_candidate") | (F.coalesce(F.size("u_crown_suspects"), F.lit(0)) > 0) | (F.coalesce(F.size("v_crown_suspects"), F.lit(0)) > 0)
    ratio = F.when(F.col("slope") != 0, F.col("calc") / F.abs("slope"))
    crown = (ratio.isNull() | (ratio > C.CROWN_SLOPE_RATIO)) & flagged
    text = lambda c: F.format_string("%.4f", c)
    said = F.concat(F.lit("labeled "), text(F.col("slope")), F.lit(", calculated "), text(F.col("calc")))
    return _finding(
        e,
        finding_type=F.when(crown, "crown_contamination").otherwise("slope_mismatch"),
        severity=F.when(crown, "info").otherwise("warning"),
        description=F.concat(F.when(crown, "Crown read as invert on edge ").otherwise("Slope mismatch on edge "), "edge_id", F.lit(": "), said),
        source_sheets=_pages(),
        source_text_ids=_texts(),
        node_ids=F.array("from_node", "to_node"),
        edge_ids=F.array("edge_id"),
        expected_value=text(F.col("slope")),
        actual_value=text(F.col("calc")),
        extraction_confidence=S.worse(_edge_confidence(), _node_confidence()),
        check_confidence=F.when(crown, "medium").otherwise("high"),
    )


def check_flow(ends: DataFrame) -> DataFrame:
    """Gravity edges that run uphill."""
    e = ends.filter(F.col("utility").isin(*C.GRAVITY) & ~F.col("from_orphan") & ~F.col("to_orphan") & (F.col("downstream") > F.col("upstream") + C.INVERT_TOL))
    text = lambda c: F.format_string("%.2f", F.col(c))
    return _finding(
        e,
        finding_type=F.lit("flow_direction_error"),
        severity=F.lit("error"),
        description=F.concat(F.lit("Backfall on edge "), "edge_id", F.lit(": upstream="), text("upstream"), F.lit(", downstream="), text("downstream")),
        source_sheets=S.distinct_sorted(F.col("source_pages")),
        source_text_ids=_texts(),
        node_ids=F.array("from_node", "to_node"),
        edge_ids=F.array("edge_id"),
        expected_value=F.concat(F.lit("downstream <= "), text("upstream")),
        actual_value=text("downstream"),
        extraction_confidence=_node_confidence(),
        check_confidence=F.lit("high"),
    )


def check_elevations(nodes: DataFrame) -> DataFrame:
    """Nodes whose merged rim elevations disagree."""
    low, high = F.array_min("rim_values"), F.array_max("rim_values")
    n = nodes.filter((F.size("rim_values") > 1) & (high - low > C.RIM_TOL))
    text = lambda c: F.format_string("%.2f", c)
    return _finding(
        n,
        finding_type=F.lit("elevation_mismatch"),
        severity=F.lit("warning"),
        description=F.concat(F.lit("Rim elevation mismatch at node "), "node_id", F.lit(": min="), text(low), F.lit(", max="), text(high)),
        source_sheets=F.array("page_number"),
        source_text_ids=F.col("source_text_ids"),
        node_ids=F.array("node_id"),
        expected_value=F.concat(text(low), F.lit("-"), text(high)),
        actual_value=F.array_join(F.transform("rim_values", lambda v: v.cast("string")), ", "),
        extraction_confidence=S.extraction_confidence(F.col("min_coherence"), F.col("sanitized")),
        check_confidence=F.lit("high"),
    )


def check_connectivity(nodes: DataFrame, edges: DataFrame, quality: DataFrame) -> DataFrame:
    """Unconnected structures and pipes with unresolved ends; quiet where the extraction is poor."""
    keys = ["plan_id", "utility"]
    with_nodes = nodes.select(*keys).distinct()
    bare = edges.select(*keys).distinct().join(with_nodes, keys, "left_anti")
    unverifiable = _finding(
        bare,
        finding_type=F.lit("connectivity_unverifiable"),
        severity=F.lit("info"),
        description=F.lit("The network has pipes but no resolved structures."),
        extraction_confidence=F.lit("high"),
        check_confidence=F.lit("medium"),
    )
    touched = edges.select(*keys, F.col("from_node").alias("node_id")).union(edges.select(*keys, F.col("to_node").alias("node_id"))).distinct()
    poor = quality.select("plan_id", (F.col("bad_ratio") > C.BAD_RATIO).alias("poor"))
    alone = nodes.join(touched, [*keys, "node_id"], "left_anti").join(poor, "plan_id", "left").withColumn("poor", F.coalesce("poor", F.lit(False)))
    orphan = _finding(
        alone.filter(~F.col("poor")),
        finding_type=F.lit("orphan_node"),
        severity=F.lit("warning"),
        description=F.concat(F.lit("Structure node "), "node_id", F.lit(" is not connected to any pipe.")),
        source_sheets=F.array("page_number"),
        source_text_ids=F.col("source_text_ids"),
        node_ids=F.array("node_id"),
        extraction_confidence=S.extraction_confidence(F.col("min_coherence"), F.col("sanitized")),
        check_confidence=F.lit("medium"),
    )
    suppressed = _finding(
        alone.filter("poor").groupBy(*keys).agg(F.count("*").alias("n")),
        finding_type=F.lit("orphan_node_check_suppressed"),
        severity=F.lit("info"),
        description=F.concat(F.lit("Suppressed "), F.col("n").cast("string"), F.lit(" orphan-node warnings due to low extraction quality.")),
        extraction_confidence=F.lit("high"),
        check_confidence=F.lit("medium"),
    )
    blank = F.lit(True)
    for c in ("from_station", "to_station", "from_structure_hint", "to_structure_hint"):
        blank = blank & (F.coalesce(F.col(c), F.lit("")) == "")
    loose = edges.join(with_nodes, keys, "left_semi").filter(~F.col("is_reference_only") & ((F.col("matched_conf") == "none") | F.col("from_orphan") | F.col("to_orphan"))).withColumn("blank", blank)
    unresolved = _finding(
        loose,
        finding_type=F.when(F.col("blank"), "unanchored_pipe").otherwise("dead_end_pipe"),
        severity=F.when(F.col("blank"), "info").otherwise("warning"),
        description=F.concat(F.lit("Pipe "), "edge_id", F.when(F.col("blank"), " has no station or hint at its ends.").otherwise(" has an unresolved end.")),
        source_sheets=S.distinct_sorted(F.col("source_pages")),
        source_text_ids=F.col("source_text_ids"),
        node_ids=F.array("from_node", "to_node"),
        edge_ids=F.array("edge_id"),
        extraction_confidence=_edge_confidence(),
        check_confidence=F.lit("low"),
    )
    return unverifiable.unionByName(orphan).unionByName(suppressed).unionByName(unresolved)


def pipe_size_conflicts(pipes: DataFrame) -> DataFrame:
    """Segments (by stations, else by length and slope) recorded with more than one size."""
    a, b = S.parse_station(F.col("from_station")), S.parse_station(F.col("to_station"))
    placed = a.isNotNull() & b.isNotNull()
    # rounding goes through text, so that keys are the same in every engine
    key = F.when(placed, F.concat_ws("|", F.lit("station"), F.format_string("%.2f", F.least(a, b)), F.format_string("%.2f", F.greatest(a, b)))).otherwise(
        F.concat_ws("|", F.lit("shape"), F.round(F.coalesce("length_lf", F.lit(0.0)), 1).cast("string"), F.round(F.coalesce("slope", F.lit(0.0)), 4).cast("string"))
    )
    grouped = pipes.filter("pipe_type is not null").select("plan_id", F.upper("pipe_type").alias("pipe_type"), key.alias("segment"), F.nullif("size", F.lit("")).alias("size"), "page_number").groupBy("plan_id", "pipe_type", "segment").agg(
        F.array_sort(F.collect_set("size")).alias("sizes"), F.array_sort(F.collect_set("page_number")).alias("source_sheets")
    )
    return grouped.filter(F.size("sizes") > 1)


def run_all_checks(nodes: DataFrame, edges: DataFrame, quality: DataFrame) -> DataFrame:
    """Findings of connectivity, flow, slope and elevation, with the number of the check."""
    ends = edges_with_inverts(edges, nodes)
    parts = [check_connectivity(nodes, edges, quality), check_flow(ends), check_slope(ends), check_elevations(nodes)]
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("check_no", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out
