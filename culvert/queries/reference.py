"""Queries of the plan-set operators: parsing, merging, matching, edges, checks, intake, validation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.functions import scalars as S
from culvert.operators import checks, intake, match, merge, payload, quality, references, report, validation
from culvert.plans.network import Network, network_of
from culvert.queries import oracles
from culvert.sources.json_files import pair_with_layers, page_tiers
from culvert.sources.tables import table

_networks: dict[tuple, Network] = {}


def _state_of(spark: SparkSession, sf: str) -> tuple:
    """Names, lengths and times of the folder's files, so that a rewritten folder is another one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def network(spark: SparkSession, sf: str) -> Network:
    """The network of a folder; the last one built in this session is kept while its files stay the same, as many queries look at it."""
    key = (spark.sparkContext.applicationId, sf, _state_of(spark, sf))
    if key not in _networks:
        _networks.clear()
        _networks[key] = network_of(spark, sf)
    return _networks[key]


def _joined(column: str):
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "structures").select("plan_id", "tile_id").unionByName(table(spark, sf, "pipes").select("plan_id", "tile_id"))


# ------------------------------------------------------------------------------ scalars


def parse_station_offset(spark, sf):
    s = table(spark, sf, "structures")
    return s.select("obs_id", S.parse_station(F.col("station")).alias("station_ft"), S.offset_distance(F.col("offset_txt")).alias("distance"), S.offset_side(F.col("offset_txt")).alias("side"), S.effective_offset(F.col("offset_txt")).alias("offset_ft"))


def normalize_tokens(spark, sf):
    s = table(spark, sf, "structures")
    return s.select("obs_id", S.norm_token(F.col("structure_type")).alias("token"), S.norm_type(F.col("structure_type")).alias("label"), S.norm_size(F.col("size")).alias("size_norm"), F.round(S.diameter_ft(F.col("size")), 6).alias("diameter_ft"), S.clean_unicode(F.col("offset_txt")).alias("plain_offset"))


def page_arguments(spark, sf):
    s = table(spark, sf, "sheets").filter("page_number is not null")
    text = F.concat(F.col("page_number").cast("string"), F.lit("-"), (F.col("page_number") + 2).cast("string"), F.lit(", "), (F.col("page_number") + 5).cast("string"))
    return s.select("plan_id", "page_number", F.array_join(S.page_list(text), ",").alias("pages"))


def cache_keys(spark, sf):
    t = table(spark, sf, "text_layers")
    return t.select("layer_id", S.cache_key(F.col("page_number"), F.col("plan_id"), F.col("tile_id")).alias("cache_key"))


# ------------------------------------------------------------------------------ merge


def utility_filter(spark, sf):
    return merge.utility_observations(table(spark, sf, "structures"), table(spark, sf, "tiles")).select("obs_id", "utility", "kind", "sanitized")


def exact_merge(spark, sf):
    m = merge.exact_merge(merge.utility_observations(table(spark, sf, "structures"), table(spark, sf, "tiles")))
    return m.select("plan_id", "utility", "page_number", "kind", "structure_type", "station", "offset", "id", "size", "rim_elevation", "notes", "is_existing", "sanitized", "variants_count", F.size("inverts").alias("n_inverts"), _joined("source_tile_ids").alias("tiles"), _joined("source_text_ids").alias("texts"), F.size("rim_values").alias("n_rims"))


def merged_nodes(spark, sf):
    n = merge.merged_nodes(table(spark, sf, "structures"), table(spark, sf, "tiles"))
    return n.select("plan_id", "utility", "page_number", "node_id", "structure_type", "station", "offset", "id", "size", "rim_elevation", "notes", "is_existing", "sanitized", "variants_count", _joined("source_tile_ids").alias("tiles"), _joined("source_text_ids").alias("texts"), "representative", "min_coherence")


# ------------------------------------------------------------------------------ network


def reference_pages(spark, sf):
    return match.reference_pages(table(spark, sf, "tiles"))


def endpoint_match(spark, sf):
    return network(spark, sf).matched.select("plan_id", "utility", "pipe_id", "edge_id", "from_node", "to_node", "from_conf", "to_conf", "matched_conf", "from_orphan", "to_orphan", "is_reference_only")


def crown_filter(spark, sf):
    n = network(spark, sf).nodes
    return n.filter("size(crown_suspects) > 0").select("plan_id", "utility", "node_id", F.size("crown_suspects").alias("crowns"), F.size("inverts").alias("kept"), "representative")


def network_edges(spark, sf):
    e = network(spark, sf).edges
    return e.select("plan_id", "utility", "from_node", "to_node", "edge_id", "from_station", "to_station", "from_structure_hint", "to_structure_hint", "matched_conf", "from_conf", "to_conf", "sanitized", "crown_candidate", "oriented_by_gravity", "original_from_node", _joined("source_tile_ids").alias("tiles"), _joined("source_text_ids").alias("texts"))


def quality_summary(spark, sf):
    q = quality.quality_summary(_records(spark, sf), table(spark, sf, "tiles"))
    return q.withColumn("warnings", F.array_join("warnings", "; ")).withColumn("bad_ratio", F.round("bad_ratio", 6))


def status_counts(spark, sf):
    return quality.status_counts(table(spark, sf, "tiles"))


def _flat(findings: DataFrame) -> DataFrame:
    lists = {c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in ("source_sheets", "source_text_ids", "node_ids", "edge_ids")}
    return findings.withColumns(lists)


def connectivity(spark, sf):
    n = network(spark, sf)
    return _flat(checks.check_connectivity(n.nodes, n.edges, n.quality)).select("plan_id", "utility", "finding_type", "severity", "source_sheets", "source_text_ids", "node_ids", "edge_ids", "extraction_confidence", "check_confidence")


def _ends(spark, sf):
    n = network(spark, sf)
    return checks.edges_with_inverts(n.edges, n.nodes)


def flow_direction(spark, sf):
    return _flat(checks.check_flow(_ends(spark, sf))).select("plan_id", "utility", "finding_type", "severity", "source_sheets", "source_text_ids", "node_ids", "edge_ids", "extraction_confidence", "check_confidence")


def directional_inverts(spark, sf):
    return _ends(spark, sf).select("plan_id", "utility", "edge_id", "upstream", "downstream")


def slope_consistency(spark, sf):
    return _flat(checks.check_slope(_ends(spark, sf))).select("plan_id", "utility", "finding_type", "severity", "source_sheets", "source_text_ids", "node_ids", "edge_ids", "extraction_confidence", "check_confidence")


def elevation_mismatch(spark, sf):
    return _flat(checks.check_elevations(network(spark, sf).nodes)).select("plan_id", "utility", "finding_type", "severity", "source_text_ids", "node_ids", "expected_value", "extraction_confidence")


def pipe_size_conflict(spark, sf):
    p = checks.pipe_size_conflicts(table(spark, sf, "pipes"))
    return p.groupBy("plan_id", "pipe_type").agg(F.count("*").alias("segments"), F.sum(F.size("sizes")).alias("sizes"))


def run_checks(spark, sf):
    return _flat(network(spark, sf).findings()).select("plan_id", "utility", "check_no", "finding_type", "severity", "node_ids", "edge_ids", "extraction_confidence", "check_confidence")


# ------------------------------------------------------------------------------ reports


def findings_report(spark, sf):
    return report.findings_report(network(spark, sf).findings()).select("plan_id", "rank", "utility", "finding", "severity", "pages")


def severity_counts(spark, sf):
    return report.severity_counts(network(spark, sf).findings())


def structure_schedule(spark, sf):
    return report.structure_schedule(network(spark, sf).nodes)


def pipe_schedule(spark, sf):
    n = network(spark, sf)
    return report.pipe_schedule(n.edges, n.nodes)


def batch_results(spark, sf):
    return report.batch_results(table(spark, sf, "tiles"))


def batch_totals(spark, sf):
    return report.batch_totals(table(spark, sf, "tiles"))


# ------------------------------------------------------------------------------ intake


def coherence(spark, sf):
    return intake.layer_measures(table(spark, sf, "text_layers")).select("layer_id", "total_spans", "multi_char_spans", "numeric_spans", "primary_font", F.round("coherence", 6).alias("coherence"), "is_viable")


def page_coherence(spark, sf):
    return intake.page_coherence(table(spark, sf, "text_layers")).withColumn("coherence", F.round("coherence", 6))


def layer_routing(spark, sf):
    return intake.routing(table(spark, sf, "text_layers"))


def sheet_classify(spark, sf):
    return intake.classified_layers(table(spark, sf, "text_layers"))


def sheet_index(spark, sf):
    t = table(spark, sf, "text_layers")
    return intake.sheet_index(t.select(F.col("layer_id").alias("group_id"), F.posexplode("text_items.text").alias("pos", "line")))


def tile_clips(spark, sf):
    pages = table(spark, sf, "sheets").select("plan_id", "page_number").dropna().distinct()
    return intake.page_clips(pages).select("plan_id", "page_number", "tile_id", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def title_blocks(spark, sf):
    x0, y0, x1, y1 = intake.title_block_rect()
    spans = intake.page_spans(table(spark, sf, "text_layers")).filter((F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1))
    return spans.groupBy("layer_id").agg(F.count("*").alias("spans"))


def span_tiles(spark, sf):
    return intake.spans_in_clips(table(spark, sf, "text_layers"))


def occupancy(spark, sf):
    return intake.occupied_cells(table(spark, sf, "text_layers"))


def content_regions(spark, sf):
    return intake.content_regions(table(spark, sf, "text_layers"))


def adaptive_tiles(spark, sf):
    return intake.adaptive_tiles(table(spark, sf, "text_layers"), table(spark, sf, "sheets").select("plan_id", "page_number").dropna())


def pair_layers(spark, sf):
    paired, missing = pair_with_layers(table(spark, sf, "tiles"), table(spark, sf, "text_layers"))
    one = lambda df, s: df.select("plan_id", "tile_id").distinct().withColumn("state", F.lit(s))
    return one(paired, "paired").unionByName(one(missing, "missing_text_layer"))


def page_model_tiers(spark, sf):
    return page_tiers(table(spark, sf, "sheets"))


# ------------------------------------------------------------------------------ payloads and validation


def json_candidate(spark, sf):
    return table(spark, sf, "raw_extractions").select("raw_id", S.json_candidate(F.col("payload")).alias("candidate"))


def sanitize_payload(spark, sf):
    p = payload.sanitized(payload.parsed(table(spark, sf, "raw_extractions").filter("record_kind = 'extraction'")))
    return p.select("raw_id", F.size("structures").alias("structures"), F.size("pipes").alias("pipes"), F.size("callouts").alias("callouts"), "dropped_structures", "dropped_inverts", "dropped_pipes", "dropped_callouts")


def corrected_metadata(spark, sf):
    return payload.corrected_metadata(payload.parsed(table(spark, sf, "raw_extractions"))).withColumn("corrected_fields", F.array_join("corrected_fields", ","))


def salvaged_objects(spark, sf):
    return table(spark, sf, "raw_extractions").filter("payload is not null").select("raw_id", F.size(S.salvage_objects(F.col("payload"))).alias("objects"))


def prompt_items(spark, sf):
    return payload.prompt_items(table(spark, sf, "text_layers")).select("layer_id", "n_items")


def package_artifacts(spark, sf):
    a = validation.artifact_messages(validation.artifacts(table(spark, sf, "tiles"), table(spark, sf, "text_layers"), _records(spark, sf)))
    return a.select("plan_id", "tile_id", "status", "deliveries", "has_layer", "has_records", F.size("critical").alias("critical"), F.size("warnings").alias("warnings"))


def package_report(spark, sf):
    r = validation.package_report(table(spark, sf, "tiles"), table(spark, sf, "text_layers"), _records(spark, sf))
    return r.withColumn("bad_ratio", F.round("bad_ratio", 6))


def declared_counts(spark, sf):
    return validation.declared_counts(*[table(spark, sf, t) for t in ("tiles", "structures", "pipes", "callouts")])


def submitted_returned(spark, sf):
    key = F.concat_ws("/", "plan_id", "tile_id").alias("tile")
    return validation.submitted_minus_returned(table(spark, sf, "tiles").select(key), table(spark, sf, "raw_extractions").filter("plan_id is not null and tile_id is not null").select(key), "tile")


# ------------------------------------------------------------------------------ references


def _mentions(spark, sf):
    sheets = table(spark, sf, "sheets")
    pages = sheets.groupBy("plan_id").agg(F.max("page_number").alias("total_pages"))
    line = F.concat_ws(" ", "callout_text", "reference_sheet")
    lines = table(spark, sf, "callouts").filter("plan_id is not null and page_number is not null").select("plan_id", "page_number", line.alias("line"))
    label = F.regexp_replace(F.upper("sheet_label"), "[^A-Z0-9]", "")
    index = sheets.select("plan_id", F.explode(F.array(label, F.col("page_number").cast("string"))).alias("code")).filter("code is not null")
    return references.reference_issues(references.sheet_mentions(lines, pages), index)


def xref_issues(spark, sf):
    return _mentions(spark, sf).withColumn("pages", _joined("pages"))


def sheet_categories(spark, sf):
    return table(spark, sf, "sheets").select("plan_id", "page_number", "revision", references.category(F.col("description")).alias("category"))


def calibration_score(spark, sf):
    m = table(spark, sf, "merged_structures")
    expected = m.select("plan_id", F.col("merged_id").alias("fact_id"), "page_number", "structure_type", "station", "rim_elevation")
    scored = references.score_facts(expected, table(spark, sf, "structures"))
    return scored.groupBy("plan_id").agg(F.count("*").alias("facts"), F.count_if("passed").alias("passed"), F.count("obs_id").alias("matched"))


def distinct_structures(spark, sf):
    return references.distinct_observations(table(spark, sf, "structures").select("plan_id", "structure_type", "station", "offset_txt", "obs_id", "size"), ["plan_id", "structure_type", "station", "offset_txt"], "obs_id")


def distinct_pipes(spark, sf):
    return references.distinct_observations(table(spark, sf, "pipes").select("plan_id", "pipe_type", "size", "from_station", "to_station", "pipe_id", "material"), ["plan_id", "pipe_type", "size", "from_station", "to_station"], "pipe_id")


QUERIES = {
    f.__name__: f
    for f in (
        parse_station_offset, normalize_tokens, page_arguments, cache_keys, utility_filter, exact_merge, merged_nodes, reference_pages, endpoint_match, crown_filter, network_edges, quality_summary, status_counts,
        connectivity, flow_direction, directional_inverts, slope_consistency, elevation_mismatch, pipe_size_conflict, run_checks, findings_report, severity_counts, structure_schedule, pipe_schedule, batch_results, batch_totals,
        coherence, page_coherence, layer_routing, sheet_classify, sheet_index, tile_clips, title_blocks, span_tiles, occupancy, content_regions, adaptive_tiles, pair_layers, page_model_tiers,
        json_candidate, sanitize_payload, corrected_metadata, salvaged_objects, prompt_items, package_artifacts, package_report, declared_counts, submitted_returned,
        xref_issues, sheet_categories, calibration_score, distinct_structures, distinct_pipes,
    )
}

ORACLES = oracles.ORACLES
