import hashlib
import json

from pyspark.sql import functions as F

from culvert.operators import intake, payload, references, report, validation
from tests.tables import day, make, rows


def item(text, box=None, font="A", i=0):
    return (i, text, box, box, font, 8.0)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_layer_measures(spark):
    layers = make(spark, "text_layers", [
        {"layer_id": 1, "text_items": [item("AB1", font="B"), item("x", font="A"), item(" ", font="A"), item("CD", font="A"), None, item("9", font="B"), item(None)]},
        {"layer_id": 2, "text_items": []}, {"layer_id": 3, "text_items": None},
    ])
    got = rows(intake.layer_measures(layers), "layer_id", "total_spans", "multi_char_spans", "numeric_spans", "primary_font", "coherence", "is_viable")
    assert got == [(1, 4, 2, 1, "B", 0.5, True), (2, 0, 0, 0, "", 0.0, False), (3, 0, 0, 0, "", 0.0, False)]
    assert rows(intake.routing(layers), "layer_id", "decision", "needs_escalation")[0] == (1, "extract", True)


def test_sheet_texts(spark):
    t = lambda s: F.lit(s).cast("string")
    assert value(spark, intake.sheet_type(t("general notes"))) == "notes"
    assert value(spark, intake.sheet_type(t("SHEET INDEX vicinity map"))) == "cover"
    assert value(spark, intake.sheet_type(t("plan"))) == "other"
    assert value(spark, intake.sheet_type(t(None))) == "other"
    assert value(spark, intake.utility_types(t("Storm drain, sewer and water main"))) == ["SD", "SS", "W"]
    assert [value(spark, intake.sheet_label(t(x))) for x in ("c-1 ", "PLAN\nU2", "nothing")] == ["C-1", "U-2", None]
    assert [value(spark, intake.model_tier(t(k), F.lit(c))) for k, c in (("detail", 1.0), ("cover", 1.0), ("profile", 1.0), ("cover", 0.4))] == ["premium", "fast", "standard", "premium"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["C-1 COVER SHEET", "U1 - UTILITY", "nothing", None, "C1 LAST COVER"])], "group_id int, pos int, line string")
    assert rows(intake.sheet_index(lines), "label", "description") == [("C-1", "LAST COVER"), ("U-1", "UTILITY")]


def test_clips_and_spans(spark):
    clips = intake.tile_clips()
    px = [(round((c[4] - c[2]) * 300 / 72), round((c[5] - c[3]) * 300 / 72)) for c in clips]
    assert px == [(3960, 3960), (4320, 3960), (3960, 3960)] * 2
    a, b = [10.0, 10.0, 20.0, 20.0], [800.0, 10.0, 860.0, 20.0]
    layers = make(spark, "text_layers", [{"layer_id": 1, "text_items": [item("Ø1", a), item("Ø1", a), item("M", b), item("", a), item("no box")]}])
    got = rows(intake.spans_in_clips(layers), "row", "col", "text_id", "text", "local_x")
    assert got == [(0, 0, 0, "DIA1", 10.0), (0, 0, 1, "M", 800.0), (0, 1, 0, "M", 22.4)]


def test_regions_and_adaptive_tiles(spark):
    left, right = [100.0, 100.0, 900.0, 900.0], [1800.0, 1000.0, 2500.0, 1700.0]
    layers = make(spark, "text_layers", [{"layer_id": 1, "text_items": [item("a", left), item("b", right)]}, {"layer_id": 2, "page_number": 2, "text_items": [item("a", left)]}])
    r = rows(intake.content_regions(layers), "page_number", "region", "x0", "y0")
    assert [x[:2] for x in r] == [(1, 0), (1, 1)]
    pages = make(spark, "sheets", [{"page_number": p} for p in (1, 2)])
    tiles = rows(intake.adaptive_tiles(layers, pages), "tile_id")
    assert ("p1_a1",) in tiles and ("p2_r1_c2",) in tiles and len(tiles) == 8


def test_package(spark):
    tiles = make(spark, "tiles", [
        {"tile_id": "p1_r0_c0", "status": "ok", "structures_count": 1, "ingested_at": day(1)}, {"tile_id": "p1_r0_c1", "status": "dry_run", "ingested_at": day(1)},
        {"tile_id": "p1_r0_c2", "status": "ok", "sanitized": True, "ingested_at": day(1)}, {"tile_id": "p1_r0_c2", "status": "odd", "ingested_at": day(2)}, {"tile_id": "p2_r0_c0", "status": "missing_text_layer"},
    ])
    layers = make(spark, "text_layers", [{"layer_id": i, "tile_id": f"p1_r0_c{i}"} for i in range(3)])
    s = make(spark, "structures", [{"obs_id": 1}, {"obs_id": 2, "tile_id": "p1_r0_c1"}])
    a = validation.artifact_messages(validation.artifacts(tiles, layers, s.select("plan_id", "tile_id")))
    got = {r["tile_id"]: (r["status"], len(r["critical"]), len(r["warnings"])) for r in a.collect()}
    assert got == {"p1_r0_c0": ("ok", 0, 0), "p1_r0_c1": ("dry_run", 0, 1), "p1_r0_c2": ("runtime_error", 1, 0), "p2_r0_c0": ("missing_text_layer", 1, 0)}
    assert rows(validation.package_report(tiles, layers, s.select("plan_id", "tile_id")), "verdict", "paired_tiles") == [("fail", 3)]
    d = validation.declared_counts(tiles, s, make(spark, "pipes", []), make(spark, "callouts", []))
    assert {r["tile_id"]: r["agrees"] for r in d.collect()}["p1_r0_c0"] is True
    good = hashlib.sha256(b"x").hexdigest()
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    expected = spark.createDataFrame([("a", good), ("b", good), ("c", good), ("d", None)], "path string, sha256 string")
    assert rows(validation.verify_hashes(expected, files), "path", "message") == [("b", "hash mismatch"), ("c", "file is missing")]
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k string")
    assert rows(validation.submitted_minus_returned(ids("a", "b", "b"), ids("b", "c"), "k")) == [("a", "not_returned"), ("c", "unknown")]


def test_sanitizer(spark):
    body = {
        "tile_id": "", "page_number": None,
        "structures": [{"structure_type": "CB", "station": "1+00", "offset": "5' RT", "source_text_ids": ["1", "x", 2], "is_existing": "yes", "inverts": [{"direction": "E", "pipe_size": '8"', "elevation": 1.0}, {"direction": "E"}, None]}, {"structure_type": "tee", "station": "1+00"}, {"structure_type": "CB", "station": "1+00"}, None, {"station": "1+00"}],
        "pipes": [{"pipe_type": "SD", "size": '8"', "from_station": "1+00", "to_structure_hint": "CB-1", "notes": "n", "source_text_ids": [1, "y"]}, {"pipe_type": "SD"}],
        "callouts": [{"callout_type": "x", "text": " "}, {"callout_type": "x", "text": "t", "elevation": 3.5, "reference_sheet": "C-1", "reference_detail": "D4", "offset": "5 LT"}], "street_names": ["Oak"], "lot_numbers": [4, "x"],
    }
    raw = make(spark, "raw_extractions", [{"raw_id": 1, "record_kind": "extraction", "tile_id": "p7_r0_c0", "payload": f"sure: {json.dumps(body)}"}, {"raw_id": 2, "payload": None}, {"raw_id": 3, "payload": "none"}])
    r = payload.sanitized(payload.parsed(raw)).first()
    assert (r["dropped_structures"], r["dropped_inverts"], r["dropped_pipes"], r["dropped_callouts"]) == (3, 2, 1, 1)
    assert [s["offset"] for s in r["structures"]] == ["5' RT", "0' CL"]
    assert (r["structures"][0]["source_text_ids"], r["structures"][0]["is_existing"]) == ([1, 2], True)
    p, c = r["pipes"][0], r["callouts"][0]
    assert (p["from_station"], p["to_structure_hint"], p["notes"], p["source_text_ids"]) == ("1+00", "CB-1", "n", [1])
    assert (c["elevation"], c["reference_sheet"], c["reference_detail"], c["offset"], c["source_text_ids"]) == ("3.5", "C-1", "D4", "5 LT", [])
    assert (r["street_names"], r["lot_numbers"]) == (["Oak"], [4])
    assert rows(payload.corrected_metadata(payload.parsed(raw)), "raw_id", "page_number", "corrected_fields") == [(1, 7, ["page_number", "tile_id"])]


def test_cross_references(spark):
    lines = spark.createDataFrame([("P", p, t) for p, t in [(1, "SEE SHEETS C1, 02"), (2, "SHEET C9"), (3, "SHEET C9"), (4, "sheet 99"), (5, "CALTRANS SHEET C8"), (6, None)]], "plan_id string, page_number int, line string")
    pages = spark.createDataFrame([("P", 10)], "plan_id string, total_pages int")
    index = spark.createDataFrame([("P", "C1"), ("P", "2")], "plan_id string, code string")
    got = rows(references.reference_issues(references.sheet_mentions(lines, pages), index), "code", "pages", "valid", "severity")
    assert got == [("2", [1], True, None), ("C1", [1], True, None), ("C9", [2, 3], False, "Low")]
    assert value(spark, references.category(F.lit("Storm drain plan"))) == "utility"
    assert value(spark, references.category(F.lit(None).cast("string"))) == "other"


def test_scoring_and_distinct(spark):
    observed = make(spark, "structures", [{"obs_id": 2, "structure_type": "SDMH 48", "station": "1+00.03", "rim_elevation": 300.04}, {"obs_id": 1, "structure_type": "SDMH", "station": "1+00", "rim_elevation": 290.0, "tile_id": "p1_r1_c0"}])
    expected = spark.createDataFrame([("P", 1, 1, "sdmh", "1+00", 300.0), ("P", 2, 1, "CB", "1+00", None), ("P", 3, 1, "sdmh", "9+00", None)], "plan_id string, fact_id int, page_number int, structure_type string, station string, rim_elevation double")
    assert rows(references.score_facts(expected, observed), "fact_id", "obs_id", "passed") == [(1, 2, True), (2, None, False), (3, None, False)]
    d = references.distinct_observations(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, i int, v string"), ["k"], "i")
    assert rows(d, "k", "i", "v", "observations") == [("a", 1, "y", 2), (None, 3, "z", 1)]


def test_batch_report(spark):
    tiles = make(spark, "tiles", [{"coherence_score": 0.5, "sanitized": True, "dropped_invalid_counts": (1, 0, 2, 0), "structures_count": 3, "usage_cost": 0.5, "model": "m"}, {"tile_id": "b", "model": "m", "page_number": 2}])
    assert rows(report.batch_results(tiles), "coherence", "structures", "sanitized") == [("-", 0, "no"), ("0.500", 3, "yes (structures=1, pipes=2)")]
    assert rows(report.batch_totals(tiles), "pages", "tiles", "total_cost") == [(2, 2, 0.5)]
