import random
from datetime import timedelta

from pyspark.sql import functions as F

from culvert.operators import orphan_refs as O
from tests.tables import day, make, rows

SHEETS = [
    {"sheet_label": "C-1", "page_number": 1, "registered_at": day(0), "voided_at": day(10)},
    {"sheet_label": "sd 02", "page_number": 2, "registered_at": day(0)},
    {"sheet_label": None, "page_number": 3, "registered_at": day(0)},
    {"sheet_label": "U-9", "page_number": 9, "registered_at": None},
]
DETAILS = [{"detail_code": "D-24", "registered_at": day(0)}, {"detail_code": "3270", "registered_at": day(0), "withdrawn_at": day(2)}, {"detail_code": "3270", "registered_at": day(8)}]
LAYERS = [
    {"layer_id": 1, "text_items": [(i, "t", None, None, None, None) for i in (0, 63, 64, 200)], "created_at": day(0), "retired_at": day(5)},
    {"layer_id": 2, "text_items": [None, (7, "t", None, None, None, None)], "created_at": day(4)},
    {"layer_id": 3, "text_items": None, "created_at": day(0)},
]


def found(spark, callouts, structures, sheets=SHEETS, details=DETAILS, layers=LAYERS, **kw):
    c, s = make(spark, "callouts", callouts), make(spark, "structures", structures)
    for name in ("scope", "block", "mask", "at", "n", "raw"):  # names the operator uses itself
        c, s = c.withColumn(name, F.lit("x")), s.withColumn(name, F.lit("x"))
    refs = O.plan_set_references(c, s)
    targets = O.plan_set_targets(make(spark, "sheets", sheets), make(spark, "detail_register", details), make(spark, "text_layers", layers))
    missing = O.missing_keys(refs, targets, **kw)
    return rows(O.found_rows(refs, missing)), O.orphan_counts(refs, missing, O.SOURCE_TABLE)


def call(i, sheet=None, detail=None, at=3, **kw):
    return {"callout_id": i, "reference_sheet": sheet, "reference_detail": detail, "extracted_at": None if at is None else day(at), **kw}


def test_references_and_periods(spark):
    callouts = [
        call(1, "SHT c-01"), call(2, "see dwg 1"), call(3, "SEE SHEETS C-1 & SD2"), call(4, "C-1 AND C-7"), call(5, "N/A"), call(6, ""), call(7, "-"),
        call(8, "C1", at=10), call(9, "C1", at=9), call(10, "U-9"), call(11, "C-1A"), call(12, "3 (profile)"), call(13, "C-1", plan_id="Q"), call(14, "C-1", at=None),
        call(20, None, "PER d24"), call(21, None, "STD DETAIL 3270", at=3), call(22, None, "3270", at=8), call(23, None, "T-1"), call(4, "C-1 AND C-7"),
    ]
    structures = [
        {"obs_id": 1, "source_text_ids": [0, 63, 64, 200, None, 0], "extracted_at": day(3)},
        {"obs_id": 2, "source_text_ids": [0, 7, 65], "extracted_at": day(5)},
        {"obs_id": 3, "source_text_ids": None, "extracted_at": day(3)},
        {"obs_id": 4, "source_text_ids": [7], "tile_id": "other", "extracted_at": day(5)},
        {"obs_id": 5, "source_text_ids": [], "extracted_at": day(3)},
    ]
    got, counts = found(spark, callouts, structures)
    assert got == sorted([
        ("reference_sheet", 4, "C-1 AND C-7"), ("reference_sheet", 8, "C1"), ("reference_sheet", 10, "U-9"), ("reference_sheet", 11, "C-1A"), ("reference_sheet", 13, "C-1"),
        ("reference_detail", 21, "STD DETAIL 3270"), ("reference_detail", 23, "T-1"),
        ("source_text_ids", 2, "0"), ("source_text_ids", 2, "65"), ("source_text_ids", 4, "7"),
    ], key=repr)
    assert ("structures", "source_text_ids", "2024-01", 8, 3) in rows(counts, "source_table", "ref_field", "month", "references", "orphans")


def test_heavy_keys_give_the_same_rows_however_they_are_joined(spark):
    rng = random.Random(3)
    callouts = [call(i, "C-1" if i % 3 else f"SD-{rng.randint(1, 4)}", at=rng.randint(0, 20)) for i in range(300)]
    light = found(spark, callouts, [], heavy_share=1.0)[0]
    assert light == found(spark, callouts, [])[0]
    assert light == found(spark, callouts, [], broadcast_rows=0, salts=5)[0]
    live = {"C-1": (0, 10), "SD-2": (0, 99)}
    by_hand = [("reference_sheet", c["callout_id"], c["reference_sheet"]) for c in callouts if not (live.get(c["reference_sheet"], (9, 0))[0] <= (c["extracted_at"] - day(0)) / timedelta(days=1) < live.get(c["reference_sheet"], (9, 0))[1])]
    assert light == sorted(by_hand, key=repr)


def test_empty_tables(spark):
    got, counts = found(spark, [], [], [], [], [])
    assert got == [] and counts.count() == 0
    assert found(spark, [call(1, "C-1")], [], [], [], [])[0] == [("reference_sheet", 1, "C-1")]


def test_long_reference(spark):
    assert found(spark, [call(1, "SEE " * 20_000 + "C-7")], [])[0][0][1] == 1


def test_heavy_keys_of_a_small_table_stay_bounded(spark):
    refs = spark.createDataFrame([("f", "s", i, 2) for i in range(60)], "ref_field string, scope string, block int, n int")
    assert O.heavy_keys(refs, 1 / 48) == []
