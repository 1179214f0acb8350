import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from culvert.llm import survivors as S
from tests.tables import day, make, rows


def found(spark, merged):
    df = make(spark, "merged_structures", merged).withColumn("_n", F.lit(9)).withColumn("field_name", F.lit("x"))
    return rows(S.ranked_survivors(df, ["plan_id", "node_id"], S.node_fields(), S.trust_order(), "merged_id"), "node_id", "field_name", "merged_id")


def test_order_of_trust(spark):
    rim = {"rim_elevation": 1.004, "rim_elevation_values": [1.0]}
    cases = {
        "sanitized": [{"sanitized": True, "variants_count": 9}, {"sanitized": None}, {"sanitized": False}],
        "variants": [{"variants_count": None}, {"variants_count": 1}, {"variants_count": 3}],
        "late": [{"merged_at": None}, {"merged_at": day(1)}, {"merged_at": day(2)}],
        "tie": [{"merged_at": day(1)}, {"merged_at": day(1)}],
        "single": [{}],
    }
    merged = [{"merged_id": 10 * k + i, "node_id": n, "sanitized": False, **rim, **r} for k, (n, rs) in enumerate(cases.items()) for i, r in enumerate(rs)]
    assert found(spark, merged) == [("late", "rim_elevation", 22), ("sanitized", "rim_elevation", 2), ("tie", "rim_elevation", 30), ("variants", "rim_elevation", 12)]


def test_what_is_a_value(spark):
    merged = [
        {"merged_id": 1, "node_id": "n", "size": "UNK.", "notes": " ", "rim_elevation": 9999.99, "rim_elevation_values": [300.0]},
        {"merged_id": 2, "node_id": "n", "size": "n/a", "notes": "--", "rim_elevation": None, "rim_elevation_values": None},
        {"merged_id": 3, "node_id": "n", "size": '8"', "notes": "see note 4", "rim_elevation": 300.0, "rim_elevation_values": [299.0, None, 300.0]},
        {"merged_id": 4, "node_id": "m", "size": "none given", "notes": None, "rim_elevation": float("nan"), "rim_elevation_values": []},
        {"merged_id": 5, "node_id": "m", "size": "TBD", "notes": "?"},
        {"merged_id": 6, "node_id": None, "size": '8"'},
        {"merged_id": 7, "node_id": None, "size": '8"'},
    ]
    assert found(spark, merged) == [("n", "notes", 3), ("n", "rim_elevation", 3), ("n", "size", 3)]
    assert found(spark, []) == []
    assert found(spark, [{"merged_id": i, "node_id": "x", "notes": "w" * 100_000} for i in (2, 1)]) == [("x", "notes", 1)]


def test_truth_discovery_finds_the_reliable_sources(spark):
    rng = random.Random(1)
    good, bad, claims = {"a": 0.95, "b": 0.9}, {"c": 0.35, "d": 0.35, "e": 0.35}, []
    for e in range(400):
        for s, p in {**good, **bad}.items():
            claims.append(("P", f"n{e}", "size", s, "true" if rng.random() < p else f"wrong{rng.randint(1, 2)}"))
    claims += [("P", "n0", "size", None, "wrong"), ("P", "n0", "size", "a", None), (None, "n0", "size", "a", "wrong")]
    df = spark.createDataFrame(claims, "plan_id string, node_id string, field_name string, source string, value string")
    best = S.discover_truth(df, ["plan_id", "node_id"])
    right = best.filter("value = 'true'").count() / 400
    votes = [Counter(c[4] for c in claims[5 * e : 5 * e + 5]).most_common() for e in range(400)]
    plurality = sum(v[0][0] == "true" and (len(v) == 1 or v[0][1] > v[1][1]) for v in votes) / 400
    assert best.count() == 400 and right > plurality + 0.05 and right > 0.9
    assert S.discover_truth(df.limit(0), ["plan_id", "node_id"]).count() == 0


def test_truth_discovery_ends_when_reliabilities_settle(spark):
    claims = [("P", f"n{i}", "size", s, "x" if s != "c" or i % 3 else "y") for i in range(30) for s in "abc"]
    df = spark.createDataFrame(claims, "plan_id string, node_id string, field_name string, source string, value string")
    assert S.discover_truth(df, ["plan_id", "node_id"]).filter("value = 'x'").count() == 30
    with pytest.raises(ValueError, match="still changes"):
        S.discover_truth(df, ["plan_id", "node_id"], rounds=1)


RECORD = (
    "merged_id bigint, plan_id string, node_id string, sanitized boolean, variants_count int, merged_at timestamp_ntz, structure_type string, station string, offset_txt string, id string, size string, notes string, "
    "parsed_station double, signed_offset double, rim_elevation double, tc_elevation double, fl_elevation double, is_existing boolean, page_number int, rim_elevation_values array<double>, inverts array<struct<elevation:double>>"
)


def test_one_record_of_all_fields(spark):
    def row(i, node, variants, kind, station, size, rim, inverts, parsed=None):
        return (i, "P", node, False, variants, None, kind, station, None, None, size, None, parsed, None, rim, None, None, None, 1, [3.0], inverts)

    data = [row(1, "n", 1, "CB", "tbd", None, 9.0, []), row(2, "n", None, "MH", "1+00", "8", 3.0, [(1.5,)], float("nan")), row(3, "alone", 1, "CB", None, "8", None, None), row(4, None, 1, "CB", None, "8", None, None)]
    df = spark.createDataFrame(data, RECORD).withColumn("records", F.lit("x")).withColumn("_o", F.lit("x"))
    got = S.surviving_records(df, ["plan_id", "node_id"], S.record_fields(), S.trust_order()).collect()
    assert len(got) == 1 and got[0]["records"] == 2
    assert (got[0]["structure_type"], got[0]["station"], got[0]["size"], got[0]["rim_elevation"], got[0]["parsed_station"], got[0]["inverts"]) == ("CB", "1+00", "8", 3.0, None, [(1.5,)])
    assert S.surviving_records(df.limit(0), ["plan_id", "node_id"], S.record_fields(), S.trust_order()).count() == 0
