"""Each scenario is a plan set of its own; all are built in one network."""

import pytest
from pyspark.sql import functions as F

from culvert.operators import checks, match
from culvert.plans.network import Network, build_network
from tests.tables import inv, make, rows

MH = {"structure_type": "SDMH", "offset_txt": "5' RT"}
TILE = {"status": "ok", "sanitized": False, "coherence_score": 0.9, "sheet_type": "plan_view"}
TWO = [{"station": "1+00"}, {"station": "2+00"}]
UPHILL = [{"station": "1+00", "inverts": [inv("E", '12"', 90.0)]}, {"station": "2+00", "inverts": [inv("W", '12"', 95.0)]}]
SLOPE = [{"station": "1+00", "inverts": [inv("E", '12"', 100.0)]}, {"station": "2+00", "inverts": [inv("W", '12"', 99.0)]}]
STEEP = [{"station": "1+00", "inverts": [inv("E", '12"', 325.30)]}, {"station": "1+51", "inverts": [inv("W", '12"', 320.25)]}]
A, B = "SD:1:SDMH:100.00:+5.00", "SD:1:SDMH:200.00:+5.00"
PIPE = {"from_station": "1+00", "to_station": "2+00"}
BACK = {"from_station": "2+00", "to_station": "1+00"}

SCENARIOS = {
    "hint": ([{"station": "1+00", "id": "A-1"}, {"station": "1+02", "id": "B-2", "offset_txt": "20' LT"}], [{"from_station": "1+02", "from_structure_hint": "A-1", "to_structure_hint": "A-1"}]),
    "infer": (TWO, [{"from_station": "1+00", "length_lf": 101.0}, {"from_station": "2+00", "length_lf": 500.0}, {}]),
    "fallback": ([{"station": "1+00"}], [{"from_station": "1+01", "page_number": 9, "tile_id": "p9_r0_c0"}]),
    "last": (TWO, [{**PIPE, "material": m} for m in ("RCP", "PVC")]),
    "reversed": (TWO, [
        {**PIPE, "source_text_ids": [10], "length_lf": 100.0, "slope": 0.005, "notes": "early", "from_structure_hint": "SDMH"},
        {"from_station": "2+06", "to_station": "1+00", "source_text_ids": [20], "length_lf": 101.0, "tile_id": "p1_r0_c1", "notes": "late", "material": "PVC"},
    ]),
    "unlike": (TWO, [PIPE, {**BACK, "size": '24"'}]),
    "uphill": (UPHILL, [PIPE]),
    "replace": (UPHILL, [{**PIPE, "size": '8"'}, BACK]),
    "crown": ([{"station": "1+00", "inverts": [inv("E", '18"', 320.48), inv("W", '18"', 325.14)]}], []),
    "slope_bad": (SLOPE, [{**PIPE, "length_lf": 100.0, "slope": 0.005}]),
    "slope_good": (SLOPE, [{**PIPE, "length_lf": 100.0, "slope": 0.0101}]),
    "slope_negative": (SLOPE, [{**PIPE, "length_lf": 100.0, "slope": -0.01}]),
    "steep": (STEEP, [{"from_station": "1+00", "to_station": "1+51", "length_lf": 51.0, "slope": 0.0011}]),
    "direction": (
        [{"station": "1+00", "inverts": [inv("W", '12"', 99.0), inv("E", '8"', 99.3), inv("E", '12"', 100.0)]}, {"station": "2+00", "inverts": [inv("W", '12"', 99.5)]}],
        [{**BACK, "length_lf": 100.0, "slope": 0.005}],
    ),
    "rim": ([{"station": "1+00", "rim_elevation": 300.0}, {"station": "1+00", "rim_elevation": 300.2}], []),
    "poor": ([{"station": "1+00"}], [], [{**TILE, "status": "skipped_low_coherence", "coherence_score": 0.2}]),
    "pipes_only": ([], [{"from_station": "1+00"}, {}]),
    "signing": ([{"station": "1+00"}], [{}], [{**TILE, "sheet_type": "signing_striping"}]),
    "nulls": ([{"structure_type": None}, {"station": None, "offset_txt": None, "page_number": None}], [{"size": None, "pipe_type": None}, {"page_number": None}, {"tile_id": None}]),
}


@pytest.fixture(scope="module")
def built(spark):
    s, p, t = [], [], []
    for plan, (structures, pipes, *tiles) in SCENARIOS.items():
        s += [{**MH, "obs_id": i, "plan_id": plan, **r} for i, r in enumerate(structures)]
        p += [{"pipe_id": i, "pipe_type": "SD", "size": '12"', "plan_id": plan, **r} for i, r in enumerate(pipes)]
        t += [{"plan_id": plan, **r} for r in (tiles[0] if tiles else [TILE])]
    clash = make(spark, "structures", s).withColumn("utility", F.lit("x")).withColumn("kind", F.lit(1))
    n = build_network(clash, make(spark, "pipes", p).withColumn("edge_no", F.lit(7)), make(spark, "tiles", t))
    n.found = n.findings().cache()
    return n


@pytest.fixture
def of(built):
    def pick(plan):
        one = lambda df: df.filter(F.col("plan_id") == plan)
        n = Network(one(built.nodes), one(built.edges), one(built.quality), one(built.matched))
        n.kinds = sorted(r["finding_type"] for r in one(built.found).collect())
        return n

    return pick


def test_hint_beats_distance_and_ends_differ(of):
    assert rows(of("hint").matched, "from_node", "from_conf", "to_node") == [(A, "high", "SD:1:SDMH:102.00:-20.00")]


def test_missing_end_is_inferred_from_length_or_becomes_an_anchor(of):
    n = of("infer")
    got = rows(n.matched, "pipe_id", "from_orphan", "to_node", "to_conf", "matched_conf")
    assert got[0] == (0, False, B, "low", "low")
    assert got[1][2:] == ("orphan:SD:SD:e1:p1_r0_c0:to", "none", "none")
    assert got[2][1] is True
    assert n.kinds.count("unanchored_pipe") == 1 and n.kinds.count("dead_end_pipe") == 1


def test_page_without_nodes_falls_back_to_the_plan_set(of):
    assert rows(of("fallback").matched, "from_node", "from_conf") == [(A, "medium")]


def test_last_pipe_of_a_pair_wins(of):
    assert rows(of("last").edges, "material", "edge_seq") == [("PVC", 0)]


def test_reversed_duplicate_is_united(of):
    assert rows(of("reversed").edges, "from_node", "source_text_ids", "source_tile_ids", "notes", "material") == [(A, [10, 20], ["p1_r0_c0", "p1_r0_c1"], "early", None)]


def test_unlike_reversed_pipes_stay_two(of):
    assert of("unlike").edges.count() == 2


def test_gravity_turns_uphill_edges_and_replaces_the_edge_there(of):
    assert rows(of("uphill").edges, "from_node", "from_station", "oriented_by_gravity", "original_from_node") == [(B, "2+00", True, A)]
    assert rows(of("replace").edges, "size", "oriented_by_gravity") == [('8"', True)]


def test_crown_readings_are_set_aside(of):
    r = of("crown").nodes.filter("utility = 'SD'").first()
    assert (len(r["crown_suspects"]), r["representative"]) == (1, 320.48)


def test_slope_mismatch_and_crown_confusion(of):
    assert of("slope_bad").kinds == of("slope_negative").kinds == ["slope_mismatch"]
    assert of("slope_good").kinds == []
    assert rows(of("steep").edges, "crown_candidate", "suspect_node") == [(True, A)]
    assert of("steep").kinds == ["crown_contamination"]


def test_directional_invert_prefers_direction_and_size(of):
    n = of("direction")
    got = checks.edges_with_inverts(n.edges, n.nodes)
    assert rows(got, "from_node", "upstream", "downstream") == [(B, 99.5, 100.0)]
    assert n.kinds == ["flow_direction_error"]


def test_rim_spread_and_lonely_nodes(of):
    assert of("rim").kinds == ["elevation_mismatch", "orphan_node"]


def test_poor_quality_suppresses_lonely_nodes(of):
    assert of("poor").kinds == ["orphan_node_check_suppressed"]
    assert rows(of("poor").quality, "quality_grade", "skipped_tiles") == [("D", 1)]


def test_pipes_without_structures_are_reported_once(of):
    assert of("pipes_only").kinds == ["connectivity_unverifiable"]


def test_reference_pages_are_not_reported(spark, of):
    assert of("signing").kinds == ["orphan_node"]
    signing = {**TILE, "sheet_type": "signing_striping"}
    assert match.reference_pages(make(spark, "tiles", [signing, {**TILE, "tile_id": "b", "sheet_type": "profile_view"}])).count() == 0


def test_nulls_do_not_break(of):
    n = of("nulls")
    assert n.nodes.count() == 0 and n.edges.count() == 0


def test_pipe_size_conflicts(spark):
    p = make(spark, "pipes", [{"pipe_id": i, "pipe_type": "sd", "size": s, "from_station": a, "to_station": b} for i, (s, a, b) in enumerate([('8"', "1+00", "2+00"), ('12"', "2+00", "1+00"), ('8"', "3+00", "4+00"), (None, "3+00", "4+00")])])
    assert rows(checks.pipe_size_conflicts(p), "sizes", "source_sheets") == [(['12"', '8"'], [1])]


def test_empty_tables(spark):
    n = build_network(*[make(spark, t, []) for t in ("structures", "pipes", "tiles")])
    assert n.nodes.count() == n.edges.count() == n.findings().count() == n.quality.count() == 0
