import random

import pytest

from culvert.operators import merge
from tests.tables import inv, make, rows


def nodes(spark, structures, tiles=()):
    return merge.merged_nodes(make(spark, "structures", structures), make(spark, "tiles", list(tiles)))


def test_same_place_in_two_notations_is_one_node(spark):
    n = nodes(spark, [
        {"obs_id": 1, "structure_type": "SDMH", "station": "16+82.45", "offset_txt": "28.00' RT", "source_text_ids": [1]},
        {"obs_id": 2, "structure_type": "sd-mh", "station": "STA 16+82.45", "offset_txt": "28.00 RT", "tile_id": "p1_r0_c1", "source_text_ids": [2]},
    ])
    assert rows(n, "variants_count", "source_tile_ids", "source_text_ids") == [(2, ["p1_r0_c0", "p1_r0_c1"], [1, 2])]


def test_fullest_record_survives_and_gaps_are_filled(spark):
    n = nodes(spark, [
        {"obs_id": 1, "structure_type": "SDMH", "station": "1+00", "offset_txt": "5' RT", "size": '48"', "rim_elevation": 300.0},
        {"obs_id": 2, "structure_type": "SDMH", "station": "1+00", "offset_txt": "5' RT", "inverts": [inv("E", '12"', 295.0, [7]), inv("W", '12"', 294.0)], "notes": "x", "rim_elevation": 300.4},
    ])
    r = n.first()
    assert (r["size"], r["rim_elevation"], r["notes"], r["representative"], r["source_text_ids"], r["rim_values"]) == ('48"', 300.4, "x", 294.0, [7], [300.0, 300.4])


def test_grade_break_needs_inverts_and_then_serves_every_utility(spark):
    bare = [{"obs_id": 1, "structure_type": "GB", "station": "1+00", "offset_txt": "5' RT"}]
    assert nodes(spark, bare).count() == 0
    full = [{**bare[0], "inverts": [inv("E", '12"', 1.0)]}]
    assert rows(nodes(spark, full), "utility") == [("SD",), ("SS",), ("W",)]


@pytest.mark.parametrize(("other", "n"), [("10+05.68", 1), ("12+07.59", 2)])
def test_neighbours_merge(spark, other, n):
    got = nodes(spark, [
        {"obs_id": 1, "structure_type": "SDMH", "station": "10+06.00", "offset_txt": "5' RT"},
        {"obs_id": 2, "structure_type": "SDMH", "station": other, "offset_txt": "5.5' RT"},
    ])
    assert got.count() == n


def test_merging_is_not_transitive(spark):
    got = nodes(spark, [{"obs_id": i, "structure_type": "SDMH", "station": f"10+0{2 * i}.00", "offset_txt": "5' RT"} for i in range(4)])
    assert rows(got, "variants_count") == [(2,), (2,)]


def leaders_by_hand(items):
    """Direct transcription of the rule over one page and type: (station, offset) in order."""
    order = sorted(range(len(items)), key=lambda i: (items[i][0] is None, items[i][0] or 0, i))
    used, groups = set(), []
    for a, i in enumerate(order):
        if i in used:
            continue
        group = [i]
        for j in order[a + 1 :]:
            (s, o), (t, p) = items[i], items[j]
            if j in used or s is None or t is None or abs(s - t) > 3.0 or abs(o - p) > 1.0:
                continue
            group.append(j)
            used.add(j)
        groups.append(len(group))
    return sorted(groups)


def test_leader_clustering_against_brute_force(spark):
    rng = random.Random(5)
    structures, expected = [], []
    for page in range(1, 41):
        items, seen = [], set()
        for k in range(rng.randint(1, 14)):
            s = None if rng.random() < 0.1 else round(1000 + rng.randint(0, 24) * 0.5, 2)
            o = rng.choice([5.0, 5.5, 6.2, 7.0])
            if (s, o) in seen or s is None and any(x is None for x, _ in seen):
                continue
            seen.add((s, o))
            items.append((s, o))
            structures.append({"obs_id": page * 100 + k, "page_number": page, "structure_type": "SDMH", "station": "none" if s is None else f"{int(s // 100)}+{s % 100:05.2f}", "offset_txt": f"{o:.2f}' RT"})
        expected += [(page, n) for n in leaders_by_hand(items)]
    got = nodes(spark, structures)
    assert sorted((r["page_number"], r["variants_count"]) for r in got.collect()) == sorted(expected)


def test_edge_cases(spark):
    assert nodes(spark, []).count() == 0
    odd = [
        {"obs_id": 1, "structure_type": "CB", "station": None, "offset_txt": None, "inverts": [None, inv(None, None, None)], "source_text_ids": [None, 3, 3]},
        {"obs_id": 2, "structure_type": "CB", "station": None, "offset_txt": None},
        {"obs_id": 2, "structure_type": "CB", "station": None, "offset_txt": None},
        {"obs_id": 3, "structure_type": None, "station": "1+00"},
        {"obs_id": 4, "structure_type": "CB", "plan_id": None},
    ]
    df = make(spark, "structures", odd)
    from pyspark.sql import functions as F

    clash = df.withColumn("utility", F.lit("x")).withColumn("sanitized", F.lit(True)).withColumn("key", F.lit(1))
    n = merge.merged_nodes(clash, make(spark, "tiles", []))
    assert rows(n, "variants_count", "source_text_ids", "sanitized") == [(3, [3], False)]
