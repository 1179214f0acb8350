import random

import pytest
from pyspark.sql import functions as F

from culvert.llm import linkage as L
from tests.tables import make, rows

CANON = [("structure_type", c, t) for c, t in (("SDMH", "Storm drain manhole"), ("CB", "Catch basin"), ("gate_valve", "Water gate valve"), ("meter", "Water meter"))]


@pytest.fixture(scope="module")
def case(spark):
    """Things every 25 ft, seen in up to three tiles, surveyed with errors; decoys on the other side and next to them."""
    rng = random.Random(7)
    words = {"SDMH": ["SDMH", "storm manhole"], "CB": ["CB", "catch basin"], "gate_valve": ["gate valve", "GV"]}
    tiles, obs, assets, truth, oid, aid = [], [], [], set(), 0, 10**6
    for k, street in enumerate(["Brookmere Junction Drive", "Glenwick Levee Court", "Ironbeck Terrace Avenue"]):
        plan = f"P{k}"
        tiles += [{"plan_id": plan, "tile_id": f"t{t}", "street_names": [street, "PRIVATE DRIVEWAY"]} for t in range(3)] * 2
        base = street.rsplit(" ", 1)[0]
        for i in range(40):
            kind, ft, off, rim = rng.choice(list(words)), 1000 + 25.0 * i, rng.choice([-1, 1]) * rng.uniform(5, 40), rng.uniform(300, 350)
            seen = []
            for t in rng.sample(range(3), rng.randint(1, 3)):
                oid += 1
                seen.append(oid)
                metric = rng.random() < 0.2
                s = ft * 0.3048 if metric else ft
                obs.append({"obs_id": oid, "plan_id": plan, "tile_id": f"t{t}", "id": f"{kind[:2].upper()}-{100 + i}" if rng.random() < 0.6 else None, "structure_type": rng.choice(words[kind]), "station": f"{s:.2f} m" if metric else f"{int(s // 100)}+{s % 100:05.2f}", "offset_txt": f"{abs(off):.2f}' {'RT' if off > 0 else 'LT'}", "rim_elevation": round(rim, 2)})
            for _ in range(rng.choice([0, 1, 1, 2])):
                aid += 1
                name = rng.choice([street, street.upper(), base, base + " " + {"Drive": "Dr.", "Court": "ct", "Avenue": "AVE"}[street.split()[-1]], street.replace("o", "oo", 1).replace("e", "ee", 1) if rng.random() < 0.3 else street])
                a = ft + rng.gauss(0, 0.5)
                assets.append({"asset_id": aid, "asset_tag": f"{100 + i}" if rng.random() < 0.4 else None, "asset_kind": rng.choice(words[kind]).upper(), "street_name": name, "chainage": rng.choice([f"{a:.2f} ft", f"STA {int(a // 100)}+{a % 100:05.2f}", f"{int(a * 0.3048 // 1000)}+{a * 0.3048 % 1000:06.2f} m"]), "lateral_txt": rng.choice([f"{abs(off):.1f} {'R' if off > 0 else 'L'}", f"{off:+.1f}"]), "rim_level": round(rim + rng.gauss(0, 0.05), 2)})
                truth |= {(o, aid) for o in seen}
            if i % 8 == 0:  # decoys: the mirror image, and another kind close by
                for side, near, what in ((-off, 0.5, kind), (off, 6.0, "WATER METER")):
                    aid += 1
                    assets.append({"asset_id": aid, "asset_kind": what, "street_name": street, "chainage": f"{ft + near:.2f}", "lateral_txt": f"{side:+.1f}"})
    odd = [{"asset_id": 1}, {"asset_id": 2, "street_name": "Brookmere Junction"}, {"asset_id": 3, "street_name": "", "chainage": "x" * 20_000}]
    tables = {n: make(spark, n, r) for n, r in (("structures", obs + [{"obs_id": 10**5}, {"obs_id": 10**5 + 1, "plan_id": "P0", "tile_id": "t0"}]), ("tiles", tiles), ("surveyed_assets", assets + odd))}
    tables["structures"] = tables["structures"].withColumn("base", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("asset_id", F.lit(1))
    return tables, truth


def links(spark, t):
    return L.plan_set_links(t["structures"], t["tiles"], t["surveyed_assets"], spark.createDataFrame(CANON, "list_name string, canon_code string, title string"))


def test_precision_and_recall(spark, case):
    tables, truth = case
    got = links(spark, tables)
    pairs = {(r["obs_id"], r["asset_id"]) for r in got.collect()}
    assert got.filter("confidence is null or confidence < 0 or confidence > 1").count() == 0
    assert len(pairs & truth) / len(pairs) > 0.97
    assert len(pairs & truth) / len(truth) > 0.9


def test_far_positions(spark):
    """A position more than 3.3 ft off is no veto where the kind is the same and the rim level no other."""
    cases = [  # station, lateral, kind, tag, rim
        ((-1, 0, 2, 0, 2), True),
        ((-1, 0, 2, 0, 0), True),
        ((-1, 0, 2, 0, -1), False),
        ((-1, 0, 0, 0, 2), False),
        ((-1, 0, 2, -1, 2), False),
        ((-1, -1, 2, 0, 2), False),  # twins facing each other have equal rims
        ((-1, 2, 2, 0, -1), True),
        ((1, 0, 0, 0, -1), True),
    ]
    votes = spark.createDataFrame([(*v, want) for v, want in cases], "v_station int, v_lateral int, v_kind int, v_tag int, v_rim int, want boolean")
    assert votes.filter(L.consistent() != F.col("want")).count() == 0


OBS = "obs_id bigint, plan_id string, base string, suffix string, o_station double, o_lateral double, o_kind string, o_number string, o_prefix string, o_rim double"
ASSET = "asset_id bigint, name string, a_station double, a_lateral double, a_kind string, a_number string, a_prefix string, a_rim double"


def placed(spark, assets):
    streets = spark.createDataFrame([("n", "oak", "drive", True)], "name string, base string, suffix string, exact boolean")
    return spark.createDataFrame(assets, ASSET).join(streets, "name").drop("name")


def test_observations_without_station(spark):
    """A thing seen only without station is found by its tag; one seen with and without, by any of its ids."""
    at = ("P", "oak", "drive")
    obs = [(i, *at, 1000.0 + 60 * i, 10.0, "CB", None, None, 300.0 + i) for i in range(40)]
    obs += [(100, *at, None, 10.0, "CB", "7", "CB", 350.0)]  # the thing of asset 2000
    obs += [(101, *at, 9000.0, 10.0, "CB", "7", "CB", 320.0)]  # the same id far down the street
    obs += [(102, *at, 5000.0, 10.0, "CB", None, None, 360.0), (103, *at, 5000.3, 10.0, "CB", "8", "CB", 360.0), (104, *at, None, 10.0, "CB", "8", "CB", 360.0)]  # the thing of asset 2001
    obs += [(105, *at, None, 10.0, "CB", "9", "CB", 330.0)]  # another rim level than asset 2002
    assets = [(1000 + i, "n", 1000.4 + 60 * i, 10.1, "CB", None, None, 300.0 + i) for i in range(40)]
    assets += [(2000, "n", 7000.0, None, "CB", "7", "CB", 350.05), (2001, "n", 5000.0, 10.0, "CB", None, None, 360.0), (2002, "n", 8000.0, None, "CB", "9", "CB", 370.0)]
    got = {r[:2] for r in rows(L.link(placed(spark, assets), spark.createDataFrame(obs, OBS), least=0.0), "obs_id", "asset_id")}  # so few pairs fit no model
    assert got == {(i, 1000 + i) for i in range(40)} | {(100, 2000), (102, 2001), (103, 2001), (104, 2001)}


def test_every_pair_is_judged_by_its_own_votes(spark):
    """Observations of one thing have unlike posteriors; one that contradicts everything the asset says falls below the limit."""
    at = ("P", "oak", "drive")
    rng = random.Random(4)
    obs = [(i, *at, 1000.0 + 60 * i, 10.0, "CB", str(i), "CB", 300.0 + i) for i in range(60)]
    obs += [(100 + i, *at, 1000.5 + 60 * i, None, None, None, None, 300.0 + i + 9 * (i % 2)) for i in range(30)]
    assets = placed(spark, [(1000 + i, "n", 1000.0 + 60 * i + rng.gauss(0, 0.4), 10.0, "CB", None, None, 300.0 + i) for i in range(60)])
    got = {r[:2]: r[2] for r in rows(L.link(assets, spark.createDataFrame(obs, OBS), least=0.0), "obs_id", "asset_id", "confidence")}
    assert {k for k in got if k[0] < 100} == {(i, 1000 + i) for i in range(60)}
    assert all(0.0 <= c <= 1.0 for c in got.values())
    assert {k for k in got if k[0] >= 100} == {(100 + i, 1000 + i) for i in range(30)}
    assert got[101, 1001] < got[100, 1000]  # another rim level


def test_a_pair_found_by_place_and_id_comes_once(spark):
    at = ("P", "oak", "drive")
    obs = spark.createDataFrame([(1, *at, 1000.0, 10.0, "CB", "7", "CB", 300.0), (2, *at, None, 10.0, "CB", "7", "CB", 300.0), (3, *at, 1003.0, 10.0, "CB", "7", "CB", 300.0)], OBS)
    assets = placed(spark, [(1000, "n", 1000.0, 10.0, "CB", None, None, 300.0)])
    voted = L.votes(L.candidates(assets, obs))
    anchor = voted.filter("obs_id = 1").select("asset_id", *[F.col(c).alias(f"t_{c}") for c in ("plan_id", "base", "suffix", "o_station", "o_lateral", "o_rim", "a_station", "a_lateral")], F.col("o_kind").alias("t_kind"), F.col("o_number").alias("t_number"), F.col("o_prefix").alias("t_prefix"), "a_station", "a_lateral", "a_kind", "a_number", "a_prefix", "a_rim", "exact")
    assert rows(L.things(anchor, obs), "obs_id", "v_thing", "was_candidate") == [(1, 3, True), (2, 1, False), (3, 1, True)]


def test_empty(spark, case):
    tables, _ = case
    assert links(spark, {**tables, "surveyed_assets": tables["surveyed_assets"].limit(0)}).count() == 0
    assert links(spark, {**tables, "structures": tables["structures"].limit(0)}).count() == 0


def test_streets(spark):
    drawn = spark.createDataFrame([("brookmere junction", "drive"), ("ironbeck terrace", "avenue"), ("glenwick levee", "court"), ("glenwick levee", "lane")], "base string, suffix string")
    names = ["Brookmere Junction DR.", "BROOKMERE  junction", "Brookmere Juunction Drive", "Ironbeck Terrace", "Glenwick Levee", "Glenwick Levee Cuort", "Nowhere Road", ""]
    got = rows(L.match_streets(drawn, spark.createDataFrame([(n,) for n in names], "name string")), "name", "base", "suffix", "exact")
    b = ("brookmere junction", "drive")
    assert got == sorted([("Brookmere Junction DR.", *b, True), ("BROOKMERE  junction", *b, True), ("Brookmere Juunction Drive", *b, False), ("Ironbeck Terrace", "ironbeck terrace", "avenue", True), ("Glenwick Levee", "glenwick levee", "court", True), ("Glenwick Levee", "glenwick levee", "lane", True), ("Glenwick Levee Cuort", "glenwick levee", "court", False)], key=repr)


def test_label_model_learns_which_functions_to_trust():
    rng, counts, truth = random.Random(3), {}, {}
    for _ in range(4000):
        y = rng.random() < 0.3
        good = [(2 if y else -1) if rng.random() < 0.95 else rng.choice([-1, 2]) for _ in range(3)]
        noise = rng.choice([-1, 0, 2])
        p = (*good, noise, noise, 2)  # two functions that copy each other and know nothing
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    model = L.LabelModel(counts)
    right = sum(sum(v == (model.posterior(p) > 0.5) for v in ys) for p, ys in truth.items()) / 4000
    assert right > 0.93 and abs(model.prior - 0.3) < 0.05
