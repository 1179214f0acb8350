import pytest
from pyspark.sql import functions as F

from culvert.llm import canonical_values as V
from tests.tables import make, rows

CANON = [
    ("structure_type", "SDMH", "Storm drain manhole"), ("structure_type", "SSMH", "Sanitary sewer manhole"), ("structure_type", "reducer", "Reducer fitting"), ("structure_type", "PRV", "Pressure reducing valve"), ("structure_type", "tee", "Tee fitting"), ("structure_type", "meter", "Water meter"),
    ("material", "RCP", "Reinforced concrete pipe"), ("material", "DIP", "Ductile iron pipe"), ("material", "VCP", "Vitrified clay pipe"), ("material", "PVC", "Polyvinyl chloride, general"), ("material", "PVC_SDR26", "Polyvinyl chloride, SDR 26"), ("material", "STL", "Welded steel pipe"),
    ("callout_type", "match_existing", "Match existing"),
]


def matcher(name):
    return V.CanonicalMatcher([(b, c) for a, b, c in CANON if a == name], V.ALIASES[name])


@pytest.mark.parametrize(
    ("name", "value", "code"),
    [
        ("structure_type", "S.D.M.H.", "SDMH"), ("structure_type", "STORM  DRAIN_MANHOLE (N)", "SDMH"), ("structure_type", "storm mannhole", "SDMH"), ("structure_type", "exist. storm drain manhole, deep", "SDMH"), ("structure_type", "pozo de registro sanitrio", "SSMH"),
        ("structure_type", "red.", "reducer"), ("structure_type", "presss red valve", "PRV"), ("structure_type", "redwood fence", "none"), ("structure_type", "light pole", "none"), ("structure_type", "tree well", "none"), ("structure_type", "", "none"), ("structure_type", "?*", "none"),
        ("material", "SDR / PVC 26", "PVC_SDR26"), ("material", "Chloride, Polyvinyl", "PVC"), ("material", "plastc (PVC)", "PVC"), ("material", "cemnt lined steel", "STL"), ("material", "wood stave", "none"), ("material", "RCP 24", "RCP"), ("material", '24" RCP', "RCP"), ("material", "RCP, 600mm dia. (E)", "RCP"), ("material", "not PVC pipe", "none"), ("material", "steel pipe, not PVC", "STL"),
        ("material", "pipe, ductile of iron, cement lined", "DIP"), ("material", "concrete (heavily reinforced) pipe", "RCP"), ("material", "iron, of the ductlie kind", "DIP"), ("material", "x " * 5000 + "clay, so-called vitrified", "VCP"), ("material", "red cop", "none"),
        ("callout_type", "match (E)", "match_existing"), ("callout_type", "MATCH (e) (e)", "match_existing"),
    ],
)
def test_values(name, value, code):
    assert matcher(name)(value) == code


def test_longest_mention_wins():
    assert matcher("structure_type")("meter near storm drain manhole") == "SDMH"


def test_rows(spark):
    canon = spark.createDataFrame(CANON, "list_name string, canon_code string, title string")
    s = make(spark, "structures", [{"obs_id": i, "structure_type": v} for i, v in enumerate(["SDMH", "sdmh", None, " SDMH", "x" * 30_000 + " storm manhole", "sdmh"])]).withColumn("value", F.lit("y")).withColumn("record_id", F.lit(1))
    c = make(spark, "callouts", [{"callout_id": 1, "callout_type": "legend"}])
    p = make(spark, "pipes", [{"pipe_id": 1, "material": "PVC"}, {"pipe_id": 2, "material": "p.v.c."}])
    got = rows(V.map_values(V.typed_values(s, c, p), canon))
    assert got == sorted([("structure", i, "SDMH") for i in (1, 3, 4, 5)] + [("callout", 1, "none"), ("pipe", 2, "PVC")])
    empty = V.typed_values(*[make(spark, t, []) for t in ("structures", "callouts", "pipes")])
    assert V.map_values(empty, canon).count() == 0
    assert rows(V.map_values(V.typed_values(s, c, p), canon.limit(0)), "canon_code")[0] == ("none",)


def test_edits():
    assert [V.edits("meter", x, 2) for x in ("meter", "metre", "mter", "mxxxr")] == [0, 1, 1, 3]


def test_stages():
    m = matcher("material")
    assert [m.stage_of(v)[0] for v in ("p.v.c.", "old PVC pipe here", "iron, of the ductlie kind", "vitrifiedclay pip", "tree")] == ["exact", "mention", "tokens", "edits", "none"]
