import pytest
from pyspark.sql import functions as F

from culvert.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "feet"),
    [("16+82.45", 1682.45), ("STA: 13+40.73,  28.00'  RT", 1340.73), ("10+00", 1000.0), ("9+94.00", 994.0), ("12345+00", 234500.0), ("NO STATION HERE", None), ("", None), (None, None)],
)
def test_station(spark, text, feet):
    got = value(spark, S.parse_station(F.lit(text).cast("string")))
    assert got == pytest.approx(feet) if feet is not None else got is None


@pytest.mark.parametrize(
    ("text", "feet"),
    [("28.00' RT", 28.0), ("6.00' LT", -6.0), ("45.00' RTGB", 45.0), ("6.00 L", -6.0), ("28.00 R", 28.0), ("-6' LT", 6.0), ("OFFSET UNKNOWN", None), ("0' CL", 0.0), (None, 0.0), ("", 0.0)],
)
def test_offset(spark, text, feet):
    assert value(spark, S.effective_offset(F.lit(text).cast("string"))) == feet


def test_tokens_and_symbols(spark):
    assert value(spark, S.norm_token(F.lit("s.d.-m h"))) == "SDMH"
    assert value(spark, S.norm_type(F.lit(" Gate-Valve #2 "))) == "gate_valve_2"
    assert value(spark, S.clean_unicode(F.lit("Ø12″ ±2° 5′"))) == "DIA12\" +/-2deg 5'"
    assert value(spark, S.diameter_ft(F.lit('18" pipe'))) == 1.5


@pytest.mark.parametrize(
    ("hint", "score"), [("SDMH-1", 2), ("sdmh-1 east", 1), ("valve", 0), ("", 0), (None, 0)]
)
def test_hint_score(spark, hint, score):
    assert value(spark, S.hint_score(F.lit("SDMH-1 | SDMH | NEW"), F.lit(hint).cast("string"))) == score


@pytest.mark.parametrize(
    ("distance", "score", "name"),
    [(None, 1, "medium"), (None, 0, "none"), (5.0, 2, "high"), (10.0, 1, "medium"), (5.0, 0, "medium"), (25.0, 0, "low"), (25.1, 2, "none"), (6.0, 2, "medium")],
)
def test_match_confidence(spark, distance, score, name):
    assert value(spark, S.match_confidence(F.lit(distance).cast("double"), F.lit(score))) == name


def test_confidence_of_sanitised_beats_low_coherence(spark):
    conf = lambda c, s: value(spark, S.extraction_confidence(F.lit(c), F.lit(s)))
    assert [conf(0.7, False), conf(0.9, True), conf(0.1, True), conf(0.4, False), conf(0.39, False)] == ["high", "medium", "medium", "medium", "low"]


@pytest.mark.parametrize(("text", "pages"), [("1-3,7", [1, 2, 3, 7]), ("7, 7,2", [2, 7]), ("", None), (None, None)])
def test_pages(spark, text, pages):
    assert value(spark, S.page_list(F.lit(text).cast("string"))) == pages


@pytest.mark.parametrize("text", ["3-1", "0", "x"])
def test_pages_errors(spark, text):
    with pytest.raises(Exception, match="invalid pages"):
        value(spark, S.page_list(F.lit(text)))


@pytest.mark.parametrize(
    ("text", "found"),
    [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('noise {"a":{}} tail', '{"a":{}}'), ("no object", None), ("} {", None), (None, None)],
)
def test_json_candidate(spark, text, found):
    assert value(spark, S.json_candidate(F.lit(text).cast("string"))) == found


def test_node_id(spark):
    located = S.node_id(F.lit("SD"), F.lit(14), F.lit("sd mh"), F.lit("13+40.73"), F.lit("28' RT"), F.lit(1340.73), F.lit(28.0))
    assert value(spark, located) == "SD:14:SDMH:1340.73:+28.00"
    lost = value(spark, S.node_id(F.lit("SD"), F.lit(14), F.lit("CB"), F.lit("?"), F.lit("?"), F.lit(None).cast("double"), F.lit(0.0)))
    assert lost.startswith("SD:14:CB:") and len(lost.split(":")[-1]) == 10


def test_small_helpers(spark):
    assert value(spark, S.page_of_tile(F.lit("P14_a0"))) == 14
    assert value(spark, S.page_of_tile(F.lit("page 3"))) is None
    assert value(spark, S.normalize_status(F.lit(" OK "))) == "ok"
    assert value(spark, S.normalize_status(F.lit("odd"))) == "runtime_error"
    assert value(spark, S.is_existing(F.lit("Yes"))) is True
    assert value(spark, S.slug(F.lit("Plan set #4 (final)"))) == "Plan-set-4-final"
    assert value(spark, S.slug(F.lit("--"))) == "run"
    assert value(spark, S.quality_grade(F.lit(0.3))) == "B"
