import pytest
from pyspark.sql import functions as F

from culvert.operators import units as U
from tests.tables import make, rows

FT = 1 / 0.3048


def values(spark, structures=(), pipes=(), tiles=()):
    s = make(spark, "structures", [{"obs_id": i, **r} for i, r in enumerate(structures)]).withColumn("unit", F.lit("x")).withColumn("t_plan", F.lit("x"))
    p = make(spark, "pipes", [{"pipe_id": i, **r} for i, r in enumerate(pipes)]).withColumn("number", F.lit("x"))
    return U.common_values(s, p, make(spark, "tiles", list(tiles)))


STATIONS = [("22+94.39", "ft", 2294.39), ("STA: 1+00", "ft", 100), ("3,194.87'", "ft", 3194.87), ("802.59 m", "m", 802.59 * FT), ("6+11.71 (m)", "m", 611.71 * FT), ("KM 0.5", "km", 500 * FT), ("661.453 YDS", "yd", 661.453 * 3), ("STA ??", None, None), (None, None, None), ("", None, None), ("1139.397m", "m", 1139.397 * FT)]
OFFSETS = [("8.06 feet LT", "ft", -8.06), ("RT 9.367 M", "m", 9.367 * FT), ("1272CM LT", "cm", -12.72 * FT), ("405\" LT", "inch", -33.75), ("20.84′ RT", "ft", 20.84), ("LT20.70'", "ft", -20.7), ("191 in RT", "inch", 191 / 12), ("11.77' LTGB", "ft", -11.77), ("0' CL", "ft", 0), ("-6.5 m", "m", -6.5 * FT), ("-6.5 m LT", "m", -6.5 * FT), ("12'-6\" RT", "ft", 12.5), ("5 ft 6 in LT", "ft", -5.5), ("12,5 m RT", "m", 12.5 * FT), ("1e2 ft", "ft", 100), ("5 furlongs", None, None), ("RT, 2.56", "ft", 2.56)]
SIZES = [('12"', "size_inch", 12), ("15''", "size_inch", 15), ("DN 375", "size_mm", 375 / 25.4), ("Ø150 MM", "size_mm", 150 / 25.4), ("0.30M dia", "size_m", 0.3 / 0.0254), ("1.5 FT DIA", "size_ft", 18), ("20CM", "size_cm", 20 / 2.54), ('24"x22"', "size_inch", 24), ("1'", "size_ft", 12), ("DIA", None, None), ('3/4"', "size_inch", 0.75), ('1 1/2"', "size_inch", 1.5), ('1-1/2 in', "size_inch", 1.5), ("2 yd", "yd", 72), ("1,200 mm", "size_mm", 1200 / 25.4), ('1/0"', None, None)]
SLOPES = [(None, "frac", 0.05), ("ft/ft", "frac", 0.05), ("'/'", "frac", 0.05), ("% grade", "pct", 0.0005), ("PER CENT", "pct", 0.0005), ("‰", "permil", 0.00005), ("mm/m", "permil", 0.00005), ('"/ft', "in_per_ft", 0.05 / 12), ("IN. PER FT", "in_per_ft", 0.05 / 12), ("1 ON N", "one_in_n", 20), ("run per 1 rise", "one_in_n", 20), ("", "frac", 0.05), ("ft/100 ft", "pct", 0.0005), ("m per km", "permil", 0.00005), ("in*ft", None, None), ("ft^2/ft^2", "frac", 0.05), ("ft^2/ft", None, None), ("ft/mi", None, None), ("yd/ft", None, 0.15), ("nan", None, None)]
UNKNOWN = {"5 furlongs", "in*ft", "ft^2/ft", "ft/mi", "nan"}

@pytest.fixture(scope="module")
def table(spark):
    s = [{"station": t} for t, _, _ in STATIONS] + [{"offset_txt": t} for t, _, _ in OFFSETS]
    p = [{"size": t} for t, _, _ in SIZES] + [{"slope": 0.05, "slope_unit": t} for t, _, _ in SLOPES]
    return {(r["record_kind"], r["record_id"], r["field_name"]): (r["unit_code"], r["common_value"]) for r in values(spark, s, p).collect()}


@pytest.mark.parametrize(("kind", "field", "cases", "start"), [("structure", "station", STATIONS, 0), ("structure", "offset_txt", OFFSETS, len(STATIONS)), ("pipe", "size", SIZES, 0), ("pipe", "slope", SLOPES, len(SIZES))])
def test_values_with_their_unit(table, kind, field, cases, start):
    for i, (text, code, value) in enumerate(cases):
        got = table.get((kind, start + i, field))
        if text in UNKNOWN:  # the row is kept, without unit and value
            assert got == (None, None), (text, got)
        elif code is None and value is not None:
            assert got[0] is None and got[1] == pytest.approx(value, rel=1e-6), (text, got)
        else:
            assert (got is None) == (code is None), (text, got)
        if code:
            assert got[0] == code and got[1] == pytest.approx(value, rel=1e-6), (text, got)


def test_units_in_notes_and_tiles(spark):
    notes = ["STATIONS IN METRES; offset in meters", "sta. in meters", "5 mm gasket", "MIN COVER 0.9 m", None]
    tiles = [{"tile_id": "m", "extraction_notes": "METRIC SHEET: stationing and offsets in m"}, {"tile_id": "m", "extraction_notes": None}, {"tile_id": "d", "extraction_notes": "Grades of driveways in %; not extracted."}, {"tile_id": "c", "extraction_notes": "Pipe cover given as 0.9 m in the legend."}]
    s = [{"station": "1+00", "offset_txt": "5 LT", "notes": n} for n in notes] + [{"station": "1+00", "offset_txt": "5' LT", "tile_id": t} for t in ("m", "d", "c")]
    p = [{"size": "150", "slope": 2.0, "notes": n} for n in ("DIA. IN MM; GRADE GIVEN IN %", "MIN 2% CROSS SLOPE", "fall given as 1 in n", "S IN PERCENT", "GRADE IS RUN TO ONE", "slope per thousand", "fall in inches per foot", 'core drill 6" opening')]
    p += [{"size": '6"', "slope": 0.01, "notes": "nominal dia given in mm", "slope_unit": "ft/ft"}, {"size": "6", "slope": 0.01, "tile_id": "d"}, {"size": None, "slope": float("nan")}]
    got = {(k[0], r, f): u for *k, r, f, u in [tuple(x) for x in U.other_units(values(spark, s, p, tiles)).select("record_kind", "record_id", "field_name", "unit_code").collect()]}
    assert got == {
        ("structure", 0, "station"): "m", ("structure", 0, "offset_txt"): "m", ("structure", 1, "station"): "m", ("structure", 5, "station"): "m",
        ("pipe", 0, "size"): "size_mm", ("pipe", 0, "slope"): "pct", ("pipe", 2, "slope"): "one_in_n", ("pipe", 3, "slope"): "pct", ("pipe", 4, "slope"): "one_in_n", ("pipe", 5, "slope"): "permil", ("pipe", 6, "slope"): "in_per_ft",
    }


def test_edge_cases(spark):
    assert values(spark).count() == 0
    one = [{"station": "9" * 50_000, "plan_id": None}, {"station": "1+00", "tile_id": None}]
    assert rows(values(spark, [*one, one[1]]), "record_id")[-2:] == [(1,), (2,)]


def test_register_gives_the_factors(spark):
    register = spark.createDataFrame([("m", "length", "ft", 3.0), ("one_in_n", "slope", "frac", None)], "unit_code string, quantity string, common_unit string, to_common double")
    s = make(spark, "structures", [{"obs_id": 1, "station": "10 m"}])
    got = U.common_values(s, make(spark, "pipes", [{"pipe_id": 1, "slope": 0.0, "slope_unit": "1:n"}]), make(spark, "tiles", []), register)
    assert rows(got, "record_kind", "unit_code", "common_value") == sorted([("pipe", "one_in_n", None), ("structure", "m", 30.0)], key=repr)


def test_last_delivery_states_the_unit(spark):
    from tests.tables import day

    tiles = [{"tile_id": "t", "extraction_notes": n, "ingested_at": day(d)} for d, n in ((1, "stations in cm"), (2, "stations in m"), (3, None))]
    assert rows(values(spark, [{"station": "5", "tile_id": "t"}], tiles=tiles), "unit_code") == [("m",)]
