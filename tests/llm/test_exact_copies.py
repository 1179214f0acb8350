import random
from collections import defaultdict

from pyspark.sql import functions as F

from culvert.llm import exact_copies as E
from tests.tables import day, make, rows


def keyed(spark, structures=(), pipes=()):
    return E.plan_set_records(make(spark, "structures", list(structures)), make(spark, "pipes", list(pipes)))


def test_formatting_only(spark):
    same = ["20.70' LT", "LT 20.70'", "lt20.70′.", "(20.70’ Lt),", "\t20.70' \xa0LT ", "LT / 20.70'"]
    other = ["20.70' RT", "207.0' LT", "2070' LT", '20.70" LT', "20.70 LT", "20.71' LT", None, "", " "]
    df = keyed(spark, [{"obs_id": i, "offset_txt": t, "ingested_at": day(i % 5)} for i, t in enumerate(same + other)])
    got = rows(E.copies(df), "first_id", "copy_id")
    # blank and empty texts are the same, null is not
    assert got == [(0, i) for i in range(1, len(same))] + [(13, 14)]
    pipes = [{"pipe_id": i, "size": s, "material": m} for i, (s, m) in enumerate([("15''", "R.C.P."), ('15"', "rcp"), ("15'", "RCP"), ("15”", "RCP"), ('24"x22"', "PVC_C900"), ('24"X22"', "C900 / PVC")])]
    assert rows(E.copies(keyed(spark, pipes=pipes)), "kind", "first_id", "copy_id") == [("pipe", 0, 1), ("pipe", 0, 3), ("pipe", 4, 5)]


def test_all_other_columns_count(spark):
    base = {"offset_txt": "5' LT", "inverts": [("E", '8"', None, 1.0, [1])], "source_text_ids": [1, 2]}
    rows_ = [base, {**base, "inverts": [("E", '8"', None, 1.0, [2])]}, {**base, "source_text_ids": [2, 1]}, {**base, "notes": ""}, {**base, "ingested_at": day(3)}, {**base, "rim_elevation": 1.0}]
    assert rows(E.copies(keyed(spark, [{"obs_id": i, **r} for i, r in enumerate(rows_)])), "first_id", "copy_id") == [(0, 4)]


def test_hot_groups_give_the_same_rows(spark):
    rng = random.Random(2)
    data = [{"obs_id": i, "offset_txt": "5' LT" if i % 2 else f"{rng.randint(1, 30)}' LT"} for i in range(200)]
    df = keyed(spark, data)
    cold = rows(E.copies(df, hot_share=1.0))
    groups = defaultdict(list)
    for r in data:
        groups[r["offset_txt"]].append(r["obs_id"])
    assert cold == rows(E.copies(df)) == sorted([("structure", min(g), i) for g in groups.values() for i in g if i != min(g)], key=repr)
    assert rows(E.collapse(df), "first_id", "copies") == sorted([(min(g), len(g)) for g in groups.values()], key=repr)


def test_empty_and_long_and_extra_columns(spark):
    assert keyed(spark).count() == 0 and E.copies(keyed(spark)).count() == 0 and E.collapse(keyed(spark)).count() == 0
    s = make(spark, "structures", [{"obs_id": i, "notes": "n" * 200_000} for i in (1, 2)])
    clash = s.withColumn("key", F.lit(1)).withColumn("kind", F.lit("q")).withColumn("first_id", F.col("obs_id"))
    df = E.with_key(clash, "obs_id", ["ingested_at", "first_id"], ["offset_txt"]).withColumn("kind", F.lit("structure"))
    assert rows(E.copies(df), "first_id", "copy_id") == [(1, 2)]


def test_hot_keys_of_a_small_table_stay_bounded(spark):
    got = E.copies(spark.createDataFrame([(i, bytes([i // 3]), "pipe") for i in range(150)], "id bigint, key binary, kind string"))
    assert got.count() == 100


def test_letters_stay_in_their_word_and_marks_with_their_number(spark):
    sizes = ["8' 6\"", "6' 8\"", "6\" 8'", "8'-6\"", "P.V.C", "pvc", "CPV", "DIP", "PID", "Ductile Iron", "iron, DUCTILE", '8 "', '" / 8', "8'", "1,200 mm", "1200MM", "poly.chloride", "chloride poly", '1/2"', '2/1"']
    df = keyed(spark, pipes=[{"pipe_id": i, "size": s} for i, s in enumerate(sizes)])
    assert rows(E.copies(df), "first_id", "copy_id") == sorted([(0, 2), (0, 3), (4, 5), (9, 10), (11, 12), (14, 15), (16, 17)], key=repr)
