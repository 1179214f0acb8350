import json

from pyspark.sql import functions as F

from culvert.operators import nested as N
from tests.tables import make, rows

INV = {"direction": "W", "elevation": 1.5, "source_text_ids": [5, 6]}
ST = {"structure_type": "CB", "station": "1+00"}


def flat(spark, payloads, kind="extraction"):
    raw = make(spark, "raw_extractions", [{"raw_id": i, "record_kind": kind, "payload": p if p is None or isinstance(p, str) else json.dumps(p)} for i, p in enumerate(payloads)])
    return N.flatten_records(raw.withColumn("pre", F.lit(1)).withColumn("pos", F.lit("x")))


def found(spark, payload, kind="extraction"):
    return [r[1:] for r in rows(flat(spark, [payload], kind), "raw_id", "child_kind", "parent_path", "pos")]


WHOLE = [("invert", "0", 0), ("invert", "1", 0), ("invert", "1", 1), ("structure", "", 0), ("structure", "", 1), ("text_ref", "0.0", 0), ("text_ref", "0.0", 1), ("text_ref", "1.0", 0), ("text_ref", "1.0", 1), ("text_ref", "1.1", 0), ("text_ref", "1.1", 1)]


def test_shapes_do_not_matter(spark):
    a, b = {**ST, "inverts": [INV]}, {**ST, "inverts": [INV, INV]}
    shapes = [
        {"structures": [a, b]},
        {"result": {"data": {"structures": [[a], [[b]]]}}},
        {"structures": {"s0": a, "s1": {**ST, "inverts": {"N": {"elevation": 2, "source_text_ids": "5, 6"}, "S": INV}}}},
        {"structures": [None, a, "see profile", {**ST, "inverts": [None, "x", INV, [INV]]}]},
        {"structures": [{**ST, "inverts": json.dumps([INV])}, {**ST, "inverts": [{**INV, "source_text_ids": [{"text_id": 5}, None, "n/a", [6]]}, INV]}]},
        [{"structures": [a]}, {"extraction": json.dumps({"structures": [b]})}],
        json.dumps(json.dumps({"structures": [a, b]})),
        "﻿Here it is:\n```json\n" + json.dumps({"structures": [a, b]}, indent=1) + "\n```\ndone",
    ]
    for shape in shapes:
        assert found(spark, shape) == WHOLE, shape


def test_repeated_keys_and_items(spark):
    twice = '{"structures": [{"structure_type": "CB", "inverts": {"N": {"elevation": 1}, "N": {"elevation": 2}}}]}'
    assert found(spark, twice) == [("invert", "0", 0), ("invert", "0", 1), ("structure", "", 0)]
    layer = {"items": [{"block": 0, "items": [{"text_id": 3, "text": "{a"}]}, None, {"text": "b"}]}
    assert found(spark, layer, "text_layer") == [("item", "", 0), ("item", "", 1)]
    assert found(spark, layer) == []


def test_broken_and_empty(spark):
    whole = json.dumps({"structures": [{**ST, "inverts": [INV]}]})
    broken = [None, "", "  ", "no json", whole[:-1], whole[:40], "```json\n" + whole[:-3], "{}", "[]", "null", '"' + whole[:20]]
    assert flat(spark, broken).count() == 0
    assert flat(spark, []).count() == 0
    assert flat(spark, [whole, whole]).count() == 8


def test_deep_and_long(spark):
    deep = "[" * 300 + json.dumps(ST) + "]" * 300
    assert found(spark, deep) == [("structure", "", 0)]
    assert flat(spark, [{"structures": [{**ST, "inverts": [INV] * 50}] * 200}]).count() == 200 + 200 * 50 * 3


def test_labels_hold_the_links(spark):
    nodes = flat(spark, [{"structures": [{**ST, "inverts": [INV]}, {**ST, "inverts": [INV, INV]}]}])
    s, i = N.node_table(nodes, "structure"), N.node_table(nodes, "invert")
    inside = i.alias("d").join(s.alias("a"), (F.col("a.raw_id") == F.col("d.raw_id")) & (F.col("a.pre") < F.col("d.pre")) & (F.col("d.post") < F.col("a.post")))
    assert {(r[0], r[1]) for r in inside.select("d.parent_path", F.col("a.pos").cast("string")).collect()} == {("0", "0"), ("1", "1")}
    assert inside.count() == 3
    assert N.node_table(nodes, "text_ref").count() == 6 and N.node_table(nodes, "item").count() == 0


def test_depth_beyond_the_decoder():
    deep = '{"w":' * 50_000 + json.dumps({**ST, "inverts": [{"elevation": 1.5, "source_text_ids": "@"}]}).replace('"@"', "[" * 50_000 + "7, NaN, -Infinity, 8" + "]" * 50_000) + "}" * 50_000
    nodes = N.link_by_containment(N.label_nodes(N.read_payload(deep), "extraction"))
    assert [(n["child_kind"], n["parent_path"], n["pos"], n.get("ref_id")) for n in nodes] == [("structure", "", 0, None), ("invert", "0", 0, None), ("text_ref", "0.0", 0, 7), ("text_ref", "0.0", 1, 8)]
    assert N.read_payload(deep[:-1]) is None


HARD = [
    "[" * 200_000 + '{"structure_type": "CB"}' + "]" * 200_000,
    '{"structure_type": "CB", "inverts": [{"elevation": 1, "source_text_ids": ' + "[" * 5_000 + "7" + "]" * 5_000 + "}]}",
    '{"structure_type": "CB", "inverts": [{"elevation": NaN, "source_text_ids": [NaN, Infinity, -Infinity, 1e400, 1.5, 3, 123456789012345678901234567890, "9' + "9" * 5_000 + '"]}]}',
    '{"structure_type": "\\ud800x", "id": ' + "8" * 9_000 + ', "inverts": [{"elevation": ' + "7" * 9_000 + ', "source_text_ids": [' + "6" * 9_000 + "]}]}",
    "[" * 3_000,
]


def test_no_payload_fails_a_task(spark):
    df = spark.createDataFrame([(i, "extraction", p) for i, p in enumerate(HARD)], "raw_id bigint, record_kind string, payload string")
    got = {(r["raw_id"], r["child_kind"], r["pos"], r["ref_id"]) for r in N.flatten_records(df).collect()}
    assert {g for g in got if g[1] == "structure"} == {(i, "structure", 0, None) for i in range(4)}
    assert {g for g in got if g[1] == "text_ref"} == {(1, "text_ref", 0, 7), (2, "text_ref", 0, 3), (2, "text_ref", 1, None), (2, "text_ref", 2, None), (3, "text_ref", 0, None)}
    assert [r["type"] for r in N.flatten_records(df).filter("raw_id = 3 and child_kind = 'structure'").collect()] == ["\ufffdx"]


def test_rejected_payloads_are_listed(spark):
    data = [(0, '{"a": 1}'), (1, None), (2, " \n"), (3, "no reply"), (4, '{"a": '), (5, HARD[4]), (6, "```json\n[]\n```")]
    df = spark.createDataFrame(data, "raw_id bigint, payload string")
    assert {tuple(r) for r in N.rejected_records(df).collect()} == {(1, "empty"), (2, "empty"), (3, "no object"), (4, "breaks off"), (5, "breaks off")}


def test_tables_of_one_traversal(spark):
    df = spark.createDataFrame([(1, "extraction", '[{"structure_type": "CB", "inverts": [{"elevation": 1.0, "source_text_ids": [4, 5]}]}]')], "raw_id bigint, record_kind string, payload string")
    tables = N.node_tables(df)
    assert {k: t.count() for k, t in tables.items()} == {"structure": 1, "item": 0, "invert": 1, "text_ref": 2}


def _plain_rows(value, kind):
    """Brute force on payloads without quoting and wrappers: positions by plain recursion."""
    out = []
    counts = {}

    def at(kind_, path):
        n = counts.get((kind_, path), 0)
        counts[kind_, path] = n + 1
        return n

    def walk(x, structure):
        if isinstance(x, list):
            for y in x:
                walk(y, structure)
        elif isinstance(x, dict):
            if "structure_type" in x:
                n = at("structure", "")
                out.append(("structure", "", n))
                structure = str(n)
            elif structure is not None and "elevation" in x:
                n = at("invert", structure)
                out.append(("invert", structure, n))
                for _ in x.get("source_text_ids") or []:
                    out.append(("text_ref", f"{structure}.{n}", at("text_ref", f"{structure}.{n}")))
                x = {k: v for k, v in x.items() if k != "source_text_ids"}
            elif kind == "text_layer" and "text" in x:
                out.append(("item", "", at("item", "")))
            for y in x.values():
                walk(y, structure)

    walk(value, None)
    return sorted(out)


def test_planted_payloads_against_brute_force(spark):
    import json
    import random

    rng = random.Random(5)

    def tree(depth):
        kind = rng.choice(["structure", "invert", "item", "list", "wrap", "leaf"])
        if depth == 0 or kind == "leaf":
            return rng.choice([None, 1, "x", True, {}, []])
        below = [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == "structure":
            return {"structure_type": "CB", "inverts": below}
        if kind == "invert":
            return {"elevation": 1.5, "source_text_ids": [rng.randint(0, 99) for _ in range(rng.randint(0, 3))], "more": below}
        return {"text": "t", "rest": below} if kind == "item" else (below if kind == "list" else {"w": below})

    trees = [(i, rng.choice(["extraction", "text_layer"]), [tree(6) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([(i, k, json.dumps(t)) for i, k, t in trees], "raw_id bigint, record_kind string, payload string")
    got = {}
    for r in N.flatten_records(df).collect():
        got.setdefault(r["raw_id"], []).append((r["child_kind"], r["parent_path"], r["pos"]))
    for i, k, t in trees:
        assert sorted(got.get(i, [])) == _plain_rows(t, k), t
