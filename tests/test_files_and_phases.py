import json
import os

import pytest

from culvert.plans import pipeline
from culvert.sources import json_files, sinks
from culvert.streaming import deliveries
from tests.tables import day, make, rows

TILE = {
    "tile_id": "p9_r1_c2", "page_number": 9, "sheet_type": "plan_view", "utility_types_present": ["SS"],
    "structures": [{"id": "SSMH-31", "structure_type": "SSMH", "station": "52+07.60", "offset": "6.25' LT", "inverts": [], "is_existing": True, "source_text_ids": [3, 4, 9]}],
    "pipes": [{"pipe_type": "SS", "size": '8"', "length_lf": 212.5, "slope": 0.0135, "to_station": "52+07.60", "to_structure_hint": "SSMH-31", "source_text_ids": [17]}],
    "callouts": [],
}


@pytest.fixture
def folder(tmp_path):
    for name, body in (("p9_r1_c2.json", TILE), ("p9_r1_c2.json.meta.json", {"page_number": 9, "status": "ok", "sanitized": False, "coherence_score": 0.9}), ("summary.json", {"a": 1})):
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text('{"a": ')
    return str(tmp_path)


def test_folder_to_network(spark, folder):
    from culvert.plans.network import build_network

    e, s = json_files.extraction_files(spark, folder), json_files.state_files(spark, folder)
    assert rows(s, "tile_id", "status") == [("p9_r1_c2", "ok")]
    t = json_files.tables_of(e, s, "P")
    n = build_network(t["structures"], t["pipes"], t["tiles"])
    assert rows(n.edges, "from_orphan", "to_conf", "edge_id") == [(True, "high", "SS:e0:p9_r1_c2")]
    assert n.nodes.count() == 1
    html = pipeline.report.html_report(n, "P", os.path.join(folder, "r.html"))
    assert "SSMH 52+07.60" in open(html).read().replace("</td><td>", " ")
    line = sinks.network_json(n.nodes, n.edges).filter("part = 'node'").first()["json"]
    back, _ = sinks.network_from_json(sinks.network_json(n.nodes, n.edges), n.nodes.schema, n.edges.schema)
    assert rows(back, "node_id", "station_ft") == rows(n.nodes, "node_id", "station_ft")
    assert json.loads(line)["node_id"] == "SS:9:SSMH:5207.60:-6.25"


def test_loose_files_leave_out_what_is_corrupt(spark, folder):
    assert rows(json_files.loose_files(spark, folder, "a int", ("p9_r1_c2.json",)), "file_name", "a") == [("summary.json", 1)]


def test_sinks(spark, tmp_path):
    assert sinks.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert len(sinks.canonical_digest([1])) == 64
    path = str(tmp_path / "x.json")
    sinks.write_small_json({"a": 1}, path)
    with pytest.raises(TypeError):
        sinks.write_small_json({"a": object()}, path)
    assert json.load(open(path)) == {"a": 1} and os.listdir(tmp_path) == ["x.json"]
    df = spark.createDataFrame([(1, "z")], "b int, a string")
    assert df.select(sinks.canonical_column(df).alias("j")).first()["j"] == '{"a":"z","b":1}'
    nested = spark.createDataFrame([(None, [(2, "y")])], "z string, a array<struct<q:int,b:string>>")
    assert nested.select(sinks.canonical_column(nested).alias("j")).first()["j"] == '{"a":[{"b":"y","q":2}],"z":null}'
    sinks.write_json(df, str(tmp_path / "out"), ["b"])
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    digests = json_files.file_digests(spark, path)
    assert digests.count() == 1


def test_pairs_and_tiers(spark):
    tiles = make(spark, "tiles", [{"tile_id": "a"}, {"tile_id": "b"}])
    paired, missing = json_files.pair_with_layers(tiles, make(spark, "text_layers", [{"layer_id": 1, "tile_id": "a"}, {"layer_id": 2, "tile_id": "a"}]))
    assert rows(paired, "tile_id") == [("a",)] and rows(missing, "tile_id") == [("b",)]
    sheets = make(spark, "sheets", [{"revision": 0, "model_tier": "fast", "registered_at": day(0)}, {"revision": 1, "model_tier": "premium", "registered_at": day(1)}, {"page_number": 2}])
    assert rows(json_files.page_tiers(sheets), "page_number", "model_tier") == [(1, "premium"), (2, "standard")]


def test_phases_resume(spark, tmp_path):
    data, out = tmp_path / "data", str(tmp_path / "out")
    for name, r in (("structures", [{"obs_id": 1, "structure_type": "SDMH", "station": "1+00", "offset_txt": "5' RT"}]), ("pipes", []), ("tiles", [{"status": "ok"}]), ("text_layers", [])):
        make(spark, name, r).write.parquet(str(data / f"{name}.parquet"))
    first = pipeline.run(spark, str(data), out)
    assert set(first["phases"].values()) == {"done"}
    assert spark.read.parquet(f"{out}/findings").count() == 1
    assert set(pipeline.run(spark, str(data), out)["phases"].values()) == {"skipped"}
    with pytest.raises(pipeline.GateFailed):
        pipeline.run(spark, str(data), out, gate=True)


def test_streamed_status_windows(spark, tmp_path):
    src = str(tmp_path / "tiles")
    make(spark, "tiles", [{"status": "ok", "ingested_at": day(0)}, {"status": "odd", "ingested_at": day(0)}, {"status": "ok", "ingested_at": day(9)}]).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = deliveries.status_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["status"], r["deliveries"]) for r in spark.table("windows").collect()} >= {("ok", 1), ("runtime_error", 1)}


def test_rebuild_touches_named_plan_sets_only(spark):
    mh = {"structure_type": "SDMH", "station": "1+00", "offset_txt": "5' RT"}
    s = make(spark, "structures", [{**mh, "obs_id": 1}, {**mh, "obs_id": 2, "plan_id": "Q"}])
    tiles, seen = make(spark, "tiles", [{"plan_id": "Q"}]), []
    deliveries.rebuild_on_delivery(s, make(spark, "pipes", []), tiles, lambda n, i: seen.append((i, rows(n.nodes, "plan_id"))))(tiles, 4)
    assert seen == [(4, [("Q",)])]
