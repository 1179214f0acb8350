"""Ordered report relations and the HTML page written from them.

The relations are plain DataFrames; ordering columns are part of them.  Only ``html_report`` brings rows to the
driver, for one plan set, streamed partition by partition into the file, so the driver never holds a whole table.

Edge cases: absent values are shown as ``-``; records without a station come last; unknown severities rank 99.
"""

from __future__ import annotations

import html
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions import scalars as S
from culvert.runtime import collect_bounded


def _shown(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))


def _fixed(c: Column, places: int) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{places}f", c.cast("double")))


def findings_report(findings: DataFrame) -> DataFrame:
    """Findings with their rank; order by plan_id, rank, utility, finding_type, description."""
    mark = F.when(F.col("extraction_confidence") == "low", F.concat("finding_type", F.lit(" [VERIFY]"))).otherwise(F.col("finding_type"))
    return findings.select(
        "plan_id", S.severity_rank(F.col("severity")).alias("rank"), "utility", mark.alias("finding"), "severity", "description", F.array_join(F.transform("source_sheets", lambda p: p.cast("string")), ", ").alias("pages"), "extraction_confidence", "check_confidence"
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("plan_id", "severity").agg(F.count("*").alias("n"))


def structure_schedule(nodes: DataFrame) -> DataFrame:
    """One row per structure; order by plan_id, utility, station_ft (null last), node_id."""
    inverts = F.array_join(F.transform("inverts", lambda i: F.when(i["elevation"].isNull(), F.upper(F.coalesce(i["direction"], F.lit("?")))).otherwise(F.concat(F.upper(F.coalesce(i["direction"], F.lit("?"))), F.lit(":"), F.format_string("%.2f", i["elevation"])))), ", ")
    return nodes.select(
        "plan_id", "utility", "node_id", "station_ft", _shown(F.col("station")).alias("station"), _shown(F.col("offset")).alias("offset"), _shown(F.col("structure_type")).alias("structure_type"), _shown(F.col("size")).alias("size"),
        _fixed(F.col("rim_elevation"), 2).alias("rim"), _shown(inverts).alias("inverts"), _shown(F.col("notes")).alias("notes"),
        F.format_string("pg %d, %d tile(s)", "page_number", F.size("source_tile_ids")).alias("provenance"),
    )


def pipe_schedule(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per pipe with at least one resolved end; order by plan_id, utility, station, edge_id."""
    for end, key in (("u", "from_node"), ("v", "to_node")):
        label = F.concat_ws(" ", F.nullif(F.upper(F.trim("structure_type")), F.lit("")), F.nullif(F.trim("station"), F.lit("")))
        side = nodes.select("plan_id", "utility", F.col("node_id").alias(key), F.nullif(label, F.lit("")).alias(f"{end}_label"))
        edges = edges.join(side, ["plan_id", "utility", key], "left")
    shown = lambda end, key, orphan: F.when(F.col(orphan), "ORPHAN").otherwise(F.coalesce(f"{end}_label", key))
    confidence = F.when(F.col("oriented_by_gravity"), F.concat("matched_conf", F.lit("; gravity-oriented"))).otherwise(F.col("matched_conf"))
    return edges.filter("not (from_orphan and to_orphan)").select(
        "plan_id", "utility", "edge_id", shown("u", "from_node", "from_orphan").alias("from_label"), shown("v", "to_node", "to_orphan").alias("to_label"), _shown(F.col("size")).alias("size"),
        _fixed(F.col("length_lf"), 2).alias("length"), _fixed(F.col("slope"), 4).alias("slope"), _shown(F.col("material")).alias("material"), confidence.alias("confidence"),
    )


def batch_results(tiles: DataFrame) -> DataFrame:
    """Per-tile results of the extraction batch, with what the sanitizer dropped."""
    d = F.col("dropped_invalid_counts")
    parts = F.array_compact(F.array(*[F.when(d[k] > 0, F.concat(F.lit(f"{k}="), d[k].cast("string"))) for k in ("structures", "pipes", "inverts", "callouts")]))
    yes = F.when(F.size(parts) > 0, F.concat(F.lit("yes ("), F.array_join(parts, ", "), F.lit(")"))).otherwise("yes")
    return tiles.select(
        "plan_id", "tile_id", _fixed(F.col("coherence_score"), 3).alias("coherence"), *[F.coalesce(f"{k}_count", F.lit(0)).alias(k) for k in ("structures", "pipes", "callouts")],
        F.when(F.coalesce("sanitized", F.lit(False)), yes).otherwise("no").alias("sanitized"),
    )


def batch_totals(tiles: DataFrame) -> DataFrame:
    """Pages, tiles and cost per plan set and model."""
    return tiles.groupBy("plan_id", "model").agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("tiles"), F.round(F.sum("usage_cost"), 6).alias("total_cost"))


def _table(title: str, columns: list[str], rows: Iterator) -> Iterator[str]:
    """The pieces of a table, row by row."""
    esc = lambda v: html.escape("-" if v is None else str(v))
    yield f"<h2>{esc(title)}</h2><table><thead><tr>{''.join(f'<th>{esc(c)}</th>' for c in columns)}</tr></thead><tbody>"
    empty = True
    for r in rows:
        empty = False
        yield "<tr>" + "".join(f"<td>{esc(r[c])}</td>" for c in columns) + "</tr>"
    yield ("<tr><td>none</td></tr>" if empty else "") + "</tbody></table>"


def _pieces(network, plan_id: str) -> Iterator[str]:
    one = lambda df: df.filter(F.col("plan_id") == plan_id)
    yield f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(plan_id)}</title></head><body><h1>{html.escape(plan_id)}</h1>"
    q = collect_bounded(one(network.quality), 1, "quality rows")
    if q and q[0]["bad_ratio"] > 0.30:
        yield "<p class='risk'>Extraction quality is low; findings may be incomplete.</p>"
    findings = one(network.findings())
    for title, df, order in (
        ("Findings", findings_report(findings), ["rank", "utility", "finding", "description"]),
        ("Severities", severity_counts(findings), ["severity"]),
        ("Structures", structure_schedule(one(network.nodes)), [F.asc_nulls_last("station_ft"), "node_id"]),
        ("Pipes", pipe_schedule(one(network.edges), one(network.nodes)), ["utility", "edge_id"]),
    ):
        columns = [c for c in df.columns if c not in ("plan_id", "rank", "station_ft")]
        yield from _table(title, columns, df.orderBy(*order).toLocalIterator())
    yield "</body></html>"


def html_report(network, plan_id: str, path: str) -> str:
    """The report page of one plan set, written whole or not at all; rows are streamed, whatever their number."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.writelines(_pieces(network, plan_id))
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return path
