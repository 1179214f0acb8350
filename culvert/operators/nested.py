"""Deeply nested, drifting JSON records turned into related flat tables.

One depth-first traversal of a payload gives every object of interest an interval label
``(pre, post)``: a node lies below another exactly if its interval lies within the other's.
A structural join over the labels (one pass in ``pre`` order with a stack of open intervals)
links each node to its nearest enclosing parent and numbers it in reading order within that
parent, whatever lists, maps, wrappers or quoted JSON stand between.  A payload is one row,
so labelling and linking need no shuffle; the labels are kept in the node tables, so later
containment joins can be made in SQL (``a.pre < d.pre and d.post < a.post`` on the record id).

Edge cases: null, empty and blank payloads and payloads whose JSON breaks off give no rows;
a byte-order mark, a code fence or prose around the JSON is skipped; keys repeated within
one object are all kept, in reading order; nulls and texts where an object belongs take no
position; numbers that are not finite are no ids, whole numbers beyond 64 bits keep their position with
a null id; half surrogate pairs become U+FFFD; repeated payloads are flattened once per record id; extra
columns are carried along by id only.  Payloads that cannot be read are listed by ``rejected_records``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.runtime import durable

NODE_SCHEMA = (
    "raw_id bigint, child_kind string, pre int, post int, parent_path string, pos int, "
    "type string, direction string, size string, station string, lateral string, elevation double, ref_id bigint, label string"
)

#: What may enclose what: kind -> kinds of the direct parent ('' is the record itself).
PARENT_OF = {"structure": "", "item": "", "invert": "structure", "text_ref": "invert"}


class Pairs(list):
    """A JSON object as its (key, value) pairs, so that repeated keys survive."""

    def get(self, key: str):
        return next((v for k, v in self if k == key), None)

    def has(self, key: str) -> bool:
        return any(k == key for k, _ in self)


LONGEST_NUMBER = 4_000
ROWS_A_BATCH = 20_000


def _integer(digits: str) -> int:
    """Value of a JSON integer; of one beyond the length Python reads, only that it is huge is kept."""
    return int(digits[:LONGEST_NUMBER])


_DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_int=_integer, strict=False)


def read_payload(text: str | None):
    """The JSON value in a model's reply, or None if there is none or it breaks off."""
    if not text:
        return None
    text = text.lstrip("﻿ \t\r\n")
    if text[:1] == '"':
        try:
            inner, _ = _DECODER.raw_decode(text)
        except ValueError:
            return None
        return read_payload(inner) if isinstance(inner, str) else None
    start = min((p for p in (text.find("{"), text.find("[")) if p >= 0), default=-1)
    if start < 0:
        return None
    try:
        return _DECODER.raw_decode(text, start)[0]
    except RecursionError:
        return _deep_value(text, start)
    except ValueError:
        return None


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity", re.ASCII)


def _deep_value(text: str, at: int):
    """What the decoder would read at ``at``, on an explicit stack: for nesting beyond its recursion limit."""
    top: list = []
    # open containers, each with the key its next value belongs to
    open_: list[tuple[list, str | None]] = [(top, None)]
    first = True
    while True:
        at = _SPACE.match(text, at).end()
        box, key = open_[-1]
        ch = text[at : at + 1]
        if box is not top and ch == ("}" if isinstance(box, Pairs) else "]"):
            open_.pop()
            at += 1
            first = False
            if len(open_) == 1:
                return top[0]
            continue
        if box is not top and not first:
            if ch != ",":
                return None
            at = _SPACE.match(text, at + 1).end()
        try:
            if isinstance(box, Pairs):
                if text[at : at + 1] != '"':
                    return None
                key, at = json.decoder.scanstring(text, at + 1, False)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    return None
                at = _SPACE.match(text, at + 1).end()
            ch, inner = text[at : at + 1], None
            if ch in ("{", "["):
                value = inner = Pairs() if ch == "{" else []
                at += 1
            elif ch == '"':
                value, at = json.decoder.scanstring(text, at + 1, False)
            else:
                m = _SCALAR.match(text, at)
                if m is None:
                    return None
                value, at = _DECODER.decode(m.group()), m.end()
        except ValueError:
            return None
        box.append((key, value) if isinstance(box, Pairs) else value)
        first = inner is not None
        if inner is not None:
            open_.append((inner, None))


def _quoted(text: str):
    """A value quoted as text, if the text is a JSON list or object; else None."""
    return read_payload(text) if text.lstrip()[:1] in ("{", "[") else None


def _number(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError, OverflowError):
        return None


_SURROGATE = re.compile("[\ud800-\udfff]")


def _text(value) -> str | None:
    """A scalar as text; half a surrogate pair, which no encoding can store, becomes U+FFFD."""
    if value is None or isinstance(value, list):
        return None
    if isinstance(value, int) and value.bit_length() > 64:
        return None
    return _SURROGATE.sub("\ufffd", str(value))


def _span_id(value: int) -> int | None:
    return value if -(2**63) <= value < 2**63 else None


def _ref_ids(value) -> list[int | None]:
    """Span ids in reading order from numbers, numeric texts, id objects, lists of these and quoted lists.

    A whole number beyond 64 bits keeps its position, with a null id; a number that is not finite is no id.
    """
    ids: list[int | None] = []
    work = [value]
    while work:
        x = work.pop()
        if isinstance(x, Pairs):
            work.extend(v for _, v in reversed(x))
        elif isinstance(x, list):
            work.extend(reversed(x))
        elif isinstance(x, str):
            ids += [_span_id(_integer(i)) for i in re.findall(r"(?<![\w.])-?\d+(?![\w.])", x)]
        elif isinstance(x, float):
            ids += [_span_id(int(x))] if math.isfinite(x) and x == int(x) else []
        elif isinstance(x, int) and not isinstance(x, bool):
            ids.append(_span_id(x))
    return ids


def label_nodes(value, record_kind: str | None) -> list[dict]:
    """Depth-first traversal: nodes of interest with pre- and post-order numbers of one common clock."""
    nodes: list[dict] = []
    clock = 0

    def tick() -> int:
        nonlocal clock
        clock += 1
        return clock

    # explicit stack of pending work, so that depth is bounded by memory only
    work: list[tuple] = [("visit", value, False)]
    while work:
        what, x, below = work.pop()
        if what == "close":
            x["post"] = tick()
            continue
        if what == "refs":
            for i in _ref_ids(x):
                pre = tick()
                nodes.append({"child_kind": "text_ref", "pre": pre, "post": tick(), "ref_id": i})
            continue
        if isinstance(x, str):
            x = _quoted(x)
        if isinstance(x, Pairs):
            node = None
            if x.has("structure_type"):
                node = {"child_kind": "structure", "type": _text(x.get("structure_type")), "size": _text(x.get("size")), "station": _text(x.get("station")), "lateral": _text(x.get("offset")), "label": _text(x.get("id"))}
                inner = True
            elif below and x.has("elevation"):
                node = {"child_kind": "invert", "direction": _text(x.get("direction")), "size": _text(x.get("pipe_size")), "type": _text(x.get("pipe_type")), "elevation": _number(x.get("elevation"))}
                inner = below
            elif record_kind == "text_layer" and x.has("text"):
                node = {"child_kind": "item", "label": _text(x.get("text")), "ref_id": next(iter(_ref_ids(x.get("text_id"))), None)}
                inner = below
            else:
                inner = below
            if node is not None:
                node["pre"] = tick()
                nodes.append(node)
                work.append(("close", node, below))
            for k, v in reversed(x):
                if node is not None and node["child_kind"] == "invert" and k == "source_text_ids":
                    work.append(("refs", v, inner))
                elif isinstance(v, (list, str)):
                    work.append(("visit", v, inner))
        elif isinstance(x, list):
            work.extend(("visit", v, below) for v in reversed(x) if isinstance(v, (list, str)))
    return nodes


def link_by_containment(nodes: list[dict]) -> list[dict]:
    """Structural join of interval-labelled nodes: ``parent_path`` and ``pos`` from the nearest enclosing parent."""
    open_: list[dict] = []
    counts: dict[tuple, int] = {}
    for n in sorted(nodes, key=lambda n: n["pre"]):
        while open_ and open_[-1]["post"] < n["pre"]:
            open_.pop()
        want = PARENT_OF[n["child_kind"]]
        parent = next((a for a in reversed(open_) if a["child_kind"] == want), None) if want else None
        if want and parent is None:
            n["parent_path"] = None
            continue
        n["parent_path"] = "" if parent is None else f"{parent['parent_path']}.{parent['pos']}".lstrip(".")
        slot = (n["child_kind"], n["parent_path"])
        n["pos"] = counts.get(slot, 0)
        counts[slot] = n["pos"] + 1
        open_.append(n)
    return [n for n in nodes if n["parent_path"] is not None]


def flatten_records(raw: DataFrame) -> DataFrame:
    """All nodes of all payloads, one row each, labelled and linked."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in NODE_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            # payload by payload, so that only one of them stands beside the rows of a batch
            for i in range(batch.num_rows):
                raw_id, kind, payload = (batch.column(c)[i].as_py() for c in range(3))
                value = read_payload(payload)
                if value is not None:
                    for n in link_by_containment(label_nodes(value, kind)):
                        out.append({"raw_id": raw_id, **n})
                        if len(out) >= ROWS_A_BATCH:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return raw.filter("payload is not null").select(F.col("raw_id").cast("bigint"), "record_kind", "payload").mapInArrow(run, NODE_SCHEMA)


def rejection(payload: str | None) -> str | None:
    """Why a payload gives no rows; None if it can be read."""
    if payload is None or not payload.strip("\ufeff \t\r\n"):
        return "empty"
    if "{" not in payload and "[" not in payload:
        return "no object"
    return "breaks off" if read_payload(payload) is None else None


def rejected_records(raw: DataFrame) -> DataFrame:
    """``(raw_id, reason)`` of every record whose payload gives no rows because it cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [rejection(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            keep = [i for i, r in enumerate(reasons) if r]
            ids = batch.column(0).take(pa.array(keep, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([reasons[i] for i in keep], type=pa.string())], names=["raw_id", "reason"])

    return raw.select(F.col("raw_id").cast("bigint"), "payload").mapInArrow(run, "raw_id bigint, reason string")


def node_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of all node types from one traversal, which is materialised once."""
    nodes = durable(flatten_records(raw))
    return {kind: node_table(nodes, kind) for kind in PARENT_OF}


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one node type with its parent link."""
    fields = {
        "structure": ["type", "size", "station", "lateral", "label"],
        "invert": ["direction", "size", "type", "elevation"],
        "text_ref": ["ref_id"],
        "item": ["ref_id", "label"],
    }[kind]
    return nodes.filter(F.col("child_kind") == kind).select("raw_id", "parent_path", "pos", "pre", "post", *fields)
