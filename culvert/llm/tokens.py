"""A whole corpus encoded with a public byte-level BPE tokenizer.

Forced boundaries: a pair of neighbouring bytes that occurs inside no vocabulary token can never
be merged across, so it is a certain cut.  The table of the 65,536 byte pairs is computed from the
vocabulary.  Texts are cut at such pairs (only between two visible characters, so that
the splitting rule on white space and contractions sees the same neighbours on both sides),
the fragments are encoded independently, and their ids are concatenated.

The vocabulary file is read once on the driver from a path given as a parameter and broadcast
(0.8 MB, fixed); rows are encoded in a narrow stage of Arrow batches.

Edge cases: an empty and a null text give the empty list; blank texts are encoded as they are; very long
texts are encoded whole; strings of special tokens are ordinary text; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIRECTORY = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the splitting rule that belongs to the vocabulary.
SPLIT_RULE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """Boolean table over (left byte, right byte): a cut between them is certain and safe."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
    byte = np.arange(256)
    visible = (byte > 0x20) & (byte < 0x7F)
    # starts of characters that cannot be white space; an apostrophe could begin a contraction
    start = (visible & (byte != 0x27)) | ((byte >= 0xC3) & (byte <= 0xDF)) | ((byte >= 0xE4) & (byte <= 0xF4))
    return ~inside & visible[:, None] & start[None, :]


class ForcedBoundaryEncoder:
    """Encodes one text; fragments are remembered while they are few."""

    REMEMBERED, SHORT = 50_000, 64

    def __init__(self, content: bytes, split_rule: str = SPLIT_RULE):
        import tiktoken

        ranks = read_ranks(content)
        self.cuts = certain_cuts(ranks)
        self.plain = tiktoken.Encoding("public", pat_str=split_rule, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memory: dict[str, list[int]] = {}

    def fragments(self, text: str) -> list[str]:
        raw = text.encode("utf-8")
        if len(raw) < 2:
            return [text] if text else []
        b = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero(self.cuts[b[:-1], b[1:]]) + 1
        if not len(at):
            return [text]
        ends = [*at.tolist(), len(raw)]
        return [raw[i:j].decode("utf-8") for i, j in zip([0, *ends], ends)]

    def _fragment(self, text: str) -> list[int]:
        if len(text) > self.SHORT:
            return self.plain(text)
        ids = self.memory.get(text)
        if ids is None:
            if len(self.memory) >= self.REMEMBERED:
                self.memory.clear()
            ids = self.memory[text] = self.plain(text)
        return ids

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for f in self.fragments(text):
            out += self._fragment(f)
        return out


_encoders: dict[tuple, ForcedBoundaryEncoder] = {}


def _encoder(content: bytes, split_rule: str) -> ForcedBoundaryEncoder:
    """One encoder per Python worker and vocabulary."""
    key = (hash(content), split_rule)
    if key not in _encoders:
        _encoders[key] = ForcedBoundaryEncoder(content, split_rule)
    return _encoders[key]


def encode(docs: DataFrame, *, directory: str = DEFAULT_DIRECTORY, vocabulary: str = DEFAULT_VOCABULARY, split_rule: str = SPLIT_RULE) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs (doc_id, text)``."""
    with open(os.path.join(directory, vocabulary), "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(content.value, split_rule)
        for batch in batches:
            texts, sizes, values = batch.column(1), [0], []
            for i in range(len(texts)):
                ids = enc(texts[i].as_py())
                values.append(np.asarray(ids, dtype=np.int32))
                sizes.append(sizes[-1] + len(ids))
            flat = np.concatenate(values) if values else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(sizes, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], *, directory: str = DEFAULT_DIRECTORY, vocabulary: str = DEFAULT_VOCABULARY, split_rule: str = SPLIT_RULE) -> DataFrame:
    """``(doc_id, keep..., tokens)``: sizes only, so the ids never leave the worker."""
    with open(os.path.join(directory, vocabulary), "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select("doc_id", "text", *keep)
    schema = ", ".join(["doc_id bigint", *(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:]), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(content.value, split_rule)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([len(enc(texts[i].as_py())) for i in range(len(texts))], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[2:], n], names=["doc_id", *batch.schema.names[2:], "tokens"])

    return source.mapInArrow(run, schema).select("doc_id", *keep, "tokens")


def round_trip_text(ids: list[int], content: bytes) -> str:
    """Text of a list of ids (for exact round-trip tests)."""
    by_id = {i: t for t, i in read_ranks(content).items()}
    return b"".join(by_id[i] for i in ids).decode("utf-8")


def corpus_statistics(encoded: DataFrame) -> DataFrame:
    """Documents, empty ones and tokens of an encoded corpus."""
    n = F.size("ids")
    return encoded.agg(F.count("*").alias("documents"), F.count_if(n == 0).alias("empty"), F.sum(n).cast("bigint").alias("tokens"))
