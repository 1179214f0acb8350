import os
import random

import pytest
from pyspark.sql import functions as F

from culvert.llm import tokens as T
from tests.tables import make, rows

PATH = os.path.join(T.DEFAULT_DIRECTORY, T.DEFAULT_VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def content():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.DEFAULT_DIRECTORY, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_against_the_library(content, library):
    enc, rng = T.ForcedBoundaryEncoder(content), random.Random(1)
    alphabet = list("ab'sS !?  \n\t\r 　é中👍#$\"'9½~`|\x85 \x0b<|endoftext|>ЖÅ%&/()=^°")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert enc(text) == library(text), text
    for text in ("It's 12\" RCP at 10+06.87; we'll re-lay.", "'s", "a'S", " ", "\n\n ", "Größe µ³", "a" * 5000, "!#" * 3000 + " x"):
        assert enc(text) == library(text)
        assert T.round_trip_text(enc(text), content) == text


def test_cuts_are_never_inside_a_token(content):
    ranks = T.read_ranks(content)
    cuts = T.certain_cuts(ranks)
    assert cuts.sum() > 5000
    assert not any(cuts[t[i], t[i + 1]] for t in ranks for i in range(len(t) - 1))
    enc = T.ForcedBoundaryEncoder(content)
    parts = enc.fragments("97.38% of #4 at (E)~{x}")
    assert len(parts) > 1 and "".join(parts) == "97.38% of #4 at (E)~{x}"


def test_rows(spark, library):
    texts = [None, "", " ", "plain", "plain", "<|endoftext|>", "long " * 40_000]
    docs = make(spark, "documents", [{"doc_id": i, "text": t} for i, t in enumerate(texts)]).withColumn("ids", F.lit("x")).withColumn("tokens", F.lit(0))
    got = dict(rows(T.encode(docs)))
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)}
    assert dict(rows(T.count_tokens(docs, ["source"]), "doc_id", "tokens")) == {i: len(v) for i, v in got.items()}
    assert T.encode(docs.limit(0)).count() == 0
    assert rows(T.corpus_statistics(T.encode(docs)))[0][:2] == (7, 2)
