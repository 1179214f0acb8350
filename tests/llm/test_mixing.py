import random

import pytest
from pyspark.sql import functions as F

from culvert.llm import mixing as M
from tests.tables import make, rows

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("none", 0.1, 4), ("zero", None, None)]


def test_flow_repeats_only_what_it_must():
    total, flows = M.plan_mix({("a",): 1000, ("b",): 100}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert total in (600, 601) and flows == {(("a",), "a"): 300, (("b",), "b"): 300}
    assert M.plan_mix({}, {"a": (1.0, 1)}) == (0, {})


def test_flow_shares_overlapping_documents():
    total, flows = M.plan_mix({("a", "b"): 100, ("a",): 50}, {"a": (0.5, 1), "b": (0.5, 1)})
    assert total == 150 and flows[("a", "b"), "b"] == 75 and sum(flows.values()) == 150


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(4)
    rows_ = [(i, rng.choice("aaaaabbc"), rng.randint(1, 60)) for i in range(3000)]
    rows_ += [(9001, None, 5), (9002, "other", 5), (9003, "a", 0), (9004, "zero", 9)]
    return spark.createDataFrame(rows_, "doc_id bigint, source string, tokens bigint").withColumn("pattern", F.lit("x"))


def test_shares_are_met_and_caps_hold(spark, sized):
    targets = make(spark, "mix_targets", [dict(zip(("source_name", "target_share", "max_repeats"), t)) for t in TARGETS])
    chosen = M.choose(sized.select("doc_id", "source", "tokens"), targets)
    got = rows(chosen)
    assert got == rows(M.choose(sized.select("doc_id", "source", "tokens"), targets)) != rows(M.choose(sized.select("doc_id", "source", "tokens"), targets, seed=8))
    assert len({g[0] for g in got}) == len(got) and not {9001, 9002, 9003, 9004} & {g[0] for g in got}
    most = {s: m for s, _, m in TARGETS}
    assert all(1 <= r <= most[s] for _, s, _, r in got)
    actual = {r["source_name"]: r["actual_share"] for r in M.shares(chosen, targets).collect()}
    # the share of the source without documents goes to the others in proportion
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert actual[s] == pytest.approx(share, abs=0.003)
    assert actual["none"] == actual["zero"] == 0
    total = sum(t * r for _, _, t, r in got)
    whole = {s: sum(r["tokens"] for r in sized.collect() if r["source"] == s) for s in "abc"}
    assert total == pytest.approx(min(whole[s] * most[s] / share for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9))), rel=0.005)


def test_empty(spark, sized):
    targets = make(spark, "mix_targets", [{"source_name": "a", "target_share": 1.0, "max_repeats": 2}])
    assert M.choose(sized.select("doc_id", "source", "tokens").limit(0), targets).count() == 0
    assert M.choose(sized.select("doc_id", "source", "tokens"), targets.limit(0)).count() == 0


def test_documents(spark):
    docs = make(spark, "documents", [{"doc_id": 1, "text": "one two", "source": "a"}, {"doc_id": 2, "text": None, "source": "a"}, {"doc_id": 3, "text": "", "source": None}])
    assert rows(M.sized_documents(docs.withColumn("tokens", F.lit("x"))), "doc_id", "tokens") == [(1, 2), (2, 0), (3, 0)]


def test_many_allowed_repeats_stay_a_small_network():
    bands = M.use_bands(1_000_000)
    assert sum(n for _, n in bands) == 1_000_000 and len(bands) < 40 and bands[:3] == [(0, 1), (1, 1), (2, 1)]
    assert all(a < b for (a, _), (b, _) in zip(bands, bands[1:]))
    total, flows = M.plan_mix({("a",): 10, ("b",): 1_000}, {"a": (0.5, 1_000_000), "b": (0.5, 1)})
    assert total in (2_000, 2_001) and flows == {(("a",), "a"): 1_000, (("b",), "b"): 1_000}


def test_texts_of_several_sources_belong_to_all_of_them(spark):
    docs = [(1, "x y", "b"), (2, "x y", "a"), (3, "x y", "a"), (4, "x z", "a"), (5, "x z", "a"), (6, "X y", "b"), (7, "x y", None), (8, "x z", "zero"), (9, "x y", "c")]
    sized = M.sized_documents(make(spark, "documents", [dict(zip(("doc_id", "text", "source"), d)) for d in docs]))
    got = M.memberships(sized.filter("source in ('a', 'b', 'c')"), ["a", "b", "c"])
    assert rows(got, "doc_id", "pattern") == [(1, ["b", "a", "c"]), (2, ["a", "b", "c"]), (3, ["a", "b", "c"]), (4, ["a"]), (5, ["a"]), (6, ["b"]), (9, ["c", "a", "b"])]
    # more sources than bits in a mask
    many = [f"s{i:03d}" for i in range(150)]
    wide = spark.createDataFrame([(i, s, "k", 1) for i, s in enumerate(many) if i % 63 < 2] + [(500, "s007", "l", 1)], "doc_id bigint, source string, text_key string, tokens bigint")
    shared = [s for i, s in enumerate(many) if i % 63 < 2]
    assert all(list(p) == ([s] if s == "s007" else [s, *(t for t in shared if t != s)]) for s, p in rows(M.memberships(wide, many), "source", "pattern"))


@pytest.mark.parametrize("few", [M.MAX_BROADCAST, 0])
def test_overlapping_documents_fill_both_quotas_within_their_caps(spark, monkeypatch, few):
    monkeypatch.setattr(M, "MAX_BROADCAST", few)
    rng = random.Random(5)
    # every text of a is listed by b too, which has only few of its own; c allows one use less than a and b
    docs = [(i, "a", f"t{i}", 1 + rng.randrange(40)) for i in range(1500)] + [(2000 + i, "b", f"t{i}", 1) for i in range(1500)]
    docs += [(5000 + i, "b", f"u{i % 50}", 9) for i in range(100)] + [(6000 + i, "c", f"u{i}", 9) for i in range(50)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, text_key string, tokens bigint")
    targets = make(spark, "mix_targets", [dict(zip(("source_name", "target_share", "max_repeats"), t)) for t in (("a", 0.49, 3), ("b", 0.49, 3), ("c", 0.02, 2))])
    chosen = M.choose(sized, targets)
    uses = {}
    for doc, _, _, n in rows(chosen):
        uses[doc] = uses.get(doc, 0) + n
    source, text = {d[0]: d[1] for d in docs}, {d[0]: d[2] for d in docs}
    # in all its sources together, a document keeps to the least permissive of them
    assert all(n <= (2 if text[d].startswith("u") else 3) for d, n in uses.items()) and max(uses.values()) == 3
    size = {d[0]: d[3] for d in docs}
    actual = {r["source_name"]: r for r in M.shares(chosen, targets).collect()}
    assert [actual[s]["actual_share"] for s in "abc"] == pytest.approx([0.49, 0.49, 0.02], abs=0.004)
    # b alone could place 3 * (1500 + 900) tokens only
    assert actual["b"]["mixed_tokens"] > 3 * sum(size[d] for d in size if source[d] == "b")
    # what was moved is moved to a source that lists the text
    listed = {(d[2], d[1]) for d in docs}
    assert all((text[d], s) in listed for d, s, _, _ in rows(chosen)) and any(source[d] != s for d, s, _, _ in rows(chosen))
    assert len(set(rows(chosen, "doc_id", "source"))) == len(rows(chosen))


def test_documents_stay_with_the_source_they_name_where_nothing_is_gained():
    flows = M.plan_mix({("a", "b"): 100, ("b", "a"): 100, ("a",): 50, ("b",): 50}, {"a": (0.5, 1), "b": (0.5, 1)})[1]
    assert flows[("a", "b"), "b"] == flows[("b", "a"), "a"] == 0 and sum(flows.values()) == 300
    # but they move rather than that others are repeated, and no more of them than that takes
    flows = M.plan_mix({("a", "b"): 200, ("b",): 20, ("c",): 20}, {"a": (0.4, 5), "b": (0.4, 5), "c": (0.2, 1)})[1]
    assert flows[("b",), "b"] == 20 and flows[("a", "b"), "b"] in (20, 21)



def test_largest_total_against_every_set_of_sources():
    rng = random.Random(6)
    for _ in range(60):
        names = "abcde"[: rng.randint(1, 5)]
        patterns = {tuple(rng.sample(names, rng.randint(1, len(names)))): rng.randint(0, 90) for _ in range(6)}
        targets = {s: (rng.choice((0.1, 0.25, 0.4)), rng.randint(1, 4)) for s in names}
        total, flows = M.plan_mix(patterns, targets)
        live = sorted({s for p, n in patterns.items() if n for s in p})
        whole = sum(targets[s][0] for s in live)
        room = {p: n * min(targets[s][1] for s in p) for p, n in patterns.items()}
        # by Hall's theorem, quotas fit if those of no set of sources exceed the patterns that touch it
        sets = [[s for i, s in enumerate(live) if m >> i & 1] for m in range(1, 1 << len(live))]
        fits = lambda t: t <= sum(room.values()) and all(sum(int(t * (targets[s][0] / whole)) for s in c) <= sum(r for p, r in room.items() if set(p) & set(c)) for c in sets)
        assert (not live and total == 0) or (fits(total) and not fits(total + 1))
        for s in live:
            assert sum(n for (_, t), n in flows.items() if t == s) == int(total * (targets[s][0] / whole))
        assert all(sum(n for (q, _), n in flows.items() if q == p) <= room[p] for p in patterns)
