"""Sources mixed to target weights, small sources repeated up to a cap, actual shares reported.

Sizes are tokens of a public tokenizer.  Documents are aggregated by membership pattern: the source a
document names, then the other sources that list the same text.  The number of patterns is bounded by the register of
sources, not by the corpus (5,120 for ten sources).  On that small table a min-cost flow routes token capacity from
patterns to source quotas; the r-th use of a document costs r - 1 per token (convex; from the 17th on in
bands that double), so no document is repeated while unused ones would do, and among mixes with the same repeats the
one that leaves most tokens with the source they name is taken.  The total is the largest for which every
quota of a source that has documents can be filled; the shares of sources without any are spread over
the others in proportion.

The flows of a pattern lie end to end on the line of its documents in the order of seeded hashes, passed
once for every use, so a document that counts for several sources is never used more often in all than it may be.
The ends of the flows are found by a two-level histogram of the hashes: the only ordered scan is over
buckets of a millionth of the hash range.

Edge cases: documents of null, unknown or untargeted sources, and documents without tokens, are not
chosen; a source without documents has an actual share of 0; exact copies are separate documents, each of which
belongs to every targeted source that lists the text (blank texts included); without a ``text_key`` a document
belongs to the source it names only; an empty corpus gives no rows; a null max_repeats is 1, a null share is 0.
"""

from __future__ import annotations

from collections import defaultdict, deque
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culvert.llm.tokens import count_tokens
from culvert.runtime import collect_bounded, durable

MAX_SOURCES = 1_000
MAX_PATTERNS = 100_000
MAX_BROADCAST = 100_000
BITS = 10


class FlowNetwork:
    """Shortest paths, all of one length at a time, on a small network with integer capacities and costs."""

    def __init__(self):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)
        #: nodes that the last run could still reach: the source's side of a smallest cut
        self.reached: dict[int, int] = {}

    def add(self, u: int, v: int, cap: int, cost: int = 0) -> int:
        self.to += [v, u]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[u].append(len(self.to) - 2)
        self.out[v].append(len(self.to) - 1)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while sink in self._distances(source):
            total += self._fill(source, sink)
        return total

    def _distances(self, source: int) -> dict[int, int]:
        to, cap, cost = self.to, self.cap, self.cost
        dist, queue, queued = {source: 0}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in self.out[u]:
                v, d = to[e], dist[u] + cost[e]
                if cap[e] > 0 and d < dist.get(v, 1 << 60):
                    dist[v] = d
                    if v not in queued:
                        queue.append(v)
                        queued.add(v)
        self.reached = dist
        return dist

    def _fill(self, source: int, sink: int) -> int:
        """Pushes all that the shortest paths hold, in blocking flows."""
        to, cap, dist, total = self.to, self.cap, self.reached, 0
        tight = {u: [e for e in self.out[u] if dist.get(to[e]) == d + self.cost[e]] for u, d in dist.items()}
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                u = queue.popleft()
                for e in tight[u]:
                    if cap[e] > 0 and to[e] not in level:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if sink not in level:
                return total
            left, path, u = {v: list(tight[v]) for v in level}, [], source
            while True:
                if u == sink:
                    push = min(cap[e] for e in path)
                    total += push
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    # back to where the path is cut
                    at = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[at] ^ 1]
                    del path[at:]
                    continue
                while left[u] and not (cap[left[u][-1]] > 0 and level.get(to[left[u][-1]]) == level[u] + 1):
                    left[u].pop()
                if left[u]:
                    path.append(left[u][-1])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    left[u].pop()
                else:
                    break


def use_bands(most: int, exact: int = 16) -> list[tuple[int, int]]:
    """(cost a token, uses) of the allowed uses of a document: one by one up to ``exact``, then in bands that double.

    So a register that allows a million uses adds some twenty edges and not a million; costs keep rising.
    """
    bands, at = [], 0
    while at < most:
        uses = 1 if at < exact else min(at, most - at)
        bands.append((at, uses))
        at += uses
    return bands


def plan_mix(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(total, tokens of each (pattern, source)) of the largest mix with the target shares.

    The first source of a pattern is the one its documents name.
    A document of several sources may be repeated as often as the least permissive of them allows.
    """
    known = {p: n for p, n in patterns.items() if n > 0 and any(targets.get(s, (0, 0))[0] > 0 for s in p)}
    live = {s for p in known for s in p if targets.get(s, (0, 0))[0] > 0}
    whole = sum(targets[s][0] for s in live)
    if not live or whole <= 0:
        return 0, {}
    share = {s: targets[s][0] / whole for s in live}
    order = sorted(live)
    node = {s: 2 + i for i, s in enumerate(order)}
    most = {p: min(targets[s][1] for s in p if s in live) for p in known}

    def route(total: int, priced: bool) -> tuple[FlowNetwork, bool, dict]:
        net, used = FlowNetwork(), {}
        for i, (p, size) in enumerate(sorted(known.items())):
            at = 2 + len(order) + i
            for first, uses in use_bands(most[p]) if priced else [(0, most[p])]:
                # one use more outweighs any number of tokens that move between sources
                net.add(0, at, size * uses, first * (len(order) + 1))
            for s in p:
                if s in live:
                    used[p, s] = net.add(at, node[s], size * most[p], int(priced and s != p[0]))
        quota = {s: int(total * share[s]) for s in order}
        for s in order:
            net.add(node[s], 1, quota[s])
        full = net.run(0, 1) == sum(quota.values())
        return net, full, {k: net.cap[e ^ 1] for k, e in used.items()}

    def largest(sources: list[str], below: int) -> int:
        """Largest total below ``below`` whose quotas of these sources fit into the patterns that touch them."""
        capacity = sum(n * most[p] for p, n in known.items() if not set(sources).isdisjoint(p))
        low, high = 0, below
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(int(mid * share[s]) for s in sources) <= capacity else (low, mid)
        return low

    # a total that cannot be filled names the sources that fall short, and so the next smaller one to try
    total = largest(order, sum(n * most[p] for p, n in known.items()) + 1)
    while True:
        net, full, _ = route(total, priced=False)
        if full:
            return total, route(total, priced=True)[2]
        total = largest([s for s in order if node[s] not in net.reached], total)


def memberships(sized: DataFrame, sources: list[str]) -> DataFrame:
    """Adds the membership pattern: the source a document names, then the others of ``sources`` that list its text.

    Sources are bits of 64-bit masks, combined by text on the map side, so a text with many copies makes no large group.
    Texts of several sources are broadcast while they are few and joined by shuffle otherwise, where adaptive execution splits a hot text.
    """
    if "text_key" not in sized.columns or len(sources) < 2:
        return sized.withColumn("pattern", F.array("source"))
    at = F.array_position(F.array(*map(F.lit, sources)), F.col("source")).cast("int") - 1
    words = range(ceil(len(sources) / 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)))
    masks = [F.bit_or(F.when(F.floor(at / 64) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in words]
    several = sum((F.bit_count(f"m{w}") for w in words), F.lit(0)) > 1
    shared = durable(sized.groupBy("text_key").agg(*masks).filter(several))
    few = shared.count() <= MAX_BROADCAST

    def named(w: int) -> Column:
        return F.filter(F.array(*map(F.lit, sources[64 * w : 64 * w + 64])), lambda s, i: F.getbit(F.col(f"m{w}"), i) == 1)

    listed = F.concat(*map(named, words))
    others = F.when(F.col("m0").isNotNull(), F.array_remove(listed, F.col("source"))).otherwise(F.array().cast("array<string>"))
    joined = sized.join(F.broadcast(shared) if few else shared, "text_key", "left").withColumn("pattern", F.concat(F.array("source"), others)).drop("text_key", *(f"m{w}" for w in words))
    return joined if few else durable(joined)


def find_cuts(docs: DataFrame, cuts: list[tuple[list[str], int]]) -> list[tuple[list[str], int, tuple]]:
    """Each cut ``(pattern, tokens)`` with its place ``(b1, b2, h, doc_id)``: the last document that lies below it.

    A document lies below a cut if its middle does; hash and id are null if none of the sub-bucket does.
    """
    wanted = docs.sparkSession.createDataFrame(cuts, "pattern array<string>, cut bigint")

    # level 1: the bucket of the cut; level 2: its sub-bucket; then the rows of that in order
    def bucket(level: DataFrame, keys: list[str], column: str) -> DataFrame:
        hist = level.groupBy(*keys, column).agg(F.sum("tokens").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return hist.withColumn("before", before)

    def last(level: DataFrame, left: str, column: str) -> DataFrame:
        inside = level.filter(F.col("before") <= F.col(left)).groupBy("pattern", "cut")
        return inside.agg(F.max_by(F.struct(F.col(column).alias("at"), (F.col(left) - F.col("before")).alias("left")), column).alias("c"))

    one = last(bucket(docs, ["pattern"], "b1").join(F.broadcast(wanted), "pattern"), "cut", "b1").select("pattern", "cut", F.col("c.at").alias("cut1"), F.col("c.left").alias("left1"))
    first = docs.join(F.broadcast(one), "pattern").filter("b1 = cut1")
    keys = ["pattern", "cut", "cut1", "left1"]
    two = last(bucket(first, keys, "b2"), "left1", "b2").select("pattern", "cut", F.col("c.at").alias("cut2"), F.col("c.left").alias("left2"))
    places = one.join(F.broadcast(two), ["pattern", "cut"]).select("pattern", "cut", "cut1", "cut2", "left2")
    run = F.sum("tokens").over(W.partitionBy("pattern", "cut").orderBy("h", "doc_id"))
    rows = docs.join(F.broadcast(places), "pattern").filter("b1 = cut1 and b2 = cut2")
    # a document lies below while most of it fits the rest; the first of a sub-bucket may not
    below = run - F.col("tokens") / 2 <= F.col("left2")
    ends = rows.withColumn("below", below).groupBy("pattern", "cut", "cut1", "cut2").agg(F.max(F.when(F.col("below"), F.struct("h", "doc_id"))).alias("d"))
    found = collect_bounded(ends.select("pattern", "cut", "cut1", "cut2", "d.h", "d.doc_id"), len(cuts), "cuts")
    return [(r["pattern"], r["cut"], (r["cut1"], r["cut2"], r["h"], r["doc_id"])) for r in found]


def choose(sized: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``(doc_id, source, tokens, repeats)`` of the chosen documents; ``source`` is the one they count for.

    ``sized`` is ``(doc_id, source, tokens)`` and, if texts may be listed by several sources, ``text_key``; it is
    materialised once, as sizes are needed several times.
    """
    register = collect_bounded(targets.filter("source_name is not null").select("source_name", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")), MAX_SOURCES, "sources")
    wanted = {r["source_name"]: (float(r["share"]), int(r["most"])) for r in register if r["share"] > 0 and r["most"] > 0}
    digest = F.xxhash64("doc_id", F.lit(seed))
    placed = durable(
        sized.filter(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)).select(
            "doc_id",
            "source",
            "tokens",
            *(c for c in sized.columns if c == "text_key"),
            F.shiftrightunsigned(digest, 64 - BITS).cast("int").alias("b1"),
            F.shiftrightunsigned(digest, 64 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("b2"),
            digest.alias("h"),
        )
    )
    docs = memberships(placed, sorted(wanted)).drop("source")
    sizes = collect_bounded(docs.groupBy("pattern").agg(F.sum("tokens").alias("n")), MAX_PATTERNS, "membership patterns")
    patterns = {tuple(r["pattern"]): int(r["n"]) for r in sizes}
    _, flows = plan_mix(patterns, wanted)
    # each flow is a stretch of the line: from so many whole passes and a rest to so many and a rest
    stretches = []
    for pattern, size in sorted(patterns.items()):
        start = 0
        for source in pattern:
            end = start + flows.get((pattern, source), 0)
            if end > start:
                stretches.append((pattern, source, divmod(start, size), divmod(end, size)))
            start = end
    cuts = sorted({(pattern, rest) for pattern, _, *ends in stretches for _, rest in ends if rest})
    place = {(tuple(p), cut): at for p, cut, at in find_cuts(docs, [(list(p), cut) for p, cut in cuts])}
    rows = [(list(p), s, q1 - q0, place.get((p, r0)), place.get((p, r1))) for p, s, (q0, r0), (q1, r1) in stretches]
    end = "struct<b1: int, b2: int, h: bigint, id: bigint>"
    plan = sized.sparkSession.createDataFrame(rows, f"pattern array<string>, source string, passes int, low {end}, high {end}")

    def below(at: str) -> Column:
        inside = f"h < {at}.h or (h = {at}.h and doc_id <= {at}.id)"
        return F.expr(f"coalesce(b1 < {at}.b1 or (b1 = {at}.b1 and (b2 < {at}.b2 or (b2 = {at}.b2 and ({inside})))), false)").cast("int")

    out = docs.join(F.broadcast(plan), "pattern")
    return out.select("doc_id", "source", "tokens", (F.col("passes") + below("high") - below("low")).alias("repeats")).filter("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every source, with documents used and tokens placed."""
    per = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    joined = targets.join(per, F.col("source_name") == F.col("source"), "left")
    total = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))  # one row per source
    return joined.select(
        "source_name",
        "target_share",
        F.coalesce(F.col("mixed_tokens") / total, F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )


def sized_documents(docs: DataFrame, **tokenizer) -> DataFrame:
    """``(doc_id, source, text_key, tokens)``; the key is a 128-bit digest of the whole text."""
    return count_tokens(docs.withColumn("text_key", F.unhex(F.md5("text"))), ["source", "text_key"], **tokenizer)
