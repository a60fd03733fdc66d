"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more pools (``members``). Documents are aggregated by
membership pattern; a flow then routes each pattern's tokens to the quotas of its pools.
Using a pattern's tokens an e-th time costs ``e``² a token more than leaving them (a convex
cost), up to ``epochs`` times, and a quota that cannot be met is left short at a cost above
any path. The flow is solved exactly by successive shortest paths over patterns and pools.
Its result is turned into documents by walking each pattern in the order of a seeded hash.

Scale: only one row a document (id hash, pattern, tokens) is aggregated; cut-offs come from
a two-level prefix sum over hash ranges, so no window ever spans a whole pattern or a hot
source. Selection is a map-side comparison with the cut-offs; texts are never shuffled.

Cases: a document without pools (null members) is never taken. Null or empty texts hold
no tokens and are taken with the position they fall on. Rows with equal id hash move
together. Weights of pools that hold nothing are left short. An empty table gives none.
Columns that clash with ``pool`` or ``copy``, in any case, are renamed ``orig_...``.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import BROADCAST_BYTES, clear_names, materialize, row_key

EPOCHS = 4
SEED = 31
#: Hash ranges of a pattern, by the first 13 bits of the signed hash.
RANGES = 8192
#: A cut behind every hash.
END = 1 << 63
#: Patterns beyond this many bytes on the driver are refused rather than solved slowly.
MOST_PATTERNS = 100_000


def n_tokens(text: Column) -> Column:
    """White-space separated tokens of a text; 0 for null."""
    t = F.trim(F.translate(text, "\n\t\r", "   "))
    return F.coalesce(F.when(t == "", 0).otherwise(F.size(F.split(t, " +"))), F.lit(0)).cast("long")


def members() -> Column:
    """The pools of a row of ``documents``: its source and its language."""
    return F.array_sort(F.array_compact(F.array(F.concat(F.lit("source:"), F.col("source")), F.concat(F.lit("lang:"), F.col("lang")))))


class MinCostFlow:
    """Successive shortest paths with potentials on integer capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        k = len(self.to)
        self.to += [b, a]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def solve(self, s: int, t: int) -> tuple[int, int]:
        """Send as much as possible at least cost; costs may not be negative."""
        n, flow, total = len(self.out), 0, 0
        pot = [0] * n
        while True:
            dist, via = [math.inf] * n, [-1] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.out[u]:
                    if self.cap[k] > 0 and (x := d + self.cost[k] + pot[u] - pot[self.to[k]]) < dist[self.to[k]]:
                        dist[self.to[k]], via[self.to[k]] = x, k
                        heapq.heappush(heap, (x, self.to[k]))
            if dist[t] == math.inf:
                return flow, total
            pot = [p + (d if d < math.inf else 0) for p, d in zip(pot, dist)]
            push, v = None, t
            while v != s:
                push = self.cap[via[v]] if push is None else min(push, self.cap[via[v]])
                v = self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                v = self.to[via[v] ^ 1]
            flow += push
            total += push * pot[t]


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], epochs: int = EPOCHS) -> dict[tuple[str, ...], dict[str, int]]:
    """Tokens each pattern gives each pool, meeting the quotas at the least repetition cost."""
    patterns, pools = sorted(capacity), sorted(quota)
    s, t = 0, 1 + len(patterns) + len(pools)
    net = MinCostFlow(t + 1)
    arcs = {}
    for i, p in enumerate(patterns):
        for e in range(epochs):
            if capacity[p]:
                net.add(s, 1 + i, capacity[p], e * e)
        for name in p:
            if name in quota:
                arcs[p, name] = net.add(1 + i, 1 + len(patterns) + pools.index(name), epochs * capacity[p], 0)
    for j, name in enumerate(pools):
        net.add(1 + len(patterns) + j, t, quota[name], 0)
    net.solve(s, t)
    out: dict[tuple[str, ...], dict[str, int]] = {}
    for (p, name), k in arcs.items():
        if net.cap[k ^ 1]:
            out.setdefault(p, {})[name] = net.cap[k ^ 1]
    return out


@dataclass
class Piece:
    """Tokens [low, high) of a pattern, of its ``copy``-th reading, for one pool."""

    pattern: str
    pool: str
    copy: int
    low: int
    high: int


def pieces(flow: dict[tuple[str, ...], dict[str, int]], capacity: dict[tuple[str, ...], int]) -> list[Piece]:
    """Lay each pattern's pools end to end over repeated readings of its documents."""
    out = []
    for p, to in sorted(flow.items()):
        at = 0
        for pool, n in sorted(to.items()):
            end = at + n
            while at < end:
                copy, low = divmod(at, capacity[p])
                high = min(capacity[p], low + end - at)
                out.append(Piece("\x1f".join(p), pool, copy, low, high))
                at += high - low
    return out


def quotas(weights: dict[str, float], budget: int) -> dict[str, int]:
    total = sum(weights.values())
    return {k: int(budget * v / total) for k, v in weights.items() if v > 0}


def plan(docs: DataFrame, weights: dict[str, float] | None, budget: float, pools: Column, epochs: int, seed: int) -> list[tuple[str, str, int, int | None, int | None]]:
    """(pattern, pool, copy, first hash, end hash) of what is taken; None is open."""
    slim = docs.select(F.array_join(pools, "\x1f").alias("pattern"), order_hash(seed).alias("h"), n_tokens(F.col("text")).alias("tokens")).where("pattern <> ''")
    slim = slim.withColumn("r", F.shiftright("h", 51) + F.lit(RANGES // 2))
    slim = materialize(slim, "mix")
    sums = slim.groupBy("pattern", "r").agg(F.sum("tokens").alias("n"))
    size = slim.agg(F.approx_count_distinct("pattern")).first()[0]
    if size > MOST_PATTERNS:
        raise ValueError(f"about {size} membership patterns; group the pools until fewer than {MOST_PATTERNS} remain")
    capacity = {tuple(r[0].split("\x1f")): r[1] for r in sums.groupBy("pattern").agg(F.sum("n")).collect()}
    if weights is None:
        weights = {}
        for p in capacity:
            for x in p:
                weights[x] = 1.0
    quota = quotas(weights, int(budget * sum(capacity.values())) if budget <= epochs else int(budget))
    todo = pieces(route(capacity, quota, epochs), capacity)
    marks = {(x.pattern, b) for x in todo for b in (x.low, x.high)}
    inner = [(p, b) for p, b in marks if 0 < b < capacity[tuple(p.split("\x1f"))]]
    cut: dict[tuple[str, int], int | None] = {(p, b): None for p, b in marks}
    if inner:
        spark = docs.sparkSession
        from pyspark.sql import Window

        start = sums.withColumn("end", F.sum("n").over(Window.partitionBy("pattern").orderBy("r"))).select("pattern", "r", (F.col("end") - F.col("n")).alias("low"), "end")
        want = _local(spark, inner, pattern=pa.string(), b=pa.int64())
        near = F.broadcast(want) if len(inner) * 200 < BROADCAST_BYTES else want
        hit = start.join(near, "pattern").where("low <= b and b < end").select("pattern", "r", "b", "low")
        here = slim.join(F.broadcast(hit) if len(inner) * 200 < BROADCAST_BYTES else hit, ["pattern", "r"])
        each = here.groupBy("pattern", "b", "low", "h").agg(F.sum("tokens").alias("n"))
        run = F.sum("n").over(Window.partitionBy("pattern", "b").orderBy("h"))
        rows = each.withColumn("at", F.col("low") + run - F.col("n")).where("at >= b").groupBy("pattern", "b").agg(F.min("h").alias("h")).collect()
        found = {(r[0], r[1]): r[2] for r in rows}
        ends = {(r[0], r[1]): r[2] for r in hit.select("pattern", "b", "r").collect()}
        for key in inner:
            # no document starts at or after the mark inside its range: cut at the end of the range
            cut[key] = found.get(key, (ends[key] + 1 - RANGES // 2) << 51)
    out = []
    for x in todo:
        full = capacity[tuple(x.pattern.split("\x1f"))]
        low, high = cut[x.pattern, x.low] if x.low > 0 else None, cut[x.pattern, x.high] if x.high < full else None
        if low != END:  # else no document starts in the piece
            out.append((x.pattern, x.pool, x.copy, low, None if high == END else high))
    return out


def _local(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """Rows of the driver by way of Arrow. A list would go through Python workers of another kind,
    with a daemon of their own, which stay beside those of the other stages."""
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
    return spark.createDataFrame(pa.table(columns, list(kinds)))


def order_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), row_key("doc_id"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 0.8, pools: Column | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The chosen rows with ``pool`` and ``copy`` (0 for the first use).

    ``weights`` are target weights by pool, equal if None. ``budget`` is a share of all
    tokens if at most ``epochs``, else a number of tokens.
    """
    pools = members() if pools is None else pools
    todo = plan(docs, weights, budget, pools, epochs, seed)
    spark = docs.sparkSession
    names = docs.columns
    tag = "__mix"
    while any(c.lower().startswith(tag) for c in names):
        tag += "_"
    keyed = docs.withColumns({f"{tag}p": F.array_join(pools, "\x1f"), f"{tag}h": order_hash(seed)})
    want = _local(spark, todo, **{f"{tag}p": pa.string(), "pool": pa.string(), "copy": pa.int32(), f"{tag}lo": pa.int64(), f"{tag}hi": pa.int64()})
    grouped = want.groupBy(f"{tag}p").agg(F.collect_list(F.struct("pool", "copy", f"{tag}lo", f"{tag}hi")).alias(f"{tag}w"))
    if len(todo) * 200 < BROADCAST_BYTES:
        grouped = F.broadcast(grouped)
    hit = keyed.join(grouped, f"{tag}p").withColumn(
        f"{tag}x",
        F.explode(F.filter(f"{tag}w", lambda x: (x[f"{tag}lo"].isNull() | (F.col(f"{tag}h") >= x[f"{tag}lo"])) & (x[f"{tag}hi"].isNull() | (F.col(f"{tag}h") < x[f"{tag}hi"])))),
    )
    keep = [F.col(f"`{c}`").alias(new) for c, new in zip(names, clear_names(names, ("pool", "copy")))]
    return hit.select(*keep, F.col(f"{tag}x.pool").alias("pool"), F.col(f"{tag}x.copy").alias("copy"))
