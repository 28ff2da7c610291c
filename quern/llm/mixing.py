"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words.

Sources by code point, null last, weigh 5, 2, 1, repeating. A source's target is its share of all words, at most three
times its own words; what that cuts off goes to the others by weight, until none is above. Blocks of equal size go to
sources by the highest quotients votes / (2 * seats + 1), then within a source to its shards in the same way. A shard
lays its documents out in seeded order and takes its quota of blocks from a seeded start, round and round.

A source of n documents has about sqrt(n / rows_each) shards, so the shards, a row each on the driver, and the rows that
one task lays out both grow with the square root of the source. The driver never holds a document.

Cases: null text has no words, and takes none; null sources are one source of their own, last; documents with one id
are told apart by size, and equal rows take their places as they come; an empty table gives no rows; extra columns
are ignored by plan_mix() and kept by mix(). Results depend on the rows and the seed alone.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACES, Scratch, fresh

#: Fixed value: weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
REPEATS = 3


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words wanted from each source; sums to all words unless every source is at its most."""
    order = sorted((k for k in sizes if k is not None), key=lambda s: s.encode("utf-32-be", "surrogatepass")) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        whole = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / whole > repeats * sizes[k]]
        if not over:
            out |= {k: left * weight[k] / whole for k in free}
            break
        for k in over:
            out[k] = float(repeats * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in out]
    return out


def apportion(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Sainte-Lague: seats by the highest quotients votes / (2 * seats + 1); ties to the earlier; nobody above `most`.

    A party's first seats are given at once where the method must give them: it gets floor(v / d) for a divisor d
    that hands out no more than all seats; the rest go one by one. So the work follows the parties, not the seats.
    """
    most = most or [seats] * len(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    rounded = lambda d: [min(m, int(v / d + 0.5)) if v > 0 else 0 for v, m in zip(votes, most)]
    low, high = 0.0, 4.0 * max(votes, default=0.0) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(rounded(mid)) > seats else (low, mid)
    got = rounded(high)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def n_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D; null has none."""
    # the words are the gaps between separators, less an empty first and last one
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACES}]+", "x")
    return (F.length(t) - F.length(F.replace(t, F.lit("x"), F.lit("")))).cast("long")


def n_shards(n: int, rows_each: int) -> int:
    """The square root of n / rows_each, rounded up."""
    return math.isqrt(max(0, -(-n // rows_each) - 1)) + 1


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, rows_each: int = 64, seed: int = 11) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, shard, taken (words of it in the mix, repeats counted)."""
    spark = docs.sparkSession
    s = Scratch(spark, "mixing")
    sizes = s.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    by_source = {r.source: (r.size, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    want = targets({k: v for k, (v, _) in by_source.items()})
    kind = "source string, source_size long, target double, parts int"
    names = list(by_source)
    sources = F.broadcast(spark.createDataFrame([(k, by_source[k][0], want[k], n_shards(by_source[k][1], rows_each)) for k in names], kind))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("parts").cast("long")).cast("int")
    sharded = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.size", "source_size", "target", place.alias("shard"))
    shards: dict[str | None, list[tuple[int, int]]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        shards.setdefault(r.source, []).append((r.shard, r.size))
    seats = apportion([want[k] for k in names], round(sum(want.values()) / block), [REPEATS * sum(-(-n // block) for _, n in shards[k]) for k in names])
    quotas = []
    for k, mine in zip(names, seats):
        own = sorted(shards[k])
        got = apportion([float(n) for _, n in own], mine, [REPEATS * -(-n // block) for _, n in own])
        quotas += [(k, part, n, q) for (part, n), q in zip(own, got)]
    given = spark.createDataFrame(quotas, "source string, shard int, shard_size long, quota long").withColumnRenamed("source", "of").withColumnRenamed("shard", "part")
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = sharded.withColumn("stop", F.sum("size").over(w))
    line = line.join(given, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")))
    # blocks are numbered along the shard; the last may be short, and counts as what it holds
    blocks = F.ceil(F.col("shard_size") / block)
    rounds = F.when(blocks > 0, F.floor(F.col("quota") / blocks)).otherwise(0)
    rest = F.col("quota") - rounds * blocks
    first = F.when(blocks > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), blocks)).otherwise(0)
    a, b = F.col("stop") - F.col("size"), F.col("stop")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(b, hi) - F.greatest(a, lo))
    end = first + rest
    run = overlap(first * block, F.least(end, blocks) * block) + F.when(end > blocks, overlap(F.lit(0), (end - blocks) * block)).otherwise(0)
    return line.select("doc_id", "source", "size", "source_size", "target", "shard", (rounds * F.col("size") + run).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw: object) -> DataFrame:
    """The mix itself: each row of docs as often as its taken words hold it, rounded half up; columns as in docs.

    A document's repeats keep its id. Rows with equal id, source and size share their words evenly.
    """
    taken, size, key, src = (fresh(docs, x) for x in ("mix_taken", "mix_size", "mix_id", "mix_source"))
    plan = plan_mix(docs, id_col, text_col, source_col, **kw)
    plan = plan.groupBy("doc_id", "source", "size").agg(F.avg("taken").alias(taken)).select(F.col("doc_id").alias(key), F.col("source").alias(src), F.col("size").alias(size), taken)
    on = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & F.col(source_col).cast("string").eqNullSafe(F.col(src)) & (n_words(F.col(text_col)) == F.col(size))
    times = F.floor(F.col(taken) / F.greatest(F.col(size), F.lit(1)) + 0.5).cast("int")
    rep = fresh(docs, "mix_repeat")
    rows = docs.join(plan, on).withColumn(rep, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return rows.select(*docs.columns)
