"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in source partitions by a hash. How many rows each partition sends to each shard is
drawn first: the counts of a uniform random permutation, a multivariate hypergeometric
matrix whose row sums are the partition sizes and whose column sums are the shard sizes.
Then each partition permutes its own rows and deals them by its counts, the rows are
exchanged, and each shard permutes what it got. Partition and shard are never held in one
task: a shard is ordered by a random number whose top bits name one of many buckets.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns

#: Most rows that one task sorts, about.
TASK_ROWS = 1 << 18


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken from ``good + bad`` without replacement.

    Inversion from the mode outwards with ratios of neighbouring probabilities: exact but
    for the rounding of doubles, about as many steps as the standard deviation, any size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lf = lambda n: math.lgamma(n + 1)
    p_mode = math.exp(
        lf(good) - lf(mode) - lf(good - mode) + lf(bad) - lf(draws - mode) - lf(bad - draws + mode)
        - lf(good + bad) + lf(draws) + lf(good + bad - draws)
    )
    u = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows for each partition: how many of its rows go to each shard. All sums are exact."""
    if sum(sizes) != sum(shard_sizes):
        raise ValueError("partition sizes and shard sizes differ in sum")
    rng, left, matrix = random.Random(seed), list(shard_sizes), []
    for size in sizes:
        rest, room, row = size, sum(left), []
        for s, has in enumerate(left):
            room -= has
            x = hypergeometric(rng, has, room, rest)
            row.append(x)
            left[s] -= x
            rest -= x
        matrix.append(row)
    return matrix


def hypergeometric_shuffle(
    df: DataFrame, n_shards: int = 8, seed: int = 17, key: tuple[str, ...] = ("doc_id", "text"), min_partitions: int = 64
) -> DataFrame:
    """Every row of ``df`` once, with new columns ``shard`` (int) and ``slot`` (long).

    Shard sizes differ by one at most, the larger shards first; slots of a shard are gapless
    from 0 and in uniformly random order. The same rows and seed give the same result in
    any order and partitioning of the input. ``key`` names the columns that tell rows apart;
    rows alike in all of them are interchangeable. Nulls hash like any value; old columns
    called shard or slot give way; an empty table gives an empty result.

    To the driver comes one count for each source partition (about ``TASK_ROWS`` rows each),
    never a row.
    """
    spark = df.sparkSession
    h = lambda salt: F.xxhash64(F.lit(seed * 1000 + salt), *[F.col(f"`{c}`") for c in key])
    n = df.count()
    parts = max(min_partitions, -(-n // TASK_ROWS))
    bits = max(6, math.ceil(math.log2(max(1, n / n_shards / TASK_ROWS))))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.pmod(h(1), F.lit(parts)).alias("part"),
        h(2).alias("local"),
        h(3).alias("final"),
    )
    # The matrix, from the partition sizes.
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    sizes = [counts.get(p, 0) for p in range(parts)]
    shard_sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    ends = []
    for row in communication_matrix(sizes, shard_sizes, seed):
        ends.append([sum(row[: s + 1]) for s in range(n_shards)])
    matrix = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("m_part", "ends"))
    matrix = matrix.select(F.col("m_part").cast("long").alias("part"), "ends")
    # Permute locally and deal out by the counts. The matrix has 8 * n_shards bytes a partition.
    local = Window.partitionBy("part").orderBy("local", "final")
    dealt = rows.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(matrix), "part")
    dealt = dealt.select(
        "row", "final",
        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"),
        F.shiftrightunsigned("final", 64 - bits).alias("bucket"),
    )
    # Exchange, and permute again: by bucket, and within a bucket by what is left of the number.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "bucket").orderBy("final")
    slots = dealt.withColumn("inner", F.row_number().over(inner) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    out = slots.select("row.*", F.col("shard").alias("__shard"), (F.col("offset") + F.col("inner")).cast("long").alias("__slot"))
    return add_columns(out, shard=F.col("__shard"), slot=F.col("__slot")).drop("__shard", "__slot")
