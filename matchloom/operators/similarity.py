"""Similarity joins by blocking keys, chosen by what they cost."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.hashing import duration_bucket, duration_close, frame_distance, hamming

BITS = 64
#: Tables of up to so many hashes, 16 bytes each, are broadcast to a plain loop where no blocking key is cheaper than that.
LOOP_ROWS = 200_000
#: Cost of a comparison in that loop, which neither shuffles nor writes, in rows that are joined by key.
LOOP_COST = 0.05
#: Flips of a part that are looked up at most, and so the size of the table of flips.
MOST_FLIPS = 1 << 18


@dataclass(frozen=True)
class Blocking:
    """Parts of the first hash with the bits that may differ in each, and parts of the second, one of which must be equal (none: not used)."""

    parts: tuple[tuple[int, int, int], ...]  # first bit, number of bits, radius
    second: tuple[tuple[int, int], ...]  # first bit, number of bits
    probes: int  # keys of a hash on the left
    share: float  # of all pairs, for even hashes, that share a key

    def cost(self, n: int) -> float:
        """Rows made for each hash on the left by joining it with n others."""
        return self.probes + len(self.parts) * max(1, len(self.second)) + self.share * n


def _edges(n: int) -> list[tuple[int, int]]:
    return [(k * BITS // n, (k + 1) * BITS // n - k * BITS // n) for k in range(n)]


def blockings(threshold: int, second: bool) -> list[Blocking]:
    """All ways to block on m parts (Norouzi et al. 2012): of hashes at most `threshold` apart, one part is within its radius.

    The radii are a share of the threshold each, less for the later parts; with `second`, an equal one of
    threshold + 1 parts of the other hash may join the key.
    """
    out = []
    for m in range(1, min(threshold + 1, BITS) + 1):
        radius, extra = divmod(threshold, m)
        parts = tuple((at, width, min(width, radius - (k > extra))) for k, (at, width) in enumerate(_edges(m)) if radius - (k > extra) >= 0)
        flips = [sum(comb(w, r) for r in range(most + 1)) for _, w, most in parts]
        if sum(flips) > MOST_FLIPS:
            continue
        share = sum(f / 2.0**w for f, (_, w, _) in zip(flips, parts, strict=True))
        out.append(Blocking(parts, (), sum(flips), share))
        if second and threshold < BITS:
            equal = tuple(_edges(threshold + 1))
            out.append(Blocking(parts, equal, sum(flips) * len(equal), share * sum(0.5**w for _, w in equal)))
    return out


def choose(threshold: int, n: int, second: bool = True, loop_cost: float = LOOP_COST) -> Blocking | None:
    """The cheapest blocking for a join with n hashes; None where comparing all costs less."""
    best = min(blockings(threshold, second), key=lambda b: b.cost(n))
    return best if best.cost(n) < n * loop_cost else None


def _part(h: Column, at: int, width: int) -> Column:
    return h if width == BITS else F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1))


def _flips(parts) -> list[tuple[int, int]]:
    return [(k, sum(1 << b for b in bits)) for k, (_, width, radius) in enumerate(parts) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(left: DataFrame, right: DataFrame, plan: Blocking) -> DataFrame:
    """x_p, x_d, y_p, y_d: each pair of hashes (p, d) that shares a key, once, by its first one."""
    spark = left.sparkSession
    flips = F.broadcast(spark.createDataFrame([(k, _signed(m)) for k, m in _flips(plan.parts)], "k int, flip long"))  # MOST_FLIPS rows at most
    of = lambda h: F.posexplode(F.array(*[_part(F.col(h), at, width) for at, width, _ in plan.parts])).alias("k", "v")
    x = left.select("x_p", "x_d", of("x_p")).join(flips, "k").withColumn("v", F.col("v").bitwiseXOR(F.col("flip"))).drop("flip")
    y = right.select("y_p", "y_d", of("y_p"))
    keys = ["v", "k"]  # values first: rows are sorted by the first key as far as it tells them apart
    far = lambda a, b, at, width: hamming(_part(F.col(a), at, width), _part(F.col(b), at, width))
    first = F.coalesce(*[F.when(far("x_p", "y_p", at, width) <= most, k) for k, (at, width, most) in enumerate(plan.parts)]) == F.col("k")
    if plan.second:
        also = lambda h: F.posexplode(F.array(*[_part(F.col(h), at, width) for at, width in plan.second])).alias("k2", "v2")
        x, y, keys = x.select("*", also("x_d")), y.select("*", also("y_d")), ["v", "v2", "k", "k2"]
        first = first & (F.coalesce(*[F.when(far("x_d", "y_d", at, width) == 0, k) for k, (at, width) in enumerate(plan.second)]) == F.col("k2"))
    # Spark's sizes leave out what explode and flips add: unless told to sort, it would broadcast the keys of what looks small
    return x.hint("merge").join(y.hint("merge"), keys).filter(first).select("x_p", "x_d", "y_p", "y_d")


def near_hashes(left: DataFrame, right: DataFrame, threshold: int, second: bool = True, ordered: bool = False, loop_rows: int = LOOP_ROWS, loop_cost: float = LOOP_COST) -> DataFrame:
    """x_p, x_d, y_p, y_d, distance of all different pairs of hashes whose bits differ in at most `threshold` places, in both if `second`.

    left, right: phash, dhash. Equal hashes are one. ordered: each pair of one table with itself once, the lesser
    hashes as x, none with itself.
    """
    of = lambda df, tag: df.filter("phash is not null and dhash is not null").select(F.col("phash").alias(f"{tag}_p"), F.col("dhash").alias(f"{tag}_d")).distinct()
    x, y = of(left, "x"), of(right, "y")
    n = y.count()
    plan = choose(threshold, n, second, loop_cost)
    distance = hamming(F.col("x_p"), F.col("y_p"))
    near = distance <= threshold
    if second:
        near = near & (hamming(F.col("x_d"), F.col("y_d")) <= threshold)
    if ordered:
        near = near & (F.struct("x_p", "x_d") < F.struct("y_p", "y_d"))
    if plan is None:  # by broadcast, or as a distributed product where that would be large
        pairs = x.join(F.broadcast(y) if n <= loop_rows else y, near)
    else:
        pairs = candidates(x, y, plan).filter(near)
    return pairs.select("x_p", "x_d", "y_p", "y_d", distance.alias("distance"))


def _paths(df: DataFrame, tag: str, path: str) -> DataFrame:
    return df.select(F.col("path").alias(path), F.col("phash").alias(f"{tag}_p"), F.col("dhash").alias(f"{tag}_d"))


def hash_pairs(left: DataFrame, right: DataFrame, threshold: int, second: bool = True) -> DataFrame:
    """a, b, distance of all pairs of a path on the left with one on the right whose hashes are near. Rows: path, phash, dhash; null hashes are near none."""
    near = near_hashes(left, right, threshold, second)
    return near.join(_paths(left, "x", "a"), ["x_p", "x_d"]).join(_paths(right, "y", "b"), ["y_p", "y_d"]).select("a", "b", "distance")


def self_pairs(hashes: DataFrame, threshold: int, second: bool = True) -> DataFrame:
    """a, b, distance with a < b of all pairs of paths of one table whose hashes are near."""
    near = near_hashes(hashes, hashes, threshold, second, ordered=True)
    out = near.join(_paths(hashes, "x", "p"), ["x_p", "x_d"]).join(_paths(hashes, "y", "q"), ["y_p", "y_d"])
    equal = _paths(hashes, "x", "a").join(_paths(hashes, "x", "b"), ["x_p", "x_d"]).filter("a < b")
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance").unionByName(equal.select("a", "b", F.lit(0).alias("distance")))


def video_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, distance of paths with close durations and a mean frame distance of at most threshold. Rows: path, duration, frames."""
    a = left.select(F.col("path").alias("a"), F.col("duration").alias("a_t"), F.col("frames").alias("a_f"), duration_bucket(F.col("duration")).alias("bucket"))
    near = F.explode(F.array(*[duration_bucket(F.col("duration")) + k for k in (-1, 0, 1)]))
    b = right.select(F.col("path").alias("b"), F.col("duration").alias("b_t"), F.col("frames").alias("b_f"), near.alias("bucket"))
    pairs = a.join(b, "bucket").filter(duration_close(F.col("a_t"), F.col("b_t")))
    return pairs.select("a", "b", frame_distance(F.col("a_f"), F.col("b_f")).alias("distance")).filter(F.col("distance") <= threshold)
