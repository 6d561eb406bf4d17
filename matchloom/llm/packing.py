"""Best-fit packing by the configuration linear program over the length histogram."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_limits, give_back, partitions, read_limits, staged, table
from matchloom.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Patterns that the multiplicative weights ask the knapsack for.
ROUNDS = 700
#: How strongly prices rise for lengths that lag behind in being covered.
TILT = 8.0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str | None, capacity: int, end_id: int):
    def run(batches):
        import pyarrow as pa

        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                raw = ids + end
                n = len(raw) >> 2
                borders = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], names)
        give_back()

    return run


def cut_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` ids: only longer documents are cut, the first piece taking what is left over."""
    arrow_limits(docs.sparkSession)
    read_limits(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_cut(tokenizer, capacity, end_id), PIECES)


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length goes into one sequence, so that the values sum to the most. value[l - 1]: of length l."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1][:c] + value[:c]
        k = int(total.argmax())
        best[c], choice[c] = total[k], k + 1
    out, c = np.zeros(capacity, np.int64), capacity
    while c > 0 and value[choice[c] - 1] > 0:
        out[choice[c] - 1] += 1
        c -= choice[c]
    return out


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns and how many sequences follow each, covering counts[l - 1] pieces of each length l exactly.

    The configuration program, least sequences so that every length is covered, is a covering program:
    multiplicative weights keep a price for each length, which falls as it is covered; the knapsack prices
    the best pattern; it is taken as often as the least covered of its lengths allows. The fractional
    solution is rounded down, and what it leaves uncovered goes by best fit, long pieces first, into the
    room of the patterns and new sequences. The work depends on the capacity, not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    groups: list[tuple[dict[int, int], int]] = []
    if left[capacity - 1]:  # full pieces fill a sequence each
        groups.append(({capacity: 1}, int(left[capacity - 1])))
        left[capacity - 1] = 0
    need = left.astype(float)
    held = need > 0
    if held.any():
        lengths = np.arange(1, capacity + 1)
        covered, taken = np.zeros(capacity), {}
        bound = float((lengths * need).sum()) / capacity
        for _ in range(rounds):
            share = np.where(held, covered / np.maximum(need, 1), np.inf)
            low = share.min()
            if low >= 1:
                break
            # price of a length: its size, tilted by how far it is covered beyond the mean; none once covered
            mean = float((lengths * covered).sum()) / capacity / bound
            price = np.where(share < 1, lengths * np.exp(-TILT * (np.minimum(share, 1) - mean)) * (1 + 1e-4 * lengths / capacity), 0)
            pattern = knapsack(price, capacity)
            used = pattern > 0
            if not used.any():
                break
            room = np.maximum(need - covered, 0)[used] / pattern[used]
            step = max(1.0, min(float(room.min()), float(np.quantile(need[used] / pattern[used], 0.5)) / 2))
            covered[used] += step * pattern[used]
            key = tuple((int(i) + 1, int(pattern[i])) for i in np.flatnonzero(used))
            taken[key] = taken.get(key, 0.0) + step
        for key, x in sorted(taken.items(), key=lambda t: (-t[1], t[0])):
            copies = min([int(x), *(int(left[size - 1] // k) for size, k in key)])
            if copies > 0:
                groups.append((dict(key), copies))
                for size, k in key:
                    left[size - 1] -= copies * k
    return best_fit(left, groups, capacity)


def best_fit(left: np.ndarray, groups: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Put what is left, long pieces first, where it leaves the least room; alike sequences are one group."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for pattern, copies in groups:
        by_room.setdefault(capacity - sum(size * k for size, k in pattern.items()), []).append((pattern, copies))
    for size in range(capacity, 0, -1):
        n = int(left[size - 1])
        while n:
            room = next((r for r in range(size, capacity) if by_room.get(r)), None)
            if room is None:
                room, pattern, copies = capacity, {}, -(-n // (capacity // size))
            else:
                pattern, copies = by_room[room].pop()
            each = min(room // size, max(1, n // copies))
            whole = min(copies, n // each)
            by_room.setdefault(room - each * size, []).append((pattern | {size: pattern.get(size, 0) + each}, whole))
            n -= whole * each
            if copies > whole and pattern:
                by_room.setdefault(room, []).append((pattern, copies - whole))
    return [(p, c) for room in sorted(by_room) for p, c in by_room[room] if c]


def slots(groups: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Places by length: (length, first rank, how many, first sequence, offset). Rank r of a length goes to sequence first + r - first rank."""
    out, sequence, rank = [], 0, {}
    for pattern, copies in groups:
        offset = 0
        for size in sorted(pattern, reverse=True):
            for _ in range(pattern[size]):
                out.append((size, rank.get(size, 0), copies, sequence, offset))
                rank[size] = rank.get(size, 0) + copies
                offset += size
        sequence += copies
    return out


def _place(table_: np.ndarray, span: int):
    """Looks ranks up in the slots, sorted by length * span + first rank."""

    def run(batches):
        import pyarrow as pa

        keys = table_[:, 0] * span + table_[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            sequence = table_[at, 3] + rank - table_[at, 1]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(table_[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces (columns of PIECES, length from 1 to capacity) with sequence_id and offset.

    Sequences are filled from 0 without gaps. The driver sees the histogram of lengths alone, `capacity`
    rows at most; pieces are ranked within their length by salted counts, so a length that holds most
    pieces is ranked by many tasks. An empty table gives an empty result; repeated rows are pieces of their own.
    """
    spark = pieces.sparkSession
    arrow_limits(spark)
    salted = staged(
        pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int")),
        "pieces",
    )
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity, np.int64)
    for row in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length - 1] = row.n
    place = np.array(sorted(slots(solve(counts, capacity, rounds))) or [(0, 0, 0, 0, 0)], np.int64)
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # the start of a length and salt comes before its pieces, so one sort ranks them and nothing is joined
    inside = W.partitionBy("length", "salt").orderBy(F.col("before").asc_nulls_last(), "doc_id", "piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        salted.unionByName(starts, allowMissingColumns=True)
        .withColumn("rank", (F.first("before").over(inside) + F.row_number().over(inside) - 2).cast("long"))
        .filter(F.col("before").isNull())
        .drop("before", "salt")
    )
    return ranked.mapInArrow(_place(place, int(counts.max(initial=0)) + 1), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Every document's pieces with their places. Null texts are empty: one piece, the end id. Other columns are ignored."""
    return pack(cut_documents(docs, tokenizer, id_col, text_col, capacity), capacity, rounds)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
