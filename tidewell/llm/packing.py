"""Best-fit packing by length patterns.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. There, patterns of
a few lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left over is packed by best fit, by counts of
equal lengths rather than piece by piece. The plan says which ranks among the pieces of a length go to
which sequences and offsets; each piece then finds its place from its own rank.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded
from .common import raw_column, stored


def _pieces(path: str, capacity: int, end_id: int, cache_bytes: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        bpe = loaded(path, cache_bytes)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = {n: [] for n in names}
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_column(batch, "text")):
                ids = bpe.encode(raw or b"") + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    for name, value in zip(names, (doc, k, start, length, crc32(ids[4 * start : 4 * (start + length)]), part, seen[length])):
                        rows[name].append(value)
                    seen[length] += 1
            yield pa.record_batch([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    return run


def length_patterns(histogram: np.ndarray, capacity: int, per_length: int = 4, most: int = 5, seed: int = 7) -> np.ndarray:
    """Patterns of 2 to `most` lengths that fill a sequence exactly: rows of lengths, padded with 0."""
    rng = np.random.default_rng(seed)
    there = np.flatnonzero(histogram)
    weight = histogram[there] / histogram[there].sum()
    found = set()
    for a in there[there < capacity]:
        for size in range(2, most + 1):
            for _ in range(per_length):
                picked = [int(a), *map(int, rng.choice(there, size - 2, p=weight))]
                last = capacity - sum(picked)
                if last > 0 and histogram[last]:
                    found.add(tuple(sorted([*picked, last], reverse=True)))
    out = np.zeros((len(found), most), dtype=np.int64)
    for i, p in enumerate(sorted(found)):
        out[i, : len(p)] = p
    return out


def fitted(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: x >= 0 with sum of x[j] * pattern j near the histogram, by accelerated projected gradients."""
    used = (patterns > 0).astype(float)
    target = histogram.astype(float)
    size = len(target)

    def apply(x):
        return np.bincount(patterns.ravel(), weights=(x[:, None] * used).ravel(), minlength=size)[:size]

    def back(r):
        return (r[patterns] * used).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - target) / (1.05 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def packing_plan(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): pieces of a length with ranks first.. go to consecutive sequences at the offset."""
    left = histogram.astype(np.int64).copy()
    rank = np.zeros_like(left)
    plan: list[tuple] = []
    sequences = 0
    rooms: list[list] = [[] for _ in range(capacity + 1)]  # by free room: runs (first sequence, count)

    def place(length: int, count: int, first: int, offset: int) -> None:
        plan.append((length, int(rank[length]), count, first, offset))
        rank[length] += count
        left[length] -= count

    if len(patterns := length_patterns(left, capacity)) if left[:capacity].any() else ():
        repeats = fitted(patterns, left)
        for j in np.argsort(-repeats, kind="stable"):
            lengths, times = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
            count = min(int(repeats[j]), int((left[lengths] // times).min()))
            if count < 1:
                continue
            offset = 0
            for length in patterns[j][patterns[j] > 0]:
                place(int(length), count, sequences, offset)
                offset += int(length)
            sequences += count
    for length in range(capacity, 0, -1):
        while left[length]:
            room = next((r for r in range(length, capacity) if rooms[r]), capacity)
            if room == capacity:  # none is open: as many new sequences as the rest fills
                run = (sequences, -(-int(left[length]) // (capacity // length)))
                sequences += run[1]
            else:
                run = rooms[room].pop()
            count = min(int(left[length]), run[1])
            place(length, count, run[0], capacity - room)
            if count < run[1]:
                rooms[room].append((run[0] + count, run[1] - count))
            rooms[room - length].append((run[0], count))
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def _placed(plan: np.ndarray, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    wide = 1 << 44  # ranks below; lengths above: one sorted key for both
    keys = plan[:, 0] * wide + plan[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = plan[row, 3] + rank - plan[row, 1]
            yield pa.record_batch([*(batch.column(n) for n in schema.names[:5]), pa.array(sequence), pa.array(plan[row, 4])], schema=schema)

    return run


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, broadcast_ranks: int = 1_000_000, cache_bytes: int = 80 << 20) -> DataFrame:
    """One row per piece of the rows of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids, then end_id; only longer ones than `capacity` are cut, into pieces of
    that length. A piece's rank among those of its length is its place in its task plus what earlier
    tasks have; those counts (tasks x lengths) are summed in Spark, broadcast up to `broadcast_ranks` of
    them and joined by a shuffle of the pieces (without texts) beyond. Null and blank texts: the end id
    alone. Repeated rows: each is packed. An empty table: no rows. Other columns are ignored.
    `cache_bytes` is what a generation of the encoder's caches may take (four in a worker): it trades memory for time, not results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(docs.mapInArrow(_pieces(path, capacity, end_id, cache_bytes), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in base.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    ranks = base.select("part", "length", "base")
    ranks = F.broadcast(ranks) if base.count() <= broadcast_ranks else ranks.hint("merge")
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(_placed(packing_plan(histogram, capacity), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
