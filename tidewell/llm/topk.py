"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors of whole numbers lie in the order of their ids, in groups of blocks. A block keeps, for each
term (component), the largest and smallest value in it. A query's bound for a block is the sum of what
its terms can reach there; blocks are scored in the order of their bounds, through their forward
indexes (the blocks' own vectors), for the queries whose bound does not fall below their k-th score so
far. A query first meets the group that it comes from; with the k-th score found there it goes to all
other groups, which are dealt out to a bounded number of slabs: a block of queries goes to each slab
once and keeps one list of its best through all groups there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_messages, stored

BLOCK = 64

#: Queries travel, and come back with their best, once for each slab; so many at most keep that in proportion to the input.
SLABS = 128

#: So many queries are in a block of them, unless one group has more.
BLOCK_QUERIES = 4096

LOWEST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
GROUPS = "group long, width int, ids binary, vectors binary, n_queries int, queries binary, kth binary, kth_ids binary"
GROUPS_ARROW = pa.schema([("group", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("n_queries", pa.int32()), ("queries", pa.binary()), ("kth", pa.binary()), ("kth_ids", pa.binary())])
ASKED = "part long, width int, ids binary, vectors binary, kth binary, kth_ids binary"
ASKED_ARROW = pa.schema([("part", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("kth", pa.binary()), ("kth_ids", pa.binary())])
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS_SQL = "query_id long, vec_id long, score long"


def whole_vectors(batch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x) of the vectors that are there and finite; shorter ones end in zeros."""
    keys, lists = batch.column("vec_id"), batch.column("embedding")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    x = np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))  # a null is NaN here
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = np.flatnonzero((bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & keys.is_valid().to_numpy(zero_copy_only=False))
    starts, sizes = offsets[good], offsets[good + 1] - offsets[good]
    out = np.zeros((len(good), sizes.max(initial=0)), dtype=np.int64)
    row = np.repeat(np.arange(len(good)), sizes)
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = x[starts[row] + column]
    return keys.take(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64), out


def _length(a: np.ndarray) -> float:
    """The greatest Euclidean length of a row."""
    a = a.astype(np.float64)
    return float(np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0)))


def _kind(reach: float):
    """The fastest type in which products of rows are exact; no partial sum exceeds the product of their lengths."""
    return np.float32 if reach < 2**23 else np.float64 if reach < 2**52 else np.int64


def _few(mask: np.ndarray) -> np.ndarray:
    """Where a mask that is mostly false holds, in its flat order."""
    flat = mask.ravel()
    n = len(flat) & ~7
    at = (8 * np.flatnonzero(flat[:n].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], n + np.flatnonzero(flat[n:])])


class Best:
    """The best k so far of each query of a block, ties to the smaller id; candidates behind a query's k-th are left out."""

    def __init__(self, query_ids, queries, kth, kth_ids, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.kth, self.kth_ids = kth.copy(), kth_ids.copy()
        self.found = [np.zeros(0, dtype=np.int64)] * 3  # place of the query, id, score
        self.waiting, self.n_waiting = [], 0
        self.reach, self.cast = _length(queries), {}

    def by_kind(self, kind, width: int) -> tuple:
        """The queries as this type and as wide as this, and what of them is above and below zero."""
        if (kind, width) not in self.cast:
            queries = np.pad(self.queries, ((0, 0), (0, width - self.queries.shape[1]))).astype(kind)
            self.cast[kind, width] = queries, np.maximum(queries, 0), np.minimum(queries, 0)
        return self.cast[kind, width]

    def settle(self) -> None:
        """Takes in what waits."""
        if not self.n_waiting:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(self.found, *self.waiting))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.kth[q[last]], self.kth_ids[q[last]] = scores[last], ids[last]
        self.found = [x[place < self.k] for x in (q, ids, scores)]
        self.waiting, self.n_waiting = [], 0

    def meet(self, ids, vectors, at_once: int = 8) -> None:
        """Scores a group's blocks, those of the greatest bounds first."""
        width = max(vectors.shape[1], self.queries.shape[1])
        if vectors.shape[1] < width:
            vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        edges = np.arange(0, len(ids), BLOCK)
        high, low = np.maximum.reduceat(vectors, edges, axis=0), np.minimum.reduceat(vectors, edges, axis=0)
        kind = _kind(2 * self.reach * max(_length(high), _length(low)))
        _, above, below = self.by_kind(kind, width)
        bounds = (above @ high.astype(kind).T + below @ low.astype(kind).T).astype(np.int64)
        kind = _kind(self.reach * _length(vectors))
        queries, vectors = self.by_kind(kind, width)[0], vectors.astype(kind)
        order = np.argsort(-bounds.max(axis=0, initial=LOWEST + 1), kind="stable")
        for begin in range(0, len(order), at_once):
            some = order[begin : begin + at_once]
            asks = np.flatnonzero(bounds[:, some].max(axis=1) >= self.kth)
            if not len(asks):
                continue
            rows = (edges[some][:, None] + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(ids)]
            scores = (queries if len(asks) == len(queries) else queries[asks]) @ vectors[rows].T
            least = np.maximum(self.kth[asks], LOWEST // 2).astype(np.float64) if kind != np.int64 else self.kth[asks]
            if kind == np.float32:
                least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            at = _few(scores >= least[:, None])
            q, row = asks[at // len(rows)], rows[at % len(rows)]
            score, key = scores.ravel()[at].astype(np.int64), ids[row]
            good = ((score > self.kth[q]) | ((score == self.kth[q]) & (key <= self.kth_ids[q]))) & (key != self.query_ids[q])
            if good.any():
                self.waiting.append((q[good], key[good], score[good]))
                self.n_waiting += int(good.sum())
                if self.n_waiting > self.k * len(queries):
                    self.settle()
        self.settle()

    def rows(self):
        return pa.record_batch([pa.array(self.query_ids[self.found[0]]), pa.array(self.found[1]), pa.array(self.found[2])], schema=HITS)


def _packed(vectors: np.ndarray) -> bytes:
    """By the narrowest type that holds them; its size follows from the number of rows and their width."""
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
    return vectors.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def _unpacked(ids: bytes, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, dtype=np.int64)
    size = len(vectors) // max(1, len(keys) * width)
    return keys, np.frombuffer(vectors, dtype=f"i{size}" if size else np.int64).reshape(len(keys), width)


def _grouped(scale: float, every: int, k: int, group_rows: int):
    """Vectors in order of their ids (all rows of an id in one task) -> groups with their queries and each query's k-th score and id at home."""

    def run(batches):
        part, n, before = TaskContext.get().partitionId(), 0, None
        for whole in batches:
            for start in range(0, whole.num_rows, group_rows):
                ids, vectors = whole_vectors(whole.slice(start, group_rows), scale)
                if not len(ids):
                    continue
                asks = np.flatnonzero(ids % every == 0)
                asks = asks[np.concatenate([ids[asks][:1] != before, ids[asks][1:] != ids[asks][:-1]])]  # the first row of an id asks
                before = ids[-1]
                home = Best(ids[asks], vectors[asks], np.full(len(asks), LOWEST), np.full(len(asks), LAST), k)
                if len(asks):
                    home.meet(ids, vectors)
                values = [part << 33 | n, vectors.shape[1], ids.tobytes(), _packed(vectors), len(asks), asks.astype(np.int64).tobytes(), home.kth.tobytes(), home.kth_ids.tobytes()]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, GROUPS_ARROW)], schema=GROUPS_ARROW)
                n += 1

    return run


def _one_by_one(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _asked(batches):
    for row in _one_by_one(batches):
        ids, vectors = _unpacked(row["ids"], row["width"], row["vectors"])
        asks = np.frombuffer(row["queries"], dtype=np.int64)
        values = [row["part"], row["width"], ids[asks].tobytes(), _packed(vectors[asks]), row["kth"], row["kth_ids"]]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, ASKED_ARROW)], schema=ASKED_ARROW)


def _searched(k: int):
    """Pairs of a block of queries and a group -> the block's best; what a block finds in the groups that follow each other is one list."""

    def run(batches):
        part, best = None, None
        for row in _one_by_one(batches):
            if row["part"] != part:
                if best is not None:
                    yield best.rows()
                parts = [(*_unpacked(b["ids"], b["width"], b["vectors"]), b["kth"], b["kth_ids"]) for b in row["block"]]
                width = max(v.shape[1] for _, v, _, _ in parts)
                query_ids, queries = np.concatenate([p[0] for p in parts]), np.concatenate([np.pad(p[1], ((0, 0), (0, width - p[1].shape[1]))) for p in parts])
                kth, kth_ids = (np.frombuffer(b"".join(p[i] for p in parts), dtype=np.int64) for i in (2, 3))
                part, best = row["part"], Best(query_ids, queries, kth, kth_ids, k)
            best.meet(*_unpacked(row["ids"], row["width"], row["vectors"]))
        if best is not None:
            yield best.rows()

    return run


def _places(sizes: list, block_groups: int, slabs: int) -> list[tuple[int, int, int]]:
    """For (group, number of queries) in order: group, slab, part, where a part is a block of queries of at most so many groups."""
    out, part, groups, asked = [], 0, 0, 0
    for i, (group, n) in enumerate(sizes):
        if groups and n and (groups == block_groups or asked + n > BLOCK_QUERIES):
            part, groups, asked = part + 1, 0, 0
        groups, asked = groups + bool(n), asked + n
        out.append((group, i % slabs, part))
    return out


def best_matches(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, group_rows: int = 4096, block_groups: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows of `vectors` (vec_id, embedding) for each row whose vec_id is divisible by `every`.

    Queries are packed into blocks of those of `block_groups` groups at most, and every block meets every
    group, as blocks of numbers: one row per block and slab travels, `SLABS` slabs at most, never one per
    pair of vectors or of groups. The vectors travel once. The driver holds two numbers per group. Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components
    take no part; components that one of two vectors lacks count as zero. Repeated rows: each is a
    candidate; rows with the query's own id are not; an id asks once, with the least of its vectors. Fewer
    than k others: all. Components have to stay below 2^53 when scaled. An empty table: no rows. Other
    columns are ignored.
    """
    small_messages(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # half as much to deal out
    ordered = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = stored(ordered.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id", "embedding").mapInArrow(_grouped(scale, every, k, group_rows), GROUPS), "groups")
    sizes = [tuple(r) for r in groups.select("group", "n_queries").orderBy("group").collect()]  # of one row per group of `group_rows` vectors
    slabs = max(1, min(SLABS, len(sizes)))
    places = F.broadcast(vectors.sparkSession.createDataFrame(_places(sizes, block_groups, slabs), "group long, slab int, part long"))
    asked = groups.where("n_queries > 0").join(places, "group").select("part", "width", "ids", "vectors", "queries", "kth", "kth_ids").mapInArrow(_asked, ASKED)
    packed = asked.groupBy("part").agg(F.collect_list(F.struct("width", "ids", "vectors", "kth", "kth_ids")).alias("block"))
    spread = packed.select("part", "block", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
    dealt = groups.join(places, "group").select("slab", "width", "ids", "vectors")
    # The merge join goes through a slab's groups for each block in turn, so a block's rows follow each other; another order would cost rows, not results.
    hits = spread.hint("merge").join(dealt, "slab").select("part", "block", "width", "ids", "vectors").mapInArrow(_searched(k), HITS_SQL)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
