"""MinHash near-duplicate detection with fast similarity sketches.

The sketch follows "Fast Similarity Sketching" (Dahlgaard, Knudsen, Thorup): in rounds 0..T-1 every
element is thrown into a random coordinate, in rounds T..2T-1 into coordinate (round - T); a coordinate
keeps its least (round, value), and the rounds end as soon as none is empty. Every coordinate is
filled, each agrees with the Jaccard similarity as probability, and the agreement is concentrated.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, few_ids_join, hashed_words, mixed, powers, raw_column, small_batches, stored, text_blocks, worker_cache
from .components import components

_U = np.uint64


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, one after the other, and where each text's begin (the end added)."""
    words, first, *_ = hashed_words(texts, lower=True)
    out, at = [], [0]
    for i in range(len(texts)):
        w = words[first[i] : first[i + 1]]
        if not len(w):
            found = w
        else:
            m = max(1, len(w) - k + 1)
            acc = np.full(m, min(len(w), k), dtype=np.uint64)
            for j in range(min(k, len(w))):
                acc = mixed(acc ^ w[j : j + m]) + w[j : j + m] * powers(k + 1)[j + 1]
            found = np.unique(mixed(acc))
        out.append(found)
        at.append(at[-1] + len(found))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.array(at)


def sketches(elements: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """The sketch of t coordinates of each (non-empty) element set; sets as from shingle_sets()."""
    n = len(at) - 1
    empty = _U(2**64 - 1)
    out = np.full(n * t, empty, dtype=np.uint64)
    size = np.diff(at)
    open_, owner, held = np.arange(n), np.repeat(np.arange(n), size), elements
    for r in range(2 * t):
        value = mixed(held, 2 * r + 1)
        spot = (mixed(held, 2 * r + 2) % _U(t)).astype(np.int64) if r < t else np.full(len(held), r - t)
        np.minimum.at(out, owner * t + spot, (value >> _U(10)) | (_U(r) << _U(54)))
        left = open_[(out.reshape(n, t)[open_] == empty).any(axis=1)]
        if not len(left):
            break
        if len(left) < len(open_):
            keep = np.zeros(n, dtype=bool)
            keep[left] = True
            stays = keep[owner]
            owner, held, open_ = owner[stays], held[stays], left
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _U(77), cells.shape[:2])
    for j in range(rows):
        key = mixed(key ^ cells[:, :, j], j)
    return key.view(np.int64)


def _features(k: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        worker_cache(None)
        for batch in batches:
            for (ids,), texts in text_blocks(batch, ["doc_id"]):
                elements, at = shingle_sets(texts, k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((len(texts), bands), dtype=np.int64)
                if len(full):
                    keys[full] = band_keys(sketches(elements, np.concatenate([[0], np.cumsum(n[full])]), bands * rows), bands, rows)
                prints = np.frombuffer(b"".join(blake2b(elements[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:])), dtype=np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.record_batch([ids, pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))], schema=schema)

    return run


def _slices(batch: pa.RecordBatch, rows: int, limit: int):
    """Parts of a batch of pairs of at most so many rows and about so many bytes of text."""
    size = np.cumsum([len(a) + len(b) for a, b in zip(raw_column(batch, "ta"), raw_column(batch, "tb"))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, min(start + rows, int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, side="right"))))
        yield batch.slice(start, end - start)
        start = end


def _compared(k: int, percent: int, slice_rows: int = 256, slice_bytes: int = 4 * BLOCK_BYTES):
    """Pairs with texts (sorted by b) -> each pair's link and how a differs from b: |b minus a| and the hashes that only one has."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("removed", pa.int64()), ("delta", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, slice_rows, slice_bytes):
                b = batch.column("b").to_pylist()
                new = [i for i in range(len(b)) if i == 0 or b[i] != b[i - 1]]
                texts = [t.encode("utf-8", "surrogatepass") for t in (*batch.column("ta").to_pylist(), *batch.column("tb").take(pa.array(new)).to_pylist())]
                elements, at = shingle_sets(texts, k)
                which = np.cumsum(np.isin(np.arange(len(b)), new)) - 1 + len(b)
                rows = []
                for i, j in enumerate(which):
                    mine, other = elements[at[i] : at[i + 1]], elements[at[j] : at[j + 1]]
                    delta = np.setxor1d(mine, other, assume_unique=True)
                    common = (len(mine) + len(other) - len(delta)) // 2
                    rows.append((100 * common >= percent * (common + len(delta)), len(mine), len(other), len(other) - common, delta.tobytes()))
                yield pa.record_batch([batch.column("a"), batch.column("b"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:]))], schema=schema)

    return run


COMPARED = "a long, b long, linked boolean, n_a long, n_b long, removed long, delta binary"


def _across(percent: int):
    """Links between one block of outsiders and one block of members of a leader's group, by what each changes in the leader's set:
    |x and y| = |leader| - |removed x| - |removed y| + |delta x and delta y|."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        cols = {n: table.column(n).to_numpy() for n in ("node", "root", "n_a", "n_b", "removed")}
        deltas = [np.frombuffer(d, dtype=np.uint64) for d in table.column("delta").to_pylist()]
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        links: list[tuple] = []
        if len(x) and len(y):
            sides = []
            for rows in (x, y):
                size = [len(deltas[i]) for i in rows]
                sides.append((np.concatenate([deltas[i] for i in rows]), np.repeat(np.arange(len(rows)), size)))
            shared = np.intersect1d(sides[0][0], sides[1][0])
            both = np.zeros((len(x), len(y)), dtype=np.float32)
            for start in range(0, len(shared), 4096):
                part = shared[start : start + 4096]
                dense = []
                for (values, owner), rows in zip(sides, (x, y)):
                    spot = np.searchsorted(part, values)
                    hit = (spot < len(part)) & (part[np.minimum(spot, len(part) - 1)] == values)
                    m = np.zeros((len(rows), len(part)), dtype=np.float32)
                    m[owner[hit], spot[hit]] = 1
                    dense.append(m)
                both += dense[0] @ dense[1].T
            common = cols["n_b"][x][:, None] - cols["removed"][x][:, None] - cols["removed"][y] + np.rint(both).astype(np.int64)
            union = cols["n_a"][x][:, None] + cols["n_a"][y] - common
            found = np.argwhere((100 * common >= percent * union) & (cols["root"][x][:, None] != cols["root"][y]))
            seen = set()
            for i, j in found:  # one link to each component is enough
                if (key := (i, cols["root"][y[j]])) not in seen:
                    seen.add(key)
                    links.append((int(cols["node"][x[i]]), int(cols["node"][y[j]])))
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 36, rows: int = 6, block_outside: int = 512, block_members: int = 2048, broadcast_pairs: int = 1_000_000) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts whose word-shingle sets have 100 * intersection >= percent * union are linked, if a band of
    their sketches agrees (a pair at 0.8 shares none of 36 bands of 6 with probability 2e-5) and the
    full sets confirm it. component_id is the smallest doc_id that a document reaches.

    Texts with equal sets are one node from the start. In each bucket of equal bands every node is first
    compared with the bucket's smallest, its leader: one comparison for each member, not one for each
    pair. Then, in leaders' groups that still hold several components, those outside the leader's are
    held against all others there, block by block inside tasks, from what each changes in the leader's
    set. So no link between two members of a bucket is lost, and no pair but a link becomes a row.

    Nulls and empty or blank texts: an empty set, linked with nothing, kept. A null doc_id: component
    null, kept. Repeated rows: each is returned. Rows with one doc_id and different texts: one node, with
    all of their sets, held against others by the least of its texts. Very long texts: a set takes eight
    bytes for each shingle, and a task holds as many texts at a time as `BLOCK_BYTES` lets in, one at
    least. An empty table: no rows. Other columns are ignored.
    """
    return _grouped(docs, shingle_words, percent, bands, rows, block_outside, block_members, broadcast_pairs)[0]


def _grouped(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 36, rows: int = 6, block_outside: int = 512, block_members: int = 2048, broadcast_pairs: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """near_duplicates(), and the features of each row that it comes from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = stored(docs.mapInArrow(_features(shingle_words, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "features")
    nodes = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    spread = features.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    star = stored(spread.join(shared.select("band", "leader"), "band").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "star")

    ids = star.select(F.col("a").alias("doc_id")).unionByName(star.select(F.col("b").alias("doc_id"))).distinct()
    if star.count() <= broadcast_pairs:  # so at most twice as many ids of 8 bytes; beyond, whole texts are shuffled once
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    left = star.hint("merge").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    pairs = left.hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    compared = stored(pairs.mapInArrow(_compared(shingle_words, percent), COMPARED), "compared")
    edges = compared.where("linked").select("a", "b")
    roots = stored(components(edges), "roots")

    few = lambda df: F.broadcast(df) if df.count() <= broadcast_pairs else df  # noqa: E731  a hot leader's rows then stay where they are
    mine, leaders = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    placed = compared.join(mine, "a", "left").join(leaders, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("root"), F.coalesce("rb", "b").alias("home"), "n_a", "n_b", "removed", "delta")
    outside = F.col("root") != F.col("home")
    sizes = stored(placed.groupBy("b").agg(F.count_if(outside).alias("n_out"), F.count("*").alias("n_all")).where("n_out > 0 AND n_all > 1"), "sizes")
    cut = placed.join(few(sizes.select("b", F.ceil(F.col("n_out") / block_outside).alias("rows"), F.ceil(F.col("n_all") / block_members).alias("cols"))), "b").withColumn("outside", outside)
    spot = lambda n: F.pmod(F.xxhash64("a"), F.col(n))
    keep = ["b", "r", "c", "outside", F.col("a").alias("node"), "root", "n_a", "n_b", "removed", "delta"]
    first = cut.where("outside").withColumn("r", spot("rows")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))).select(*keep)
    second = cut.withColumn("c", spot("cols")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("outside", F.lit(False)).select(*keep)
    more = stored(first.unionByName(second).groupBy("b", "r", "c").applyInArrow(_across(percent), "a long, b long"), "more")
    if not more.isEmpty():
        roots = stored(components(edges.unionByName(more)), "roots")

    of_set = nodes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    out = features.select("doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out, features


def _with_sets(shingle_words: int):
    """Adds to each row its number of shingles and the two hashes of their set."""
    features = _features(shingle_words, 1, 1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], names=["doc_id", "text"])
            found = pa.Table.from_batches(features([asked]))
            sets = [found.column(c).combine_chunks() for c in ("n_shingles", "h1", "h2")]
            yield pa.record_batch([*batch.columns, *sets], names=[*batch.schema.names, "_n", "_h1", "_h2"])

    return run


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, **options) -> DataFrame:
    """`docs` with one document of each group of near duplicates, that of the smallest doc_id; all columns stay.

    Of rows with the same doc_id (or all without one) and equal shingle sets, any one stays; a row
    without a doc_id is held against no row that has one. Rows with an empty set all stay.
    """
    judged, features = _grouped(docs, shingle_words, **options)
    dropped = stored(judged.where("NOT kept").select("doc_id").distinct(), "dropped")
    left = few_ids_join(docs, dropped, ["doc_id"], "left_anti")
    again = stored(features.where("n_shingles > 0").groupBy("doc_id", "h1", "h2").count().where("count > 1").select(F.col("doc_id").alias("_again")).distinct(), "again")
    n = again.count()
    if not n:
        return left
    ids, same = F.broadcast(again) if n <= 1_000_000 else again, F.col("doc_id").eqNullSafe(F.col("_again"))
    small_batches(docs.sparkSession)
    marked = left.join(ids, same, "left_semi").mapInArrow(_with_sets(shingle_words), T.StructType([*left.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_n", "_h1", "_h2"))]))
    once = marked.where("_n > 0").dropDuplicates(["doc_id", "_h1", "_h2"]).unionByName(marked.where("_n = 0"))
    return left.join(ids, same, "left_anti").unionByName(once.select(*left.columns))
