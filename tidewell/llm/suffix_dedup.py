"""Removal of byte strings that stand earlier in the corpus, by families of suffix arrays.

A window is a place with `length` bytes from there on. Equal windows have the same minimizer (the k-gram
of least hash in the window, the leftmost of equals), so windows are dealt out by their minimizers, and
only those whose minimizer comes up more than once in the corpus are looked at. Neighbouring windows
with one minimizer travel together, as one run of bytes.

A batch of runs gets a suffix array: the places of its windows in the order of the bytes that follow,
compared to the depth of a window. Batches come in the order of (document, start). Each is merge-scanned
against the levels that are there: both arrays are walked side by side, and neighbours in the common
order whose longest common prefix is a whole window are matches. What is new becomes a level of its own,
text and suffix array, and levels of like size merge, so there are logarithmically many. The tasks that
cut the runs send them through such a family first, so of what is frequent each sends one copy on; where
there are many tasks, groups of them are merged before all are.

A minimizer of very many documents doesn't send all its windows to one place: a run's windows are dealt out by
where in the window the minimizer begins, in a few classes of neighbouring places, and by the bytes that
all windows of the class have in common. Equal windows agree in both, so they still meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, discard, few_ids_join, mixed, powers, prefix_hash, raw_column, small_batches, span_hash, stored, worker_cache

_U = np.uint64
_PLACE_BITS = 28
SEGMENT = 1 << 20


def minimizer_runs(pieces: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer in pieces of text: (piece, start in the joined pieces, windows, minimizer's hash, how far behind the start it begins)."""
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    n, w = len(raw), length - k + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none
    prefix = prefix_hash(byte_codes(raw))
    grams = mixed((prefix[k:] - prefix[:-k]) * powers(n - k + 1, True))
    low = (grams >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    windows = n - length + 1
    low = np.minimum(low[:windows], low[w - size : w - size + windows])
    place = (low & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    ends = np.cumsum([len(p) for p in pieces])
    whole = np.ones(windows, dtype=bool)
    for begin, end in zip(ends - [len(p) for p in pieces], ends):
        whole[max(begin, end - length + 1) : end] = False
    turn = place[1:] != place[:-1]
    first = whole & np.concatenate([[True], turn | ~whole[:-1]])
    last = whole & np.concatenate([turn | ~whole[1:], [True]])
    start = np.flatnonzero(first)
    count = np.flatnonzero(last) - start + 1
    return np.searchsorted(ends, start, side="right"), start, count, grams[place[start]], place[start] - start


def segments(texts: list, length: int):
    """Groups of pieces of at most about SEGMENT bytes: (pieces, text index of each, offset of each in its text). Long texts are cut with overlaps, so that no window is lost or doubled."""
    pieces, owner, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        text = text or b""
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[at : at + SEGMENT + length - 1]
            if size and size + len(piece) > SEGMENT:
                yield pieces, np.array(owner), np.array(offset)
                pieces, owner, offset, size = [], [], [], 0
            pieces.append(piece)
            owner.append(i)
            offset.append(at)
            size += len(piece)
    if pieces:
        yield pieces, np.array(owner), np.array(offset)


def _anchors(length: int, k: int):
    """(doc_id, anchors): the minimizers of each document or segment of one, twice if one has several runs there."""
    schema = pa.schema([("doc_id", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        worker_cache(None)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for pieces, owner, _ in segments(raw_column(batch, "text"), length):
                piece, _, _, anchor, _ = minimizer_runs(pieces, length, k)
                text = owner[piece] if len(piece) else piece
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(anchor)]
                nth = np.arange(len(anchor)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(anchor) else anchor
                anchor, text = anchor[nth < 2], text[nth < 2]
                begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])[: len(text)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(text)).astype(np.int32)), pa.array(anchor.view(np.int64)))
                yield pa.record_batch([pa.array(ids[text[begin]], pa.int64()), lists], schema=schema)

    return run


@dataclass
class Level:
    """A text and the suffix array of its windows, all different: where they begin, in the order of their bytes, their first bytes as numbers, and for each the place (document, text, start) where it first stands."""

    raw: np.ndarray
    places: np.ndarray
    words: np.ndarray
    first: tuple

    def windows(self, kind: str, some=slice(None)) -> np.ndarray:
        return windows_of(self.raw, self.places[some], kind)

    def merged(self, other: Level, kind: str) -> Level:
        size, words = len(self.places), np.concatenate([self.words, other.words])
        raw, places = np.concatenate([self.raw, other.raw]), np.concatenate([self.places, other.places + len(self.raw)])
        order = suffix_order(words, lambda some: windows_of(raw, places[some], kind))
        return Level(raw, places[order], words[order], tuple(np.concatenate([a, b])[order] for a, b in zip(self.first, other.first)))


def suffix_order(words: np.ndarray, windows) -> np.ndarray:
    """The order of windows by their first bytes, as numbers, and where those agree by all bytes (`windows` gives those of some); equal ones as they came.
    Of two sorted runs, one behind the other, the sort is a natural merge: it walks along both once."""
    order = np.argsort(words, kind="stable")
    tie = words[order][1:] == words[order][:-1]
    tied = np.concatenate([[False], tie]) | np.concatenate([tie, [False]]) if len(order) else np.zeros(0, dtype=bool)
    rest = order[tied]
    order[tied] = rest[np.argsort(windows(rest), kind="stable")]
    return order


def common_windows(level: Level, words: np.ndarray, windows, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The matches of a merge-scan of a level and sorted windows, all different: (which of the level, which of the windows). Both are walked by their
    first bytes; only where these agree, neighbours in the common order are compared as a whole."""
    low = np.searchsorted(level.words, words)
    mine = np.flatnonzero(level.words[np.minimum(low, len(level.words) - 1)] == words)
    high = np.searchsorted(level.words, words[mine], side="right")
    inside = np.zeros(len(level.words) + 1, dtype=np.int64)
    np.add.at(inside, low[mine], 1)
    np.add.at(inside, high, -1)
    theirs = np.flatnonzero(np.cumsum(inside)[:-1])
    both = np.concatenate([level.windows(kind, theirs), windows(mine)])
    order = np.argsort(both, kind="stable")
    pair = np.flatnonzero(both[order][1:] == both[order][:-1])  # the level's own one comes first
    return theirs[order[pair]], mine[order[pair + 1] - len(theirs)]


class LogIndex:
    """A logarithmic family of suffix arrays over the distinct windows met so far."""

    def __init__(self, length: int):
        self.length, self.kind, self.levels, self.batches = length, f"S{length}", [], 0

    def add(self, raw: np.ndarray, at: np.ndarray, run: np.ndarray, place: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Takes a batch of windows (at `at` in raw, of the runs `run`) in the order of their places (document, text, start), later than all before it.
        Tells which windows stand earlier, which came up for the first time, and these as stretches: (first, last, text, where each one's begins)."""
        self.batches += 1
        words, windows = first_bytes(raw, at), lambda some: windows_of(raw, at[some], self.kind)
        order = suffix_order(words, windows)
        same = words[order][1:] == words[order][:-1]
        i = np.flatnonzero(same)
        same[i] = windows(order[i]) == windows(order[i + 1])
        new = np.concatenate([[True], ~same])[: len(order)]
        group, leader = np.cumsum(new) - 1, order[new]
        first = tuple(p[leader].copy() for p in place)
        known = np.zeros(len(leader), dtype=bool)
        for level in self.levels:
            theirs, mine = common_windows(level, words[leader], lambda some: windows(leader[some]), self.kind)
            known[mine] = True
            for own, other in zip(first, level.first):
                own[mine] = other[theirs]
        earlier = np.empty(len(order), dtype=bool)
        earlier[order] = np.logical_or.reduce([f[group] != p[order] for f, p in zip(first, place)])
        fresh = np.zeros(len(order), dtype=bool)
        fresh[leader[~known]] = True
        a, b = stretches(fresh, run)
        size = b - a + self.length
        begin = np.concatenate([[0], np.cumsum(size)])
        text = raw[np.repeat(at[a] - begin[:-1], size) + np.arange(begin[-1])]
        if not known.all():
            moved = np.zeros(len(order), dtype=np.int64)
            moved[fresh] = (np.repeat(begin[:-1] - at[a], b - a + 1)) + at[fresh]
            level = Level(text, moved[leader[~known]], words[leader[~known]], tuple(f[~known] for f in first))
            while self.levels and len(self.levels[-1].places) <= 2 * len(level.places):
                level = self.levels.pop().merged(level, self.kind)
            self.levels.append(level)
        return earlier, fresh, (a, b, text, begin)


def windows_of(raw: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """The fixed-length byte strings at the given places (all as long, so padding tells nothing apart wrongly)."""
    length = int(kind[1:])
    return np.ndarray(shape=(max(0, len(raw) - length + 1),), dtype=kind, buffer=raw, strides=(1,))[at]


def first_bytes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of windows, of which each has that many, as numbers of the same order."""
    return np.ndarray(shape=(max(0, len(raw) - 7),), dtype=">u8", buffer=raw, strides=(1,))[at].astype(np.uint64)


def stretches(flag: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the maximal stretches of set flags within equal runs."""
    same = run[1:] == run[:-1]
    first = flag & np.concatenate([[True], ~flag[:-1] | ~same])[: len(flag)]
    last = flag & np.concatenate([~flag[1:] | ~same, [True]])[: len(flag)]
    return np.flatnonzero(first), np.flatnonzero(last)


RUNS = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("sub", pa.int32()), ("start", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())])
RUNS_SQL = "anchor long, part int, doc_id long, sub int, start long, windows int, bytes binary"


@dataclass
class Split:
    """How the windows of frequent minimizers are dealt out: which runs have one, how far behind the run's start it begins, and in how many classes of places."""

    frequent: np.ndarray
    lead: np.ndarray
    k: int
    classes: int

    def of(self, run: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, int]:
        """The class of each window (0 in other runs), and the places in a class."""
        step = -(-(length - self.k + 1) // self.classes)
        return np.where(self.frequent[run], (self.lead[run] - inside) // step, 0), step

    def anchors(self, raw: np.ndarray, anchor: np.ndarray, base: np.ndarray, own: np.ndarray, kind: np.ndarray, step: int, length: int) -> np.ndarray:
        """The anchors of pieces of the runs `own`, of the classes `kind`: those of frequent ones mixed with what the class has in common."""
        out = anchor[own].copy()
        some = np.flatnonzero(self.frequent[own])
        if len(some):
            row, low = own[some], kind[some] * step
            at = base[row] + self.lead[row]
            common = span_hash(prefix_hash(byte_codes(raw)), at - low, at - np.minimum(low + step - 1, length - self.k) + length)
            out[some] = mixed(out[some].view(np.uint64) ^ common ^ mixed(low.astype(np.uint64), 5)).view(np.int64)
        return out


def _sifted(index_of, raw, length, anchor, doc, sub, start, base, count, part, batch_windows, ship, split=None):
    """Sends runs (sorted by doc, sub and start; bytes at `base` in raw) through indexes in batches: rows of matches (no bytes) and, if they are to be shipped, of new runs, those of frequent minimizers split."""
    begin = 0
    total = np.cumsum(count)
    while begin < len(count):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + batch_windows, side="right")))
        rows = slice(begin, end)
        run = np.repeat(np.arange(end - begin), count[rows])
        inside = np.arange(len(run)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        at, place = base[rows][run] + inside, start[rows][run] + inside
        kind, step = split.of(run + begin, inside, length) if split else (np.zeros(len(run), dtype=np.int64), 1)
        cuts = run * (kind.max(initial=0) + 1) + kind
        earlier, _, (c, d, text, bounds) = index_of().add(raw, at, cuts, (doc[rows][run], sub[rows][run], place))
        a, b = stretches(earlier, run)
        anchors = anchor[rows][run[a]]
        content = pa.nulls(len(a), pa.binary())
        if ship:
            anchors = np.concatenate([anchors, split.anchors(raw, anchor, base, run[c] + begin, kind[c], step, length) if split else anchor[rows][run[c]]])
            a, b = np.concatenate([a, c]), np.concatenate([b, d])
            new = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)])
            content = pa.concat_arrays([content, new])
        own = run[a]
        yield pa.record_batch([pa.array(anchors), pa.array(np.full(len(a), part, dtype=np.int32)), pa.array(doc[rows][own]), pa.array(sub[rows][own]), pa.array(place[a]), pa.array((b - a + 1).astype(np.int32)), content], schema=RUNS)
        begin = end


def _cut(length: int, k: int, batch_windows: int, family: int, classes: int):
    """Documents (sorted by doc_id, sub) with the minimizers that are repeated -> runs, sifted by a family of suffix arrays that spans the task's batches (a new one after `family` of them, which bounds memory)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held = [LogIndex(length)]

        def index() -> LogIndex:
            if held[0].batches >= family:
                held[0] = LogIndex(length)
            return held[0]

        for batch in batches:
            ids, subs = (batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("doc_id", np.int64), ("sub", np.int32)))
            wanted = batch.column("anchors")
            sizes = np.diff(wanted.offsets.to_numpy())
            repeated = mixed(wanted.flatten().to_numpy().view(np.uint64) ^ mixed(np.repeat(np.arange(len(ids)), sizes).astype(np.uint64), 3))
            frequent = np.unique(batch.column("frequent").flatten().to_numpy())
            for pieces, owner, offset in segments(raw_column(batch, "text"), length):
                piece, at, count, anchor, lead = minimizer_runs(pieces, length, k)
                if not len(piece):
                    continue
                text = owner[piece]
                keep = np.isin(mixed(anchor ^ mixed(text.astype(np.uint64), 3)), repeated)
                piece, at, count, anchor, lead, text = piece[keep], at[keep], count[keep], anchor[keep], lead[keep], text[keep]
                begins = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
                start, doc, sub = at - begins[piece] + offset[piece], ids[text], subs[text]
                order = np.lexsort((start, sub, doc))
                raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
                anchor = anchor.view(np.int64)[order]
                split = Split(np.isin(anchor, frequent), lead[order], k, classes) if len(frequent) else None
                yield from _sifted(index, raw, length, anchor, doc[order], sub[order], start[order], at[order], count[order], part, batch_windows, True, split)

    return run


def _merged(length: int, batch_windows: int, ship: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_run = table.column("bytes").is_valid().to_numpy(zero_copy_only=False)
        passed = table.filter(pa.array(~is_run)).select(RUNS.names).cast(RUNS)
        runs = table.filter(pa.array(is_run))
        doc, sub, start = (runs.column(c).to_numpy() for c in ("doc_id", "sub", "start"))
        order = np.lexsort((start, sub, doc))
        content = runs.column("bytes").take(pa.array(order)).to_pylist()
        raw = np.frombuffer(b"".join(content), dtype=np.uint8)
        base = np.concatenate([[0], np.cumsum([len(c) for c in content])[:-1]]).astype(np.int64) if content else np.zeros(0, dtype=np.int64)
        index = LogIndex(length)
        parts = list(_sifted(lambda: index, raw, length, runs.column("anchor").to_numpy()[order], doc[order], sub[order], start[order], base, runs.column("windows").to_numpy()[order], int(table.column("part")[0].as_py() or 0), batch_windows, ship))
        return pa.concat_tables([passed, pa.Table.from_batches(parts, schema=RUNS)])

    return run


def _spans(length: int, then):
    """Documents with what matched in them -> the same with maximal spans of removed bytes, given on to `then`."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("text", pa.string()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            begins, ends = [], []
            for found, size in zip(batch.column("found").to_pylist(), batch.column("n_bytes").to_pylist()):
                b, e = [], []
                for start, windows in sorted((f["start"], f["windows"]) for f in found):
                    stop = min(size, start + windows - 1 + length)
                    if e and start <= e[-1]:
                        e[-1] = max(e[-1], stop)
                    else:
                        b.append(start)
                        e.append(stop)
                begins.append(b)
                ends.append(e)
            yield pa.record_batch([batch.column("doc_id"), batch.column("print"), batch.column("text"), pa.array(begins, schema.field("begins").type), pa.array(ends, schema.field("ends").type)], schema=schema)

    return lambda batches: then(run(batches))


def prepared(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("print", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def whole_copies(docs: DataFrame, length: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, print) of the documents from prepared() whose whole text, of `length` bytes at least, is that of a smaller doc_id: all of it stands earlier.
    The first of each text that comes up twice is broadcast behind a check of their number; beyond, the digests (not the texts) are joined."""
    long = docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {length}").select("doc_id", "print")
    firsts = stored(long.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("print", "first"), "firsts")
    few = firsts.count() <= broadcast_rows
    return stored(long.join(F.broadcast(firsts) if few else firsts, "print").where("doc_id > first").select("doc_id", "print").distinct(), "copies")


def repeated_spans(docs: DataFrame, copies: DataFrame, then, schema: str, length: int = 100, k: int = 32, batch_windows: int = 1 << 15, fan_in: int = 256, family: int = 16, frequent: int = 4096, classes: int = 8) -> DataFrame:
    """What `then` makes of Arrow batches (doc_id, print, text, begins, ends): the byte spans of each document of `docs` (from prepared())
    that are covered by a string of `length` bytes that also starts earlier (smaller doc_id, or same document and smaller start). Left
    out: documents without any, and whole copies, whose strings all stand in their first one.

    Nulls, texts shorter than `length` and rows with a null doc_id: no spans. Rows repeated with the
    same doc_id and text are one document: its strings don't stand earlier than themselves. Different
    texts with one doc_id are documents one after the other, in an order that is always the same. Long
    texts are cut into overlapping segments, so a text of any length takes the memory of a segment here;
    its row has to fit an Arrow batch. Minimizers that come up more than `frequent` times are split in `classes`
    (at 8, 32 and 100 bytes, what still goes to one place has 92 bytes in common).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = few_ids_join(docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {length}"), copies, ["doc_id", "print"], "left_anti")
    lists = stored(docs.select("doc_id", "text").mapInArrow(_anchors(length, k), "doc_id long, anchors array<long>"), "minimizers")
    anchors = lists.select("doc_id", F.explode("anchors").alias("anchor"))
    counted = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = anchors.join(counted, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("n") > frequent, F.col("anchor"))).alias("frequent"))
    wanted = stored(wanted, "anchors")
    discard(lists)
    total = wanted.agg(F.sum(F.size("anchors"))).first()[0] or 0
    candidates = stored(few_ids_join(docs, wanted.select("doc_id"), ["doc_id"], "left_semi").join(wanted, "doc_id").withColumn("sub", F.hash("print")), "candidates")
    rows = candidates.select("doc_id", "sub", "text", "anchors", "frequent").sortWithinPartitions("doc_id", "sub").mapInArrow(_cut(length, k, batch_windows, family, classes), RUNS_SQL)
    buckets = max(1, math.ceil(total * (length - k) / 2 / (family // 2 * batch_windows)))
    bucket = F.when(F.col("bytes").isNotNull(), F.pmod("anchor", F.lit(buckets))).otherwise(F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), candidates.rdd.getNumPartitions())
    group = fan_in
    while group < parts:
        rows = rows.groupBy(bucket.alias("bucket"), F.floor(F.col("part") / group).alias("group")).applyInArrow(_merged(length, batch_windows, True), RUNS_SQL)
        group *= fan_in
    rows = rows.groupBy(bucket.alias("bucket")).applyInArrow(_merged(length, batch_windows, False), RUNS_SQL)
    found = stored(rows.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "windows")).alias("found")), "found")
    left = few_ids_join(candidates.drop("anchors", "frequent"), found.select("doc_id", "sub"), ["doc_id", "sub"], "left_semi").join(found, ["doc_id", "sub"]).withColumn("n_bytes", F.octet_length("text"))
    return left.mapInArrow(_spans(length, then), schema)


def _remaining(text: bytes, begins: list, ends: list) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)]))


def _digested(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        removed, spans, digests = [], [], []
        for text, b, e in zip(raw_column(batch, "text"), batch.column("begins").to_pylist(), batch.column("ends").to_pylist()):
            removed.append(sum(e) - sum(b))
            spans.append(len(b))
            digests.append(sha256(_remaining(text, b, e)).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), batch.column("print"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], schema=schema)


def removal_digests(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null text: empty. Null doc_id: nothing is removed.
    An empty table: no rows. What repeated rows and rows that share a doc_id mean: as in repeated_spans(). Other columns are ignored."""
    docs = prepared(docs)
    copies = whole_copies(docs, options.get("length", 100))
    schema = "doc_id long, print binary, n_removed long, n_spans long, kept_sha256 string"
    cut = repeated_spans(docs, copies, _digested, schema, **options).dropDuplicates(["doc_id", "print"])
    gone = copies.select("doc_id", "print", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(sha256(b"").hexdigest()).alias("kept_sha256"))
    found = stored(cut.unionByName(gone), "cut")
    whole = docs.select("doc_id", "print", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("whole"))
    out = whole.join(found, ["doc_id", "print"], "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def _texts(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("kept_text", pa.string())])
    for batch in batches:
        kept = [_remaining(t, b, e).decode("utf-8", "ignore") for t, b, e in zip(raw_column(batch, "text"), batch.column("begins").to_pylist(), batch.column("ends").to_pylist())]
        yield pa.record_batch([batch.column("doc_id"), batch.column("print"), pa.array(kept, pa.string())], schema=schema)


def remaining_texts(docs: DataFrame, **options) -> DataFrame:
    """`docs` with every text cut down to its remaining bytes; characters of which only some bytes remain go too. All columns, whatever their names, and all rows stay."""
    own = prepared(docs)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("print"))
    copies = whole_copies(own, options.get("length", 100))
    cut = repeated_spans(own, copies, _texts, "doc_id long, print binary, kept_text string", **options).dropDuplicates(["doc_id", "print"])
    found = stored(cut.unionByName(copies.select("doc_id", "print", F.lit("").alias("kept_text"))), "texts")
    joined = keyed.join(found, ["doc_id", "print"], "left")
    field = lambda c: F.col("row").getField(c)
    return joined.select(*((F.coalesce("kept_text", field(c)) if c == "text" else field(c)).alias(c) for c in docs.columns))
