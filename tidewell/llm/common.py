"""Helpers that the corpus operators share: table access, shared storage, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass holds at a time.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady_memory() -> None:
    """Lets the C library give large freed arrays back at once (its threshold for that otherwise grows with use); where it is not glibc, does nothing."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


steady_memory()


_held: dict[str, dict] = {}
_last: list = [None]


def worker_cache(kind: str | None, key=None, make=None):
    """What a Python worker keeps between tasks, for one operator at a time: the caches of others, and memory that they freed, go first. Without make, only that."""
    for other in [k for k in _held if k != kind]:
        del _held[other]
    if _last[0] != kind:
        _last[0] = kind
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    if make is None:
        return None
    box = _held.setdefault(kind, {})
    if key not in box:
        box.clear()
        box[key] = make()
    return box[key]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, for long texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def small_messages(spark: SparkSession, megabytes: int = 16) -> None:
    """Fewer bytes in an Arrow batch than Spark's default, for rows that are large; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > megabytes << 20:
        spark.conf.set(key, f"{megabytes}m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a temporary one where it is unset and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame from stored(); only for frames that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def raw_column(batch, name: str) -> list:
    """The UTF-8 bytes of a column of texts, None where it is null."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def text_blocks(batch, columns, text="text", limit=BLOCK_BYTES):
    """Splits an Arrow batch into runs of rows of at most about `limit` text bytes; yields (columns as lists, texts as UTF-8)."""
    others = [batch.column(c) for c in columns]
    texts = batch.column(text)
    start, held, size = 0, [], 0
    for i, value in enumerate(texts):
        raw = value.as_py()
        raw = raw.encode("utf-8", "surrogatepass") if raw is not None else None
        held.append(raw)
        size += len(raw or b"") + 1
        if size >= limit:
            yield [o.slice(start, i + 1 - start) for o in others], held
            start, held, size = i + 1, [], 0
    if held:
        yield [o.slice(start, len(held)) for o in others], held


_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the rolling hash's base, or of its inverse, modulo 2^64."""
    kind = "inverse" if inverse else "base"
    if len(have := _powers.get(kind, ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, _P_INVERSE if inverse else _P, dtype=np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the SplitMix64 finaliser), different for each seed."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = the sum of codes[k] * P^k over i <= k < j."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span [start, end), the same wherever its content stands."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix), True)[start])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def byte_codes(raw: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[raw]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashed_words(texts: list, lower: bool = False):
    """Of texts (UTF-8 or None): word hashes in order, and for each text the index of its first word, with the end added; also the bytes, word starts and word ends."""
    joined = b"\n".join(t or b"" for t in texts)
    if lower:
        joined = joined.lower()  # bytes.lower() changes A-Z only
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), raw, none, none
    s, e = word_spans(raw)
    hashes = span_hash(prefix_hash(byte_codes(raw)), s, e)
    first = np.concatenate([[0], np.searchsorted(s, ends)])
    return hashes, first, raw, s, e


def few_ids_join(docs: DataFrame, ids: DataFrame, keys: list, how: str, most: int = 1_000_000) -> DataFrame:
    """docs by semi or anti join with few ids; broadcast behind a check of their number, else the texts are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, keys, how)


def keep_rows(docs: DataFrame, judge, text: str = "text", verdict: str = "kept", wanted: bool = True, cache: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, to which a judge of Arrow batches (_row, doc_id, held_out, text) gives the wanted verdict."""

    small_batches(docs.sparkSession)

    def run(batches):
        worker_cache(cache)
        for batch in batches:
            if not batch.num_rows:
                continue
            row = pa.array(np.arange(batch.num_rows))
            asked = pa.record_batch([row, row, pa.array(np.zeros(batch.num_rows, dtype=bool)), batch.column(text)], names=["_row", "doc_id", "held_out", "text"])
            flags = pa.concat_arrays([b.column(verdict) for b in judge([asked])])
            yield batch.filter(flags if wanted else pc.invert(flags))

    return docs.mapInArrow(run, docs.schema)
