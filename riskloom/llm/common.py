"""Helpers shared by the training-data operators.

Text is handled as Arrow buffers: one byte array and one offset array for a
slice of documents, from which word borders and 64-bit fingerprints come by
whole-array numpy operations. A slice holds about ``SLICE_BYTES`` of text, so a
Python worker's memory does not follow the batch size.

Fingerprint records travel as *blobs*: one row for each (writing task, target
partition) with packed arrays, dealt out by ``repartitionById``. The number of
target partitions follows the input's size, so each is of bounded size.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession



def _give_back() -> None:
    """Freed arrays go back to the system at once: workers are reused by later stages, and what an allocator keeps for itself adds up over them."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing with what was freed
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_give_back()


def lean(run):
    """A function over Arrow batches that, when a task is done, returns to the system what the worker's allocator still holds."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return whole


SLICE_BYTES = 1 << 20
FLUSH_BYTES = 48 << 20  # of packed records that a writing task holds
U64 = np.uint64

# ---------------------------------------------------------------- session


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one is set, but only for a local master: on a cluster it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = tempfile.mkdtemp(prefix="riskloom-")
            spark.sparkContext.setCheckpointDir(base)
            atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, codec: str = "lz4") -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends here and every later read sees the same rows."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written; without memory pressure on the driver they would stay."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: str = "8388608"):
    """Arrow batches to Python of at most so many bytes, for what runs inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the rows, without a job; None where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else None


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Target partitions: the session's number, or more where the input's size asks for it."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return max(floor, -(-size // bytes_each)) if size is not None else floor


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: extra columns, clashing names included, stay out of the plan."""
    return docs.select(*[docs[c] for c in cols])


# ---------------------------------------------------------------- text

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()
    offs = np.frombuffer(raw[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each; a longer document stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document): words are runs without separators, cut at document borders."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offs[(offs > 0) & (offs < len(data))]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- fingerprints


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LONG = 256  # bytes from which a word's name is a keyed BLAKE2b digest
TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


class Lane:
    """Seeded 64-bit names of words (runs of bytes) and of runs of k symbols.

    A word is absorbed eight bytes at a time, with the whole state mixed after each step: no algebraic relation between
    places survives, as it does in polynomial fingerprints modulo 2**64. Words of ``LONG`` bytes or more take a keyed BLAKE2b digest.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.start, self.odd, self.sym = (U64(int(x) * 2 + 1) for x in rng.integers(1 << 40, 1 << 62, 3))
        self.key = rng.bytes(16)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        buf = np.empty(len(data) + 8, np.uint8)
        buf[: len(data)], buf[len(data) :] = data, 0
        eight = np.ndarray((len(data) + 1,), "<u8", buf, strides=(1,))  # the 8 bytes at every place
        h = mix(size.astype(U64) * self.odd + self.start)
        h = mix(h ^ (eight[starts] & TAIL[np.minimum(size, 8)]))
        live = np.flatnonzero((size > 8) & (size < LONG))
        at = 8
        while len(live):
            h[live] = mix((h[live] + self.odd) ^ (eight[starts[live] + at] & TAIL[np.minimum(size[live] - at, 8)]))
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size >= LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return h

    def runs(self, symbols: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Names of symbols[at : at + k]."""
        h = np.full(len(at), self.start + U64(k), U64)
        for i in range(k):
            h += symbols[at + i]
            h *= self.sym
            h ^= h >> U64(32)
        return mix(h)


_LANES: dict[int, Lane] = {}


def lane(seed: int) -> Lane:
    if seed not in _LANES:
        _LANES[seed] = Lane(seed)
    return _LANES[seed]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """0..n-1 from the high 32 bits."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def six_bytes(h: np.ndarray) -> bytes:
    """The low 48 bits of each; with the bucket, which the high bits give, they tell fingerprints apart."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it."""
    small = bucket.astype(np.uint16) if n <= 1 << 16 else bucket
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(n + 1))


def run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of runs of equal values."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first], np.diff(np.r_[first, len(x)])


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1, bytes of equal weight together: most are zeros, which the codec takes away."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


# ---------------------------------------------------------------- a bitmap of ids

BITS = 23  # 1 MB


def bitmap_bits(df: DataFrame) -> int:
    """Bits for a bitmap of the rows' ids: about 8 a row of 1 kB, between 128 kB and 4 MB. A fuller map leaves fewer rows out and is as right."""
    return min(25, max(20, ((plan_bytes(df) or 1 << 30) // 128).bit_length()))


def id_bits(ids: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame, col: str, bits: int = BITS, extract=lambda batch: batch.column(0).to_numpy(zero_copy_only=False)) -> bytes:
    """2**bits bits that mark the ids' hashes; 2**(bits-3) bytes whatever the input.

    Used to leave rows out of a join that they cannot match, before the shuffle. An
    id that is not marked is certainly absent (``extract`` takes the ids from a batch); when the map fills up, fewer rows
    are left out and the result is the same.
    """
    parts = 16
    size = (1 << bits) // 8 // parts

    def mark(batches):
        found = np.zeros(1 << bits, bool)
        for b in batches:
            found[id_bits(extract(b), bits)] = True
        packed = np.packbits(found, bitorder="little")
        keep = [p for p in range(parts) if packed[p * size : (p + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([packed[p * size : (p + 1) * size].tobytes() for p in keep], pa.binary())], ["part", "bits"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                total[p] = total[p] | x if p in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "bits"])

    schema = "part int, bits binary"
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in ids.select(col).where(f"{col} is not null").mapInArrow(lean(mark), schema).repartitionById(parts, "part").mapInArrow(lean(merge), schema).toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def in_bitmap(ids: np.ndarray, bitmap: bytes | np.ndarray, bits: int = BITS) -> np.ndarray:
    m = np.frombuffer(bitmap, np.uint8)
    at = id_bits(ids, bits)
    return (m[at >> 3] >> (at & 7)) & 1 != 0
