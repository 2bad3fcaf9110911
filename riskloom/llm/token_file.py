"""Token files of directly addressable codes.

Format of a shard (all numbers little-endian): magic ``DAC1``; u32 chunk bits (8), u32 levels; u64 tokens,
u64 documents; i64 doc_ids; u64 starts (documents + 1: first token of each document in the shard); then
for each level u64 codes, its chunks as u8, and but for the last level its continuation bits (bit i set: code
i goes on one level higher; 8 in a byte, low bit first) and its rank directory (u32: bits set before every block of
512). Token i is read from level 0 at i; while its bit is set, its place in the next level is the
rank of that bit, from one directory entry and at most 64 bytes of bits. ``Shard.token`` and
``Shard.document`` read that way without decoding anything else; so does ``read_tokens``.

Writing: documents are encoded once, dealt to ranges of doc_id whose borders are quantiles of all doc_ids,
sorted inside each range, and written as shards of about ``shard_tokens`` ids (one document at least).
Shards are the rows of a Parquet table, stored as they are, without compression or dictionary, so Spark's committer makes the write safe against lost
executors and any store that Spark reaches will do. Range totals, one number a partition, give the
global offsets.

Defined results: a null or empty text is its end id alone; rows with null doc_ids stand first; repeated
doc_ids stand together, ordered by length and ids; an empty table writes no shard and reads as no rows. Extra
columns are not read. The file marks a null doc_id by -2**63, so a row with that id is read back as one with none.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import column_bytes, lean, narrow, partitions_for, shared_dir
from riskloom.llm.encoder import encoded, forget
from riskloom.llm.packing import pack_ids, totals, unpack

BLOCK = 512
BITS_IN = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_shard(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        goes_on = more != 0
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8)
        if not goes_on.any():
            levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes())
            break
        packed = np.packbits(goes_on, bitorder="little")
        packed = np.r_[packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)]
        ranks = np.r_[0, np.cumsum(BITS_IN[packed].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))[:-1]].astype("<u4")
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + packed.tobytes() + ranks.tobytes())
        rest = more[goes_on]
    head = b"DAC1" + struct.pack("<IIQQ", bits, len(levels), len(ids), len(doc_ids))
    return head + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + b"".join(levels)


class Shard:
    def __init__(self, raw: bytes):
        self.raw = raw
        if raw[:4] != b"DAC1":
            raise ValueError("not a shard of directly addressable codes")
        self.bits, levels, self.n, docs = struct.unpack_from("<IIQQ", raw, 4)
        at = 28
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            chunk, at = np.frombuffer(raw, np.uint8, n, at + 8), at + 8 + n
            if level == levels - 1:
                self.levels.append((chunk, None, None))
                break
            size = -(-n // BLOCK) * (BLOCK // 8)
            packed, at = np.frombuffer(raw, np.uint8, size, at), at + size
            ranks, at = np.frombuffer(raw, "<u4", size // (BLOCK // 8), at), at + size // (BLOCK // 8) * 4
            self.levels.append((chunk, packed, ranks))

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level: one directory entry and at most 64 bytes of bits."""
        _, packed, ranks = self.levels[level]
        if i // BLOCK >= len(ranks):  # just past the end, on a block's border
            return int(ranks[-1]) + int(BITS_IN[packed[(i // BLOCK - 1) * (BLOCK // 8) :]].sum()) if len(ranks) else 0
        block = i // BLOCK * (BLOCK // 8)
        part = bin(int(packed[i >> 3]) & ((1 << (i & 7)) - 1)).count("1") if i & 7 else 0
        return int(ranks[i // BLOCK]) + int(BITS_IN[packed[block : i >> 3]].sum()) + part

    def token(self, i: int) -> int:
        out = shift = 0
        for level, (chunk, packed, _) in enumerate(self.levels):
            out |= int(chunk[i]) << shift
            if packed is None or not packed[i >> 3] >> (i & 7) & 1:
                return out
            i, shift = self.rank(level, i), shift + self.bits
        return out

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi - 1: of each level only the codes that they have there, found by the rank of lo."""
        out = np.zeros(hi - lo, np.uint32)
        at, shift = None, 0
        for level, (chunk, packed, _) in enumerate(self.levels):
            codes = chunk[lo:hi].astype(np.uint32) << np.uint32(shift)
            if at is None:
                out |= codes
            else:
                out[at] |= codes
            if packed is None or lo == hi:
                return out
            bits = np.unpackbits(packed[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo]
            more = np.flatnonzero(bits)
            at = more if at is None else at[more]
            lo = self.rank(level, lo)
            hi, shift = lo + len(more), shift + self.bits
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))

    def all(self) -> np.ndarray:
        return self.span(0, self.n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = 1 << 20) -> None:
    """Write shards in ascending order of doc_id: rows (part, shard, local_start, n_tokens, payload) at ``path``."""
    docs = narrow(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    n = partitions_for(docs, 24 << 20)
    found = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10000)).first()[0] if n > 1 else None
    borders = np.unique(np.array(found or [], np.int64))

    def tokens(batches):
        for batch in batches:
            doc = batch.column(0)
            known = doc.fill_null(-(1 << 63)).to_numpy()
            part = np.searchsorted(borders, known, "left").astype(np.int32)
            for a, b, ids, at in encoded(column_bytes(batch.column(1)), tokenizer, end_id):
                blobs = [pack_ids(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), doc.slice(a, b - a), pa.array(blobs, pa.binary())], ["part", "doc_id", "ids"])
        forget()

    def shards(batches):
        held, size, local, number, part = [], 0, 0, 0, None

        def flush():
            nonlocal held, size, local, number
            ids = [unpack(x) for _, x in held]
            starts = np.r_[0, np.cumsum([len(x) for x in ids])]
            # a null doc_id is held as the smallest number
            raw = encode_shard(np.array([d for d, _ in held], np.int64), starts, np.concatenate(ids))
            row = [[part], [number], [local], [int(starts[-1])], [raw]]
            local, number, held, size = local + int(starts[-1]), number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "shard", "local_start", "n_tokens", "payload"])

        for batch in batches:
            for p, d, x in zip(batch.column(0).to_pylist(), batch.column(1).fill_null(-(1 << 63)).to_pylist(), batch.column(2)):
                raw = x.as_py()
                if held and size + len(raw) > 2 * shard_tokens:
                    yield flush()
                part = p
                held.append((d, raw))
                size += len(raw)
        if held:
            yield flush()

    dealt = docs.mapInArrow(lean(tokens), "part int, doc_id long, ids binary").repartitionById(n, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("ids"), "ids")
    dealt.mapInArrow(lean(shards), "part int, shard int, local_start long, n_tokens long, payload binary").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the shards at ``path``."""
    table = spark.read.schema("part int, shard int, local_start long, n_tokens long, payload binary").parquet(path)
    parts, base = totals(table)

    def run(batches):
        for batch in batches:
            for part, local, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4)):
                s = Shard(raw.as_py())
                at = s.starts
                blobs = [s.document(k).astype("<u4").tobytes() for k in range(len(s.doc_ids))]
                start = int(base[np.searchsorted(parts, part)]) + local + at[:-1]
                doc = pa.array(s.doc_ids, mask=s.doc_ids == -(1 << 63))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(np.diff(at)), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(blobs if with_ids else [None] * len(blobs), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return table.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
