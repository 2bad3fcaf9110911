"""Packing by concatenate and cut.

Pass 1 encodes each document once, in the order of its input partition, and writes ids with the
running number of ids before them in that partition. The partitions' totals are summed
to global offsets: one number for each writing task. Pass 2 reads the written
table, so both passes see one order even if tasks are run again, and cuts the endless
concatenation into windows of ``length`` ids. A document on a border leaves a piece on either
side of it: its boundary records.

All sequences but the last are full, so padding is less than one sequence in the whole output.

Defined results: a null or empty text is its end id alone; null and repeated doc_ids are packed like
others, a row for each; an empty table gives no pieces. A very long text becomes many pieces. Extra
columns are not read. Memory: a slice of 1 MB of text, or one document, and the
table of known pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskloom.llm.common import SLICE_BYTES, column_bytes, lean, narrow, shared_dir, small_batches, written
from riskloom.llm.encoder import encoded, forget

TOKENS = "part int, doc_id long, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, starts_document boolean, ends_document boolean, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pass 1: (part, doc_id, before, n_tokens, ids), ids as little-endian unsigned 16-bit numbers where they fit, else 32-bit (see ``unpack``)."""

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of = batch.column(0)
            for a, b, ids, at in encoded(column_bytes(batch.column(1)), tokenizer, end_id):
                starts = before + at[:-1]
                blobs = [pack_ids(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), ids_of.slice(a, b - a), pa.array(starts), pa.array(np.diff(at)), pa.array(blobs, pa.binary())],
                    ["part", "doc_id", "before", "n_tokens", "ids"],
                )
                before += int(at[-1])
        forget()

    return narrow(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), TOKENS)


def pack_ids(ids: np.ndarray) -> bytes:
    """A width byte (2 or 4) and the ids."""
    wide = len(ids) and ids.max() > 0xFFFF
    return (b"\x04" + ids.astype("<u4").tobytes()) if wide else (b"\x02" + ids.astype("<u2").tobytes())


def unpack(blob) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if blob[0] == 4 else "<u2", offset=1).astype("<u4")


def totals(tokens: DataFrame, part: str = "part") -> tuple[np.ndarray, np.ndarray]:
    """(parts, ids before each part): one row for each writing task comes to the driver."""
    rows = sorted(tuple(r) for r in tokens.groupBy(part).agg({"n_tokens": "sum"}).collect())
    return np.array([r[0] for r in rows], np.int64), np.r_[0, np.cumsum([r[1] for r in rows])].astype(np.int64)


def cut(tokens: DataFrame, length: int, with_ids: bool = True) -> DataFrame:
    """Pass 2: pieces of the windows, from the written table of pass 1."""
    parts, base = totals(tokens)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(10)]
            size = 0
            part, doc, before, blobs = (batch.column(i) for i in (0, 1, 2, 4))
            begin = base[np.searchsorted(parts, part.to_numpy())] + before.to_numpy()
            for d, g, blob in zip(doc.to_pylist(), begin.tolist(), blobs):
                ids = unpack(memoryview(blob.as_buffer()))
                at, n = 0, len(ids)
                while at < n:
                    seq, off = divmod(g + at, length)
                    m = min(n - at, length - off)
                    raw = ids[at : at + m].tobytes()
                    for c, v in zip(cols, (d, at, m, zlib.crc32(raw), n, seq, off, at == 0, at + m == n, raw if with_ids else None)):
                        c.append(v)
                    at += m
                    size += 64 + 4 * m * with_ids
                    if size > SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                        cols, size = [[] for _ in range(10)], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    types = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
    names = [f.split()[0] for f in PIECES.split(", ")]
    return tokens.mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: which ids of which document stand where in which sequence."""
    folder = shared_dir(docs.sparkSession)
    with small_batches(docs.sparkSession):
        tokens = written(tokenized(docs, tokenizer, end_id), f"{folder}/tokens")
    return cut(tokens, length, with_ids)
