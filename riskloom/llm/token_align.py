"""Alignment of two tokenizers' tokens of the same texts.

Pass 1 encodes each text twice, as A (byte-level) and B (sentencepiece, which sees the text with a leading space, so A gets
one too), and merges the two ascending lists of token ends on the byte axis. Where both lists hold an end, a group closes. Between two
neighbouring ends of the merged list lies exactly one token of either side, and each overlapping pair of tokens shares exactly one such stretch: it is a link.

Documents travel in *chunks*, rows of about ``CHUNK_BYTES`` of text or one longer document: the documents' figures, their links as places in the chunk's list of
distinct pairs, and that list with its counts. Pass 2 is plain Spark: pairs are summed by (A id, B id), the highest count of each A id and each
B id is joined to them, and counts and marks go back to the chunks that hold the pair. A chunk's list then gives each document its sums. What
moves is a chunk's distinct pairs, never a row a link; no key holds more than one row of a chunk, or one vocabulary of rows.

Defined results: a text that is null or empty, or whose joined A or B bytes are not space+text (as where it holds U+2581), has no tokens: zeros and
an empty digest, and its tokens count nowhere. The strings of special tokens are plain text. Null and repeated doc_ids are rows like others; an empty table
gives no rows; extra columns are not read. Ties for the highest count all count as best. A very long text is a chunk of its own.
Memory: a chunk's links, or those of one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import column_bytes, lean, narrow, packed, run_lengths, shared_dir, slices, small_batches, unpacked, written
from riskloom.llm.encoder import Subwords, encoder, forget

CHUNK_BYTES = 4 << 20
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def token_bytes(enc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each id's begin, their length) of a vocabulary."""
    if isinstance(enc, Subwords):
        sp = enc.library
        names = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size())}
        table = {i: bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in names.items()}
    else:
        byte = {c: b for b, c in enc.chars.items()}
        table = {i: bytes(byte[c] for c in t) for t, i in enc.library.get_vocab(with_added_tokens=False).items()}
    size = np.zeros(max(table) + 1, np.int64)
    for i, b in table.items():
        size[i] = len(b)
    return np.frombuffer(b"".join(table.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size, size


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then those of begin[1], and so on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = [encoder(path_a, True), encoder(path_b, True)]
        self.bytes = [token_bytes(e) for e in self.sides]
        top = max(len(t[2]) for t in self.bytes)
        self.text = np.array([b"%d%c" % (i, c) for i in range(top) for c in b",|;"], object)

    def spell(self, side: int, ids: np.ndarray) -> np.ndarray:
        pool, begin, size = self.bytes[side]
        return pool[_ranges(begin[ids], size[ids])]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(documents with tokens, their bytes with the space, ids of A and B, tokens of each document of A and B)."""
        docs = np.flatnonzero(np.diff(offs))
        size = np.diff(offs)[docs] + 1
        at = np.r_[0, np.cumsum(size)]
        spaced = np.full(at[-1], 0x20, np.uint8)
        body = np.ones(at[-1], bool)
        body[at[:-1]] = False
        spaced[body] = data
        ids, each = (list(x) for x in zip(*[e.encode(spaced, at) for e in self.sides]))
        good = np.ones(len(docs), bool)
        for s in (0, 1):
            length = self.bytes[s][2][ids[s]]
            total = np.diff(np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(each[s])]])
            good &= total == size
            mine = np.repeat(good, each[s])  # as far as lengths agree, bytes are compared place by place
            wrong = self.spell(s, ids[s][mine].astype(np.int64)) != spaced[np.repeat(good, size)]
            if wrong.any():
                rest = np.flatnonzero(good)
                good[rest[np.unique(np.searchsorted(np.cumsum(size[rest]), np.flatnonzero(wrong), "right"))]] = False
        return docs[good], size[good], [ids[s][np.repeat(good, each[s])].astype(np.int64) for s in (0, 1)], [each[s][good] for s in (0, 1)]

    def merge(self, ids: list[np.ndarray], total: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
        """(token ends of each side, ends in the merged list, which of them close a group, the token of each side that stands before each)."""
        ends = [np.cumsum(self.bytes[s][2][ids[s]]) for s in (0, 1)]
        has = np.zeros((2, total + 1), bool)
        for s in (0, 1):
            has[s, ends[s]] = True
        merged = np.flatnonzero(has[0] | has[1])
        here = has[:, merged]
        return ends, merged, here[0] & here[1], [np.cumsum(h) - h for h in here]  # a pointer moves on after its token's end

    def align(self, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        """Figures and digests of every document, and the links in order: A id, B id, document."""
        n = len(offs) - 1
        out = {c: np.zeros(n, np.int64) for c in FIGURES} | {"sha": np.full(n, "", object)}
        docs, size, ids, each = self.encode(data, offs)
        if not len(docs):
            return out | {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64)}
        borders = np.cumsum(size)
        ends, merged, closes, token = self.merge(ids, int(borders[-1]))
        owner = np.searchsorted(borders, merged)
        out["n_a"][docs], out["n_b"][docs] = each
        out["n_groups"][docs], out["n_links"][docs] = np.bincount(owner[closes], minlength=len(docs)), np.bincount(owner, minlength=len(docs))
        # the tokens of a group in writing order: its A ids, then its B ids
        limits = merged[closes]
        group = [np.searchsorted(limits, e) for e in ends]
        count = [np.bincount(g, minlength=len(limits)) for g in group]
        written_ids = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        last = [np.r_[g[1:] != g[:-1], True] for g in group]
        written_ids[np.arange(len(ids[0])) + (np.cumsum(count[1]) - count[1])[group[0]]] = ids[0] * 3 + last[0]
        written_ids[np.arange(len(ids[1])) + np.cumsum(count[0])[group[1]]] = ids[1] * 3 + 2 * last[1]
        shown = self.text[written_ids].tolist()
        at = np.r_[0, np.cumsum(each[0] + each[1])].tolist()
        out["sha"][docs] = [hashlib.sha256(b"".join(shown[x:y])[:-1]).hexdigest() for x, y in zip(at[:-1], at[1:])]
        return out | {"a": ids[0][token[0]], "b": ids[1][token[1]], "doc": docs[owner]}

    def groups(self, text: str) -> list[tuple[list[int], list[int], int]]:
        """One text's groups: A ids, B ids, and the byte of space+text at which the group ends."""
        data = np.frombuffer(text.encode(), np.uint8)
        docs, size, ids, _ = self.encode(data, np.array([0, len(data)]))
        if not len(docs):
            return []
        ends, merged, closes, _ = self.merge(ids, int(size[0]))
        cuts = [np.searchsorted(e, merged[closes], "right") for e in ends]
        return [(a.tolist(), b.tolist(), int(e)) for a, b, e in zip(np.split(ids[0], cuts[0][:-1]), np.split(ids[1], cuts[1][:-1]), merged[closes])]


CHUNKS = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_held long, held binary, times binary, pairs array<struct<a:int,b:int,n:long>>"


def _chunk_row(number: int, ids: list, parts: list[dict]) -> pa.RecordBatch:
    each = np.concatenate([p["n_links"] for p in parts])
    a, b = (np.concatenate([p[c] for p in parts]) for c in "ab")
    distinct, place, n = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
    linked = np.repeat(np.cumsum(each > 0) - 1, each)  # links come in the order of documents
    held, times = run_lengths(np.sort(linked * len(distinct) + place.reshape(-1)))
    pairs = pa.StructArray.from_arrays([pa.array((distinct >> 32).astype(np.int32)), pa.array((distinct & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])
    columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
    columns += [pa.array([np.concatenate([p[c] for p in parts])], pa.list_(pa.int64())) for c in FIGURES]
    columns += [pa.array([np.concatenate([p["sha"] for p in parts]).tolist()], pa.list_(pa.string()))]
    columns.append(pa.array([len(held)], pa.int64()))
    columns += [pa.array([packed(x)], pa.binary()) for x in (np.diff(held, prepend=0), times)]
    columns.append(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pairs))
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CHUNKS.split(", ")])


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Pass 1: one row for each chunk of documents."""

    def run(batches):
        aligner = Aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0
        for batch in batches:
            of = batch.column(0).to_pylist()
            data, offs = column_bytes(batch.column(1))
            for x, y in slices(offs):
                ids += of[x:y]
                parts.append(aligner.align(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x]))
                size += int(offs[y] - offs[x]) + y - x
                if size >= CHUNK_BYTES:
                    yield _chunk_row(number, ids, parts)
                    number, ids, parts, size = number + 1, [], [], 0
        if parts:
            yield _chunk_row(number, ids, parts)
        forget()

    return narrow(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), CHUNKS)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """(a, b, links, best_a, best_b): each id pair's links in the corpus, and the highest count of its A id and of its B id."""
    counts = chunked.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("links"))
    counts = written(counts, f"{shared_dir(chunked.sparkSession)}/counts")
    for side in "ab":
        counts = counts.join(counts.groupBy(side).agg(F.max("links").alias(f"best_{side}")), side)
    return counts.select("a", "b", "links", "best_a", "best_b")


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string"


def _document_sums(batches):
    for batch in batches:
        for row in batch.to_pylist():
            links, best_b, best_a = (np.array([k[c] for k in row["known"] or []], np.int64) for c in ("links", "best_b", "best_a"))
            each = np.array(row["n_links"], np.int64)
            held = np.cumsum(unpacked(row["held"], row["n_held"]))
            times = unpacked(row["times"], row["n_held"])
            docs, place = np.divmod(held, max(len(links), 1))
            out = np.zeros((3, len(each)), np.int64)
            if len(held):
                first = np.flatnonzero(np.diff(docs, prepend=-1))
                for o, x in zip(out, (times * best_b[place], times * best_a[place], times * links[place])):
                    o[each > 0] = np.add.reduceat(x, first)
            cols = [row["doc_id"], *[row[c] for c in FIGURES], *out, row["groups_sha256"]]
            types = [pa.int64()] * 8 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in OUT.split(", ")])


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document: tokens, groups and links, how many links are the best of their B id (n_best) and of their A id, the sum of their counts, and the groups' digest."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    with small_batches(spark):
        done = written(chunks(docs, path_a, path_b), f"{folder}/chunks")
    counts = pair_counts(done)
    mine = done.select("chunk", F.posexplode("pairs").alias("place", "p")).select("chunk", "place", "p.a", "p.b")
    known = F.struct("place", "links", (F.col("links") == F.col("best_b")).cast("int").alias("best_b"), (F.col("links") == F.col("best_a")).cast("int").alias("best_a"))
    told = mine.join(counts, ["a", "b"]).groupBy("chunk").agg(F.array_sort(F.collect_list(known)).alias("known"))
    return done.drop("pairs").join(told, "chunk", "left").mapInArrow(lean(_document_sums), OUT)
