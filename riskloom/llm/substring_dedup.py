"""Substring deduplication by recompression.

A text is its words' 64-bit names. Recompression names globally: a run of one symbol becomes one symbol, then every pair (x, y) with a coin of x
showing left and a coin of y showing right becomes one symbol; a second round of pairs follows. A symbol's name is a hash of the names of its parts and
a coin is a bit of the name's hash, so all tasks give a run or pair one name without an exchange, and symbols
inside equal substrings are equal wherever these stand, but for a few at either end: where a second-level symbol
begins depends on at most 4 words before that place and 4 from it on. An *anchor* is a second-level symbol with the words beside it, 4 before its
begin and those after it up to 6 from its begin, taken only where the symbols on which the place depends lie among
these 10 words; without longer runs, every window of 13 words holds one.

1. *Reveal*: anchors of all documents are dealt out by name; those in two or more documents are shared.
2. *Verify*: a window of 13 words is a candidate if each anchor inside it is shared (one with no anchor, inside a long
   run, always is). Candidates' 128-bit names are dealt out; a window is to go if a smaller doc_id has the same.
3. Each document drops the words that such windows cover.

A task first compares what it has itself: of equal anchors or windows, one goes on to the shuffle and the answers for
the others are known, so a passage that a third of all documents share is one record a task. Answers go back
to the documents as packed blobs, and only documents that may have an answer (a 1 MB bitmap of ids)
travel to meet them. Lists of all documents' names never reach the driver.

Defined results: a null or empty text has no words, n_words 0 and the hash of the empty string; texts of under 13
words lose none; repeated rows of one doc_id do not remove each other's words; rows with a null doc_id lose none and
remove none, and so do rows with the doc_ids -2**63 and -2**63 + 1, which serve as marks; an empty table gives no rows; a very long text is a slice of its own; extra columns are not read. Window names are 112 bits beyond the partition's, from two
independent names of each word; one is 64 bits long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import U64, bitmap_bits, bucket_of, by_bucket, column_bytes, from_six, id_bitmap, in_bitmap, lane, lean, mix, narrow, partitions_for, remove, run_lengths, shared_dir, six_bytes, slices, small_batches, word_spans, written

WINDOW = 13
BEFORE, AFTER = 4, 6  # words of an anchor before and from a symbol's begin
FLUSH = 3_000_000  # records that a task holds before it deals them out
NULL_ID = -(1 << 63)


def part_of(docs: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(docs.astype(np.int64).view(U64) + U64(0x51ED270B)), n)


def symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Second-level symbols: (where each begins, its words, its name, first and last word on which its begin depends).

    first[i] is the first word of the document that holds word i.
    """
    n = len(words)
    # runs: [s, e)
    s = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (first[1:] != first[:-1])])
    e = np.r_[s[1:], n]
    size = e - s
    name, doc = mix(words[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15)), first[s]
    lo, hi = s - 1, e  # a run is known with the words beside it
    for salt in (1, 2):
        coin = (mix(name + U64(salt * 0xD1B54A32D192ED03 & (1 << 64) - 1)) & U64(1)).astype(bool)
        joins = np.r_[(~coin[:-1] & coin[1:]) & (doc[:-1] == doc[1:]), False] if len(name) else np.zeros(0, bool)
        head = ~np.r_[False, joins[:-1]]
        at = np.flatnonzero(head)
        two = joins[at]
        last = at + two
        # a symbol is known with its neighbours; beyond a document's border nothing is known
        prev_lo = np.where((at > 0) & (doc[np.maximum(at - 1, 0)] == doc[at]), lo[np.maximum(at - 1, 0)], -(1 << 40))
        after = np.minimum(last + 1, len(name) - 1)
        next_hi = np.where((last + 1 < len(name)) & (doc[after] == doc[at]), hi[after], 1 << 40)
        size = np.where(two, size[at] + size[last], size[at])
        new = np.where(two, mix(name[at] * U64(0xA24BAED4963EE407) + name[last] * U64(0x9FB21C651E98DF25) + U64(salt)), name[at])
        if salt == 2:  # where a symbol begins depends on its first part and the one before
            known_hi = hi[at]
            return s[at], size, new, prev_lo, known_hi
        name, doc, s, lo, hi = new, doc[at], s[at], prev_lo, next_hi
    raise AssertionError


def anchors(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each anchor, its name)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    p, size, name, lo, hi = symbols(words, first)
    a = p - BEFORE
    ok = (a >= first[p]) & (p + AFTER <= end[p]) & (lo >= a) & (hi < p + AFTER)
    a, p, size, name = a[ok], p[ok], size[ok], name[ok]
    h = mix(lane(21).runs(words, a, BEFORE) ^ name)
    for i in range(AFTER):  # the words after the symbol
        after = np.flatnonzero(size <= i)
        h[after] = mix(h[after] * U64(0x9E3779B97F4A7C15) + words[p[after] + i])
    return a, h


def inside(p: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """How many of the anchors at p lie inside each window."""
    one = np.zeros(n + 1, np.int64)
    one[p + 1] = 1
    before = np.cumsum(one)  # anchors that begin before a word
    return before[w + WINDOW - (BEFORE + AFTER) + 1] - before[w]


class Slice:
    """Words of a slice of documents: first[i], end[i] are the borders of the document that holds word i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lanes: tuple[int, ...]):
        self.starts, self.ends, self.at = word_spans(data, offs)
        self.names = [lane(x).words(data, self.starts, self.ends) for x in lanes]
        n = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.first, self.end = self.at[:-1][self.doc], self.at[1:][self.doc]

    def windows(self) -> np.ndarray:
        i = np.arange(len(self.doc))
        return i[i + WINDOW <= self.end]


def _ids(col: pa.Array) -> np.ndarray:
    return col.fill_null(NULL_ID).to_numpy()


def _blobs(rows: list[tuple], schema: list[str]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "doc_id": pa.int64(), "kind": pa.int32(), "text": pa.string()}
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(s, pa.binary())) for c, s in zip(cols, schema)], schema)


DEALT = ["part", "docs", "runs", "low", "high", "known_docs", "known"]
DEALT_SCHEMA = "part int, docs binary, runs binary, low binary, high binary, known_docs binary, known binary"


def _answers(docs: np.ndarray, keys: np.ndarray, n: int) -> dict[int, tuple[bytes, bytes]]:
    """For each target partition of documents: the documents and the distinct keys for them."""
    out = {}
    part = part_of(docs, n)
    order, at = by_bucket(part, n)
    for b in np.flatnonzero(np.diff(at)).tolist():
        mine = order[at[b] : at[b + 1]]
        out[b] = (np.unique(docs[mine]).astype("<i8").tobytes(), np.unique(keys[mine]).astype("<u8").tobytes())
    return out


def _deal(h: np.ndarray, h2: np.ndarray | None, docs: np.ndarray, known: dict[int, tuple[bytes, bytes]], n: int) -> pa.RecordBatch:
    """One row a partition: packed names with their documents (run lengths), and answers known already that pass through."""
    order = np.lexsort((docs, bucket_of(h, n)))
    h, docs, h2 = h[order], docs[order], None if h2 is None else h2[order]
    at = np.searchsorted(bucket_of(h, n), np.arange(n + 1))
    rows = []
    for b in range(n):
        x = slice(at[b], at[b + 1])
        if at[b] == at[b + 1] and b not in known:
            continue
        ids, runs = run_lengths(docs[x])
        rows.append((b, ids.astype("<i8").tobytes(), runs.astype("<u4").tobytes(), six_bytes(h[x]), b"" if h2 is None else h2[x].astype("<u8").tobytes(), *known.get(b, (b"", b""))))
    return _blobs(rows, DEALT)


def _gather(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes, bytes]]]:
    """All records of a partition: low names, high names, documents; and answers that pass through."""
    low, high, docs, known = [], [], [], []
    for batch in batches:
        for part, ids, runs, lo, hi, kd, k in zip(batch.column(0).to_pylist(), *[batch.column(i).to_pylist() for i in range(1, 7)]):
            low.append(from_six(lo))
            high.append(np.frombuffer(hi, "<u8"))
            docs.append(np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(runs, "<u4")))
            if k:
                known.append((part, kd, k))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(low, U64), cat(high, U64), cat(docs, np.int64), known


# ---------------------------------------------------------------- step 1: shared anchors


def shared_anchors(texts: DataFrame, n: int) -> DataFrame:
    """(part, docs, keys): for each partition of documents, names of anchors that two or more documents have. A key is an anchor's low 48 bits."""

    def deal(batches):
        held_h, held_d, bare, size = [], [], [], 0

        def flush():
            h, d = np.concatenate(held_h), np.concatenate(held_d)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(h) else np.zeros(0, bool)
            mine = np.repeat(several, np.diff(np.r_[at, len(h)]))
            # documents with windows that hold no anchor get an answer in any case, of a name that stands for none
            lone = np.unique(np.concatenate([np.zeros(0, np.int64), *bare]))
            known = _answers(np.r_[d[mine], lone], np.r_[h[mine] & U64((1 << 48) - 1), np.zeros(len(lone), U64)], n)
            # shared here: one record under an id that no document has makes it shared for others too
            return _deal(h[at], None, np.where(several, NULL_ID + 1, d[at]), known, n)

        for batch in batches:
            ids = _ids(batch.column(0))
            data, offs = column_bytes(batch.column(1))
            for a, b in slices(offs):
                s = Slice(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], (31,))
                p, h = anchors(s.names[0], s.first, s.end)
                w = s.windows()
                w = w[inside(p, len(s.doc), w) == 0]
                if len(w):
                    bare.append(np.unique(ids[a:b][s.doc[w]]))
                    size += len(bare[-1])
                held_h.append(h)
                held_d.append(ids[a:b][s.doc[p]])
                size += len(p)
                if size > FLUSH:
                    yield flush()
                    held_h, held_d, bare, size = [], [], [], 0
        if size:
            yield flush()

    def find(batches):
        h, _, d, known = _gather(batches)
        yield _blobs(known, ["part", "docs", "keys"])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if not len(h):
            return
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
        shared = np.repeat((low != high) | (low == NULL_ID + 1), np.diff(np.r_[at, len(h)])) & (d != NULL_ID + 1)
        out = _answers(d[shared], h[shared], n)
        yield _blobs([(b, *x) for b, x in out.items()], ["part", "docs", "keys"])

    return texts.mapInArrow(lean(deal), DEALT_SCHEMA).repartitionById(n, "part").mapInArrow(lean(find), "part int, docs binary, keys binary")


def _doc_ids(batch) -> np.ndarray:
    got = [np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def meet(texts: DataFrame, answers: DataFrame, bitmap: bytes, n: int, bits: int) -> DataFrame:
    """(kind, doc_id, text, keys) with each partition's answers (kind 0) before its texts (kind 1)."""

    def choose(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            keep = np.flatnonzero(in_bitmap(ids, bitmap, bits) & (ids != NULL_ID))
            part = part_of(ids[keep], n).astype(np.int32)
            m = len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(m, np.int32)), batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.nulls(m, pa.binary())], ["part", "kind", "doc_id", "text", "keys"])

    schema = "part int, kind int, doc_id long, text string, keys binary"
    both = texts.mapInArrow(lean(choose), schema).unionByName(answers.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "keys"))
    return both.repartitionById(n, "part").sortWithinPartitions("kind").select("kind", "doc_id", "text", "keys")


def _met(batches):
    """(keys, ids, text column) of each batch of texts, once all answers of the partition are in."""
    held, keys = [], None
    for batch in batches:
        kind = batch.column(0).to_numpy()
        m = int((kind == 0).sum())
        held += [np.frombuffer(x, "<u8") for x in batch.column(3).slice(0, m).to_pylist()]
        if m < len(batch):
            if keys is None:
                keys = np.unique(np.concatenate(held)) if held else np.zeros(0, U64)
            rest = batch.slice(m)
            yield keys, _ids(rest.column(1)), rest.column(2)


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


# ---------------------------------------------------------------- step 2: windows


def candidates(s: Slice, keys: np.ndarray) -> np.ndarray:
    """Windows of which every anchor is shared."""
    p, h = anchors(s.names[0], s.first, s.end)
    w = s.windows()
    return w[inside(p[~among(h & U64((1 << 48) - 1), keys)], len(s.doc), w) == 0]


def window_key(name: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return mix(name ^ mix(docs.astype(np.int64).view(U64) + U64(0x2545F491)))


def later_windows(met: DataFrame, n: int) -> DataFrame:
    """(part, docs, keys): a key is a window of a document that a smaller doc_id has too."""

    def deal(batches):
        held, size = [], 0

        def flush():
            f1, f2, d = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, f2, f1))
            f1, f2, d = f1[order], f2[order], d[order]
            new = np.r_[True, (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])]
            at = np.flatnonzero(new)
            least = np.repeat(d[at], np.diff(np.r_[at, len(d)]))
            later = d > least
            return _deal(f1[at], f2[at], d[at], _answers(d[later], window_key(f2[later], d[later]), n), n)

        for keys, ids, col in _met(batches):
            data, offs = column_bytes(col)
            for a, b in slices(offs):
                s = Slice(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], (31, 32))
                w = candidates(s, keys)
                if len(w):
                    held.append((lane(22).runs(s.names[0], w, WINDOW), lane(23).runs(s.names[1], w, WINDOW), ids[a:b][s.doc[w]]))
                    size += len(w)
                if size > FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def find(batches):
        f1, f2, d, known = _gather(batches)
        yield _blobs(known, ["part", "docs", "keys"])
        if not len(d):
            return
        order = np.lexsort((d, f2, f1))
        f1, f2, d = f1[order], f2[order], d[order]
        at = np.flatnonzero(np.r_[True, (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])])
        later = d > np.repeat(d[at], np.diff(np.r_[at, len(d)]))
        out = _answers(d[later], window_key(f2[later], d[later]), n)
        yield _blobs([(b, *x) for b, x in out.items()], ["part", "docs", "keys"])

    return met.mapInArrow(lean(deal), DEALT_SCHEMA).repartitionById(n, "part").mapInArrow(lean(find), "part int, docs binary, keys binary")


# ---------------------------------------------------------------- step 3: what is left

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]


def _result(ids, words: list[list[bytes]], kept: list[list[bytes]], with_text: bool) -> pa.RecordBatch:
    joined = [b" ".join(k) for k in kept]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(w) for w in words], pa.int64()),
            pa.array([len(w) - len(k) for w, k in zip(words, kept)], pa.int64()),
            pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
            pa.array([j.decode() for j in joined] if with_text else [None] * len(joined), pa.string()),
        ],
        NAMES,
    )


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space)."""
    folder = shared_dir(docs.sparkSession)
    texts = narrow(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    n = partitions_for(texts, 8 << 20)
    known = texts.where("doc_id is not null")
    bits = bitmap_bits(texts)
    with small_batches(docs.sparkSession):
        shared = written(shared_anchors(known, n), f"{folder}/anchors")
        near = meet(known, shared, id_bitmap(shared, "docs", bits, _doc_ids), n, bits)
        later = written(later_windows(near, n), f"{folder}/windows")
        marked = id_bitmap(later, "docs", bits, _doc_ids)
    remove(docs.sparkSession, f"{folder}/anchors")

    def untouched(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            keep = pa.array(np.flatnonzero(~in_bitmap(ids, marked, bits) | (ids == NULL_ID)))
            mine, col = batch.column(0).take(keep), batch.column(1).take(keep)
            data, offs = column_bytes(col)
            for a, b in slices(offs):
                words = [data[offs[i] : offs[i + 1]].tobytes().split() for i in range(a, b)]
                yield _result(mine.slice(a, b - a), words, words, with_text)

    def touched(batches):
        for keys, ids, col in _met(batches):
            data, offs = column_bytes(col)
            for a, b in slices(offs):
                s = Slice(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], (32,))
                w = s.windows()
                w = w[among(window_key(lane(23).runs(s.names[0], w, WINDOW), ids[a:b][s.doc[w]]), keys)]
                cover = np.zeros(len(s.doc) + 1, np.int64)
                cover[w] += 1
                cover[w + WINDOW] -= 1
                stays = np.cumsum(cover)[:-1] == 0
                words = [data[offs[i] : offs[i + 1]].tobytes().split() for i in range(a, b)]
                kept = [[x for x, k in zip(v, stays[s.at[i] : s.at[i + 1]].tolist()) if k] for i, v in enumerate(words)]
                yield _result(pa.array(ids[a:b]), words, kept, with_text)

    return texts.mapInArrow(lean(untouched), RESULT).unionByName(meet(known, later, marked, n, bits).mapInArrow(lean(touched), RESULT))
