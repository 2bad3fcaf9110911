"""Ranked lexical search with block-max pruning.

``index`` cuts the documents, in the order of their partitions, into *blocks* of at most ``BLOCK_DOCS`` documents and about ``BLOCK_BYTES`` of text. A
block is one row: its dictionary, a forward index (each document's terms and how often), and for each term the number of documents that hold
it, the most often it stands in one of them, and the fewest terms of a document that holds it. No document can get more from a term than these two
allow, so an item's sum over its terms bounds the score of every document of the block.

``search`` takes the items in batches of bounded size. (1) One pass over the dictionaries counts the documents of the batch's terms; with the number of documents and
of all their terms that gives the weights. (2) Bounds are taken from the maxima alone; the block of each item's highest bound is
scored, and an item's k-th best score so far is its threshold. (3) Every task sorts its blocks by each item's bound and scores
forward-index blocks from the highest down, until the bound drops below the threshold, which rises with what the task finds. A block whose bound
equals the threshold is scored, so ties are whole. The tasks' best, k for each item at most, are merged.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), in doubles; all else is in integers: a document of n terms has m = 10 + 90 n N div L, a term that stands tf times in it
scores weight * (10**9 tf div (1000 tf + 8 m)).

Defined results: a null or empty text has no terms and is never found; a document is found only with a score above 0. Rows that repeat a doc_id are documents of
their own; a null doc_id comes last among equal scores. Items that repeat an id are one item with the terms of all; a null id is an item like others, a null text has
no terms and no rows. With fewer than k documents above 0, all are returned; empty tables give no rows. A very long document is a block of its own. Extra
columns are not read. Terms are told apart by their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, column_bytes, lane, lean, narrow, packed, run_lengths, shared_dir, slices, small_batches, unpacked, word_spans, written

BLOCK_DOCS = 64
BLOCK_BYTES = 256 << 10
SEGMENT = 32  # blocks that a task holds and sorts at a time
BATCH_TERMS = 200_000  # (item, term) rows of a batch of items
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCKS = "block long, docs int, with_terms long, all_terms long, doc_id array<long>, n_terms binary, terms binary, sizes binary, n_distinct int, holders binary, most binary, fewest binary, held binary, times binary, n_held int"


# ---------------------------------------------------------------- index


def _block(number: int, ids: list, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, OUTSIDE)
    n = np.diff(first)
    name, second = lane(51).words(low, starts, ends) if len(starts) else np.zeros(0, np.uint64), lane(52).words(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(name, kind="stable")
    a, b = name[order], second[order]
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    if len(a) and ((b[1:] != b[:-1]) & ~new[1:]).any():  # two words of one name
        order = np.lexsort((second, name))
        a, b = name[order], second[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    term = np.empty(len(a), np.int64)
    term[order] = np.cumsum(new) - 1
    word = order[new]
    size = (ends - starts)[word]
    spelled = low[np.repeat(starts[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    held, times = run_lengths(np.sort(np.repeat(np.arange(len(n)), n) * max(len(word), 1) + term))
    doc, of = np.divmod(held, max(len(word), 1))
    most, fewest = np.zeros(len(word), np.int64), np.full(len(word), np.iinfo(np.int64).max)
    np.maximum.at(most, of, times)
    np.minimum.at(fewest, of, n[doc])
    values = [number, len(n), int((n > 0).sum()), int(n.sum()), ids, packed(n), spelled.tobytes(), packed(size), len(word), packed(np.bincount(of, minlength=len(word))), packed(most), packed(fewest), packed(np.diff(held, prepend=0)), packed(times), len(held)]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [f.split()[0] for f in BLOCKS.split(", ")])


def index(docs: DataFrame, path: str) -> DataFrame:
    """The blocks of all documents, written under ``path``."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            of = batch.column(0).to_pylist()
            data, offs = column_bytes(batch.column(1))
            for x, y in slices(offs, BLOCK_BYTES):
                for a in range(x, y, BLOCK_DOCS):
                    b = min(a + BLOCK_DOCS, y)
                    yield _block(number, of[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    number += 1

    with small_batches(docs.sparkSession):
        return written(narrow(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), BLOCKS), path)


# ---------------------------------------------------------------- search


class Items:
    """A batch of items: their distinct terms, and for each item the places of its terms among these."""

    def __init__(self, rows: list[tuple]):
        self.terms = sorted({r[1].encode() for r in rows})
        place = {t: i for i, t in enumerate(self.terms)}
        by_item: dict = {}
        for item, t in rows:
            by_item.setdefault(item, []).append(place[t.encode()])
        self.ids = sorted(by_item, key=lambda i: (i is None, i))
        self.of = [np.array(sorted(by_item[i]), np.int64) for i in self.ids]
        data, ends = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum([len(t) for t in self.terms])
        names = lane(51).words(data, np.r_[0, ends[:-1]], ends)
        self.order = np.argsort(names, kind="stable")
        self.names = names[self.order]

    def weigh(self, held_by: dict[int, int], docs: int, all_terms: int) -> None:
        self.docs, self.all_terms = docs, all_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * held_by.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64)

    def match(self, terms: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in a block's dictionary, places among the batch's terms) of the terms that both hold."""
        ends = np.cumsum(size)
        data = np.frombuffer(terms, np.uint8)
        names = lane(51).words(data, ends - size, ends)
        here, there = [], []
        left, right = np.searchsorted(self.names, names, "left"), np.searchsorted(self.names, names, "right")
        for i in np.flatnonzero(left < right).tolist():
            word = terms[ends[i] - size[i] : ends[i]]
            for j in range(left[i], right[i]):
                if self.terms[self.order[j]] == word:
                    here.append(i)
                    there.append(int(self.order[j]))
        return np.array(here, np.int64), np.array(there, np.int64)

    def part(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term that stands ``times`` times in a document of ``n`` terms scores by weight 1."""
        distinct, place = np.unique(n, return_inverse=True)
        m = np.array([10 + 90 * int(x) * self.docs // self.all_terms for x in distinct], np.int64)[place.reshape(-1)]
        return 10**9 * times // (1000 * times + 8 * m)

    def bounds(self, there: np.ndarray, most: np.ndarray, fewest: np.ndarray) -> np.ndarray:
        """The highest score that a document of the block can have, for each item."""
        all_parts = np.zeros(len(self.terms), np.int64)
        all_parts[there] = self.part(most, fewest) * self.weight[there]
        flat = np.concatenate(self.of)
        return np.add.reduceat(all_parts[flat], np.cumsum([0, *map(len, self.of[:-1])]))


class Best:
    """The k best (score, id) of each item so far, and the score that a document needs to get in."""

    def __init__(self, items: int, k: int, threshold: np.ndarray | None):
        self.k, self.found = k, [[] for _ in range(items)]
        self.threshold = np.ones(items, np.int64) if threshold is None else threshold.copy()

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        new = [(-int(scores[i]), ids[i] is None, ids[i] or 0) for i in np.flatnonzero(scores >= self.threshold[item])]
        if new:
            self.found[item] = sorted(self.found[item] + new)[: self.k]
            if len(self.found[item]) == self.k:
                self.threshold[item] = max(self.threshold[item], -self.found[item][-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(i, None if none else d, -s) for i, f in enumerate(self.found) for s, none, d in f]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])


def _matched(items: Items, row: dict) -> tuple[np.ndarray, np.ndarray]:
    return items.match(row["terms"], unpacked(row["sizes"], row["n_distinct"]))


def _bounds(items: Items, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    here, there = _matched(items, row)
    return here, there, items.bounds(there, unpacked(row["most"], row["n_distinct"])[here], unpacked(row["fewest"], row["n_distinct"])[here])


def _contributions(items: Items, row: dict, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x matched terms, the column of each of the batch's terms or -1)."""
    column = np.full(max(row["n_distinct"], 1), -1, np.int64)
    column[here] = np.arange(len(here))
    doc, term = np.divmod(np.cumsum(unpacked(row["held"], row["n_held"])), max(row["n_distinct"], 1))
    asked = column[term] >= 0
    doc, times = doc[asked], unpacked(row["times"], row["n_held"])[asked]
    out = np.zeros((row["docs"], len(here)), np.int32)
    out[doc, column[term[asked]]] = items.part(times, unpacked(row["n_terms"], row["docs"])[doc])
    place = np.full(len(items.terms), -1, np.int64)
    place[there] = np.arange(len(there))
    return out, place


def _score_segment(items: Items, best: Best, rows: list[dict]) -> int:
    """Blocks from each item's highest bound down, until the bound drops below the item's threshold; how many (item, block) pairs were scored."""
    found = [_bounds(items, r) for r in rows]
    bound = np.stack([f[2] for f in found])
    scores: dict[int, tuple] = {}
    order = np.argsort(-bound, axis=0, kind="stable")
    pairs = 0
    for item in np.flatnonzero(bound.max(0) >= best.threshold).tolist():
        for b in order[:, item].tolist():
            if bound[b, item] < best.threshold[item]:
                break
            if b not in scores:
                scores[b] = _contributions(items, rows[b], *found[b][:2])
            parts, place = scores[b]
            column = place[items.of[item]]
            held = column >= 0
            best.add(item, parts[:, column[held]].astype(np.int64) @ items.weight[items.of[item][held]], rows[b]["doc_id"])
            pairs += 1
    return pairs


def _scored(blocks: DataFrame, shared, k: int, thresholds: np.ndarray | None) -> DataFrame:
    """(item, doc_id, score): the best of each task."""

    def run(batches):
        items = shared.value
        best, rows = Best(len(items.ids), k, thresholds), []
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                if len(rows) == SEGMENT:
                    _score_segment(items, best, rows)
                    rows = []
        if rows:
            _score_segment(items, best, rows)
        yield best.rows()

    return blocks.drop("holders").mapInArrow(lean(run), "item int, doc_id long, score long")


def top(rows: DataFrame, k: int) -> DataFrame:
    """Each item's k best with ``rank``: highest score first, then smallest id, null last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    t = narrow(items, "item_id", "text").toDF("item_id", "text")
    return t.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWERED), F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def search(blocks: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = blocks.sparkSession
    folder = shared_dir(spark)
    asked = written(item_terms(items), f"{folder}/items")
    batches = max(1, -(-asked.count() // BATCH_TERMS))
    totals = blocks.agg(F.sum("with_terms"), F.sum("all_terms")).first()
    with small_batches(spark):
        for i in range(batches):
            rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == i).collect()
            _search(blocks, Items([tuple(r) for r in rows]) if rows and totals[1] else None, totals, k, f"{folder}/found/batch={i}")
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(*[f"{folder}/found/batch={i}" for i in range(batches)])


def _search(blocks: DataFrame, items: Items | None, totals, k: int, path: str) -> None:
    spark = blocks.sparkSession
    if items is None:
        spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.parquet(path)
        return
    asked = spark.sparkContext.broadcast(items)

    def holders(batches):
        found = np.zeros(len(asked.value.terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                here, there = _matched(asked.value, row)
                found[there] += unpacked(row["holders"], row["n_distinct"])[here]
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(found[held])], ["term", "docs"])

    counted = blocks.select("terms", "sizes", "n_distinct", "holders").mapInArrow(lean(holders), "term int, docs long")
    held_by = {r[0]: r[1] for r in counted.groupBy("term").agg(F.sum("docs")).collect()}  # at most the batch's terms
    asked.unpersist()
    items.weigh(held_by, int(totals[0]), int(totals[1]))
    shared = spark.sparkContext.broadcast(items)

    def highest(batches):
        bound, block = np.zeros(len(shared.value.ids), np.int64), np.full(len(shared.value.ids), -1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                b = _bounds(shared.value, row)[2]
                block[b > bound], bound = row["block"], np.maximum(bound, b)
        some = np.flatnonzero(block >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bound[some]), pa.array(block[some])], ["item", "bound", "block"])

    likely = blocks.select("block", "terms", "sizes", "n_distinct", "most", "fewest").mapInArrow(lean(highest), "item int, bound long, block long")
    likely = likely.groupBy("item").agg(F.max_by("block", "bound").alias("block")).select("block").distinct()  # at most one an item
    first = top(_scored(blocks.join(F.broadcast(likely), "block", "left_semi"), shared, k, None), k)
    thresholds = np.ones(len(items.ids), np.int64)
    for r in first.where(F.col("rank") == k).select("item", "score").collect():
        thresholds[r[0]] = max(1, r[1])
    ids = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    best = top(_scored(blocks, shared, k, thresholds), k).join(F.broadcast(ids), "item")
    best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.parquet(path)
    shared.unpersist()
