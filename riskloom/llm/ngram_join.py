"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of ``K`` lower-cased words. Two sets of sizes m <= n with a Jaccard
similarity of at least 3/4 have n <= 4m/3 and differ in at most (m + n) / 7 elements.

*Signatures.* Sets fall into size bands [l, 4l/3], so a pair lies in one band or two next to each other, and each set takes part
in its own band and in the one below. A band whose pairs differ in at most k elements has ``n1`` first-level parts of the feature domain, each
of ``n2`` second-level parts, of which any ``k2`` are left out in turn: a signature names the first-level part, the second-level
parts left out and all elements in the others. Every set emits all its signatures that hold an element.
A part of a set is *solid* if none of its signatures is empty. If more than k / (k2 + 1) parts of a set are solid, then a set that
differs from it in k elements or fewer differs in at most k2 elements of one solid part, so the two share a signature. Two
sets that both have too few solid parts meet by PartEnum's other end, with one element a part and nothing left out: as of any k + 1
elements of either set one is in the other, the first k + 1 in one global order are enumerated.

Shingles that are frequent in the whole corpus (by a hashed count of all shingles) stay out of the two-level domain (leaving elements out only
lowers a difference) and stand last in the global order, so common passages do not gather unrelated documents. No choice here
can lose a pair.

*Candidates.* Equal sets are one class from the start, known by a 128-bit digest, of which eight bytes that are seen to tell all classes apart travel. Signatures are dealt out by hash as packed blobs.
Where few classes share one, all pairs are candidates; where more do, each with the centre, the member with the fewest infrequent shingles
(of near copies, the one nearest to their original). Candidates whose sizes, or the parities of whose hash cells (a lower bound
on the difference; 4 to 8 cells an element), rule them out are dropped; the others are verified exactly on the whole sets, best
partner first, then those that are not yet connected.

*Around a centre.* If some partner of a centre is not connected to it, the centre's partners are compared with each other, in pairs of blocks of
bounded size. In the first round a task emits no more pairs than connect the components that it sees, one for any two of them; in later rounds up to
4, 16, .. pairs for any two components still apart. They are verified, and rounds go on until nothing was held back, so no link is lost and
near copies are not expanded into all pairs.

Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined results: a null or empty text has no words, an empty set and no links (component_id is its own id); fewer words
than K are one shingle; rows that repeat an id are documents of their own; a null doc_id has a component_id of its
class's or component's least known id, or null; an empty table gives no rows. Ties in the choice of a centre or partner go to the smaller digest. A very long text is
one slice of its own. Extra columns are not read. Shingle names have 64 bits: links are exact unless two different shingles of one pair of sets share a name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, U64, bitmap_bits, bucket_of, by_bucket, column_bytes, id_bitmap, in_bitmap, lane, lean, mix, narrow, partitions_for, plan_bytes, release, remove, run_lengths, shared_dir, slices, small_batches, word_spans, written

K = 5
ALL_PAIRS = 12  # classes that share a signature, up to which all their pairs are candidates
FLUSH = 1_500_000
BLOCK = 1024  # members of a centre compared in one task with as many others; up to 8 times as many around larger centres


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = K):
    """The sorted distinct shingle names of each document of a slice."""
    low = LOWER[data]
    starts, ends, at = word_spans(low, offs)
    words = lane(41).words(low, starts, ends)
    n = np.diff(at)
    end = np.repeat(at[1:], n)
    i = np.arange(len(words))
    whole = i[i + k <= end]
    names = lane(42).runs(words, whole, k)
    first = np.searchsorted(whole, at)
    for d in range(len(n)):
        if n[d] >= k:
            yield np.unique(names[first[d] : first[d + 1]])
        elif n[d]:
            yield lane(42).runs(words[at[d] : at[d + 1]], np.zeros(1, np.int64), int(n[d]))
        else:
            yield np.zeros(0, U64)


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    a, b = mix(s + U64(0x1234567)), mix(s ^ U64(0x5DEECE66D1CE4E5B))
    return np.array([a.sum(dtype=U64) + U64(len(s)), b.sum(dtype=U64)], "<u8").tobytes()


def sketch(s: np.ndarray) -> bytes:
    """Whether the number of elements is odd in each of 4 to 8 hash cells an element (a power of two).

    Two sets differ in at least as many elements as cells of unlike parity. A sketch folds onto one of half the cells by exclusive or.
    """
    cells = 1 << max(6, int(4 * len(s) - 1).bit_length())
    odd = np.bincount((s >> U64(20) & U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words, folded to fewer words."""
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def coarse(cells: bytes) -> bytes:
    """A sketch folded to a quarter of its cells, 64 at least."""
    x = np.frombuffer(cells, "<u8")[None]
    return folded(x, max(1, x.shape[1] // 4)).tobytes()


class Sketches:
    """A column of sketches of mixed sizes."""

    def __init__(self, col: list[bytes]):
        self.words = np.array([len(x) // 8 for x in col], np.int64)
        self.row = np.zeros(len(col), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == w)
            self.of[w] = np.frombuffer(b"".join([col[i] for i in mine.tolist()]), "<u8").reshape(-1, w)
            self.row[mine] = np.arange(len(mine))

    def take(self, at: np.ndarray, words: int) -> np.ndarray:
        """The sketches at ``at``, all folded to ``words``."""
        out = np.zeros((len(at), words), U64)
        for w in np.unique(self.words[at]).tolist():
            mine = self.words[at] == w
            out[mine] = folded(self.of[w][self.row[at[mine]]], words)
        return out


def allowed(m, n):
    """In how many elements similar sets of such sizes can differ; -1 where sizes alone rule them out."""
    return np.where(4 * np.minimum(m, n) >= 3 * np.maximum(m, n), (m + n) // 7, -1)


class Band:
    """The parameters of a size band [lo, high]: k, n1, n2, k2."""

    def __init__(self, number: int, lo: int):
        self.lo, self.high = lo, max(lo, 4 * lo // 3)
        self.k = (self.high + 4 * self.high // 3) // 7
        if self.k <= 3:
            self.n1, self.n2, self.k2 = 1, self.k + 3, self.k
        else:
            self.n1, self.n2, self.k2 = int(1.3 * (self.k // 2 + 1)) + 2, 3, 1
        self.out = list(combinations(range(self.n2), self.k2))
        self.salt = U64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


class Bands:
    def __init__(self):
        self.all = [Band(0, 1)]
        while self.all[-1].high < 1 << 40:
            self.all.append(Band(len(self.all), self.all[-1].high + 1))
        self.start = np.array([b.lo for b in self.all])

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.start, n, "right")) - 1


BANDS = Bands()


def two_level(s: np.ndarray, band: Band) -> tuple[np.ndarray, int]:
    """(signatures that hold an element, number of solid parts) of a set."""
    if not len(s):
        return s, 0
    where = mix(s ^ band.salt)
    cell = ((where >> U64(32)) * U64(band.n1) >> U64(32)).astype(np.int64) * band.n2 + ((where & U64(0xFFFFFFFF)) * U64(band.n2) >> U64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    ordered = cell[order]
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums, counts = np.zeros(band.n1 * band.n2, U64), np.zeros(band.n1 * band.n2, np.int64)
    sums[ordered[at]] = np.add.reduceat(mix(s[order] + band.salt), at)
    counts[ordered[at]] = np.diff(np.r_[at, len(s)])
    sums, counts = sums.reshape(band.n1, band.n2), counts.reshape(band.n1, band.n2)
    all_sum, all_count = sums.sum(1, dtype=U64), counts.sum(1)
    out, solid = [], np.ones(band.n1, bool)
    for c, left_out in enumerate(band.out):
        kept = all_count - counts[:, left_out].sum(1)
        has = kept > 0
        solid &= has
        part = np.flatnonzero(has)
        name = (part * len(band.out) + c + 1).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
        out.append(mix((all_sum - sums[:, left_out].sum(1, dtype=U64))[part] + name))
    return np.concatenate(out), int(solid.sum())


def signatures(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """All signatures of a sorted set in its bands; hot[i]: element i is frequent."""
    n = len(s)
    if not n:
        return s
    b = BANDS.of(n)
    out = [np.zeros(0, U64)]
    for band, partner in ((BANDS.all[b], 4 * n // 3), (BANDS.all[b - 1], min(n - 1, BANDS.all[b - 1].high)) if b else (None, 0)):
        if band is None:
            continue
        k = (n + partner) // 7
        if not k:
            continue  # only equal sets are similar
        sig, solid = two_level(s[~hot], band)
        out.append(sig)
        if solid < k // (band.k2 + 1) + 1:
            single = mix((s ^ band.salt) + U64(0x632BE59BD9B4E019))
            out.append(single[np.lexsort((single, hot))[: k + 1]])
    return np.concatenate(out)


# ---------------------------------------------------------------- sets, classes and frequent shingles


def profile(texts: DataFrame, bits: int) -> DataFrame:
    """(doc_id, key, n, node, cells, coarse) of every document, and rows (slice, counts) of the hashed shingle counts of each task."""
    size = 1 << bits
    parts = 16

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, offs = column_bytes(batch.column(2))
            for a, b in slices(offs):
                sets = list(shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                total += np.bincount((np.concatenate(sets) >> U64(64 - bits)).astype(np.int64), minlength=size)
                m = b - a
                cells = [sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), batch.column(1).slice(a, m), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array(cells, pa.binary()), pa.array([coarse(c) for c in cells], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        step = size // parts
        yield pa.RecordBatch.from_arrays([pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.binary()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.binary()), pa.nulls(parts, pa.binary()), pa.nulls(parts, pa.binary()), pa.array(range(parts), pa.int32()), pa.array([total[p * step : (p + 1) * step].astype("<u4").tobytes() for p in range(parts)])], names)

    names = ["doc_id", "key", "n", "node", "cells", "coarse", "slice", "counts"]
    return texts.mapInArrow(lean(run), "doc_id long, key binary, n long, node binary, cells binary, coarse binary, slice int, counts binary")


def frequent(profiles: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2**bits count cells well above the mean; its size is fixed by ``bits``."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
                total[p] = total[p] + x if p in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    rows = profiles.where("slice is not null").select("slice", "counts").repartitionById(16, "slice").mapInArrow(lean(add), "slice int, counts binary").collect()
    counts = np.zeros(1 << bits, np.int64)
    for r in rows:
        x = np.frombuffer(r.counts, "<i8")
        counts[r.slice * len(x) : (r.slice + 1) * len(x)] = x
    mean = counts.mean()
    return np.packbits(counts > mean + max(24, mean / 2), bitorder="little")


# ---------------------------------------------------------------- candidates


def candidates(texts: DataFrame, hot_cells: np.ndarray, bits: int, n: int, all_pairs: int = ALL_PAIRS, names_at: int = 0) -> DataFrame:
    """Rows (a, b, shared, star) of short class names: pairs of classes with the signatures shared in one partition; star: a is a centre."""

    def deal(batches):
        sigs, nodes, ranks, seen, size = [], [], [], set(), 0

        def flush():
            h = np.concatenate(sigs)
            node = np.repeat(np.arange(len(nodes)), [len(x) for x in sigs])
            order, at = by_bucket(bucket_of(h, n), n)
            names, rank = np.array(nodes, "<i8"), np.array(ranks, "<u2")
            rows = [[], [], [], [], []]
            for b in np.flatnonzero(np.diff(at)).tolist():
                mine = order[at[b] : at[b + 1]]
                ids, runs = run_lengths(node[mine])
                for c, v in zip(rows, (b, names[ids].tobytes(), rank[ids].tobytes(), np.minimum(runs, 65535).astype("<u2").tobytes(), h[mine].astype("<u4").tobytes())):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), *[pa.binary()] * 4))], ["part", "nodes", "ranks", "runs", "low"])

        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            for a, b in slices(offs):
                for s in shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]):
                    if not len(s):
                        continue
                    node = short(digest(s), names_at)
                    if node in seen:
                        continue
                    seen.add(node)
                    cell = (s >> U64(64 - bits)).astype(np.int64)
                    hot = (hot_cells[cell >> 3] >> (cell & 7) & 1).astype(bool)
                    sig = np.unique(signatures(s, hot))
                    for x in range(0, len(sig), 60000):  # a run is counted in 16 bits
                        sigs.append(sig[x : x + 60000])
                        nodes.append(node)
                        ranks.append(min(int(len(s) - hot.sum()), 65535))
                    size += len(sig)
                    if size > FLUSH:
                        yield flush()
                        sigs, nodes, ranks, seen, size = [], [], [], set(), 0
        if size:
            yield flush()

    def find(batches):
        low, node, rank = [], [], []
        for batch in batches:
            for ids, rk, runs, lo in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 4)]):
                low.append(np.frombuffer(lo, "<u4"))
                runs = np.frombuffer(runs, "<u2")
                node.append(np.repeat(np.frombuffer(ids, "<i8"), runs))
                rank.append(np.repeat(np.frombuffer(rk, "<u2"), runs))
        if not low:
            return
        h, node, rank = np.concatenate(low), np.concatenate(node), np.concatenate(rank)
        order = np.lexsort((node, rank, h))  # a group's centre comes first
        h, node = h[order], node[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]  # a class comes from several tasks
        h, node = h[new], node[new]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[at, len(h)])
        names, node = np.unique(node, return_inverse=True)
        left, right, star = [], [], []
        for g in range(2, all_pairs + 1):  # all groups of one size at once
            rows = node[at[count == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            left.append(np.minimum(x, y))
            right.append(np.maximum(x, y))
            star.append(np.zeros(len(x), bool))
        big = count > all_pairs
        size = count[big] - 1
        if len(size):
            first = np.repeat(at[big], size)
            left.append(node[first])
            right.append(node[first + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
            star.append(np.ones(size.sum(), bool))
        a, b, is_star = np.concatenate(left).astype(np.int64), np.concatenate(right), np.concatenate(star)
        code, shared = np.unique((a * len(names) + b) * 2 + is_star, return_counts=True)
        is_star, code = (code & 1).astype(bool), code >> 1
        for x in range(0, len(code), 65536):
            y = slice(x, x + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(names[code[y] // len(names)]), pa.array(names[code[y] % len(names)]), pa.array(shared[y], pa.int64()), pa.array(is_star[y])], ["a", "b", "shared", "star"])

    dealt = texts.select("text").mapInArrow(lean(deal), "part int, nodes binary, ranks binary, runs binary, low binary").repartitionById(n, "part")
    return dealt.mapInArrow(lean(find), "a long, b long, shared long, star boolean")


def short(node: bytes, at: int = 0) -> int:
    """Eight bytes of a class's digest, as ``short_of`` gives them in Spark."""
    return int.from_bytes(node[at : at + 8], "big", signed=True)


def short_of(at: int = 0, node: str = "node"):
    return F.conv(F.hex(F.substring(node, at + 1, 8)), 16, -10).cast("long")


def short_names(classes: DataFrame) -> int:
    """From which byte of the digests eight bytes tell all classes apart."""
    for at in range(9):
        if not classes.groupBy(short_of(at)).count().where("count > 1").limit(1).count():
            return at
    raise RuntimeError("no eight bytes of the digests tell the classes apart")


# ---------------------------------------------------------------- verification


def wanted_texts(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, body) for the classes in ``reps`` (node, rep), from the rows that stand for a class; a few others and repeats may come along.

    Texts travel, not their sets: eight bytes a shingle are twice a word, and do not compress.
    """
    bits = bitmap_bits(texts)
    nodes = id_bitmap(reps, "node", bits, lambda batch: node_key(batch.column(0).to_pylist()))
    ids = id_bitmap(reps, "rep", bits)

    def run(batches):
        for batch in batches:
            keep = pa.array(np.flatnonzero(in_bitmap(batch.column(0).fill_null(-(1 << 63)).to_numpy(), ids, bits)))
            text = batch.column(1).take(keep)
            data, offs = column_bytes(text)
            for a, b in slices(offs):
                names = [digest(s) for s in shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])]
                at = np.flatnonzero(in_bitmap(node_key(names), nodes, bits)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.binary()), text.slice(a, b - a).take(pa.array(at, pa.int64())).cast(pa.string())], ["node", "body"])

    return texts.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text").mapInArrow(lean(run), "node binary, body string")


def node_key(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(nodes), "<i8")[::2] if nodes else np.zeros(0, np.int64)


def classes_of(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, cells) of the classes in ``nodes`` (node), before they move; a few others may come along."""
    bits = bitmap_bits(classes)
    marked = id_bitmap(nodes, "node", bits, lambda batch: node_key(batch.column(0).to_pylist()))

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(in_bitmap(node_key(batch.column(0).to_pylist()), marked, bits))))

    return classes.select("node", "n", "cells").mapInArrow(lean(run), "node binary, n long, cells binary")


def plausible(pairs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """(a, b, shared, star, ok) by digests: ok is false where sizes or parities rule a pair out; such pairs stay only if they come from a centre.

    The sketches folded to a quarter, which travel for all pairs, rule out nearly all of those; whole ones travel for the rest.
    """
    c = classes.select("short", "n", F.col("coarse").alias("cells"))
    coarse = _possible(pairs.select("a", "b", "shared", "star"), c, "a long, b long, shared long, star boolean, ok boolean").drop("ok")
    c = classes.select("short", "node")
    named = coarse.join(c.withColumnsRenamed({"short": "a", "node": "x"}), "a").join(c.withColumnsRenamed({"short": "b", "node": "y"}), "b")
    named = written(named.select(F.col("x").alias("a"), F.col("y").alias("b"), "shared", "star"), f"{folder}/named")
    whole = classes_of(classes, named.select(F.explode(F.array("a", "b")).alias("node"))).withColumnRenamed("node", "short")
    return _possible(named, whole, "a binary, b binary, shared long, star boolean, ok boolean")


def _possible(pairs: DataFrame, c: DataFrame, schema: str) -> DataFrame:
    both = pairs.join(c.withColumnsRenamed({"short": "a", "n": "m", "cells": "x"}), "a").join(c.withColumnsRenamed({"short": "b", "cells": "y"}), "b")
    both = both.where("star or 4 * least(m, n) >= 3 * greatest(m, n)")

    def run(batches):
        for batch in batches:
            x, y = Sketches(batch.column(6).to_pylist()), Sketches(batch.column(7).to_pylist())
            m, n = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            words = np.minimum(x.words, y.words)
            apart = np.zeros(len(m), np.int64)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w)
                apart[at] = np.bitwise_count(x.take(at, w) ^ y.take(at, w)).sum(1, dtype=np.int64)
            ok = apart <= allowed(m, n)
            keep = pa.array(np.flatnonzero(ok | batch.column(3).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(keep) for i in range(4)], pa.array(ok).take(keep)], ["a", "b", "shared", "star", "ok"])

    return both.select("a", "b", "shared", "star", "m", "n", "x", "y").mapInArrow(lean(run), schema)


def verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, similar): exactly, on the whole sets of the texts ``bodies`` (node, body)."""
    both = pairs.join(bodies.withColumnsRenamed({"node": "a", "body": "x"}), "a").join(bodies.withColumnsRenamed({"node": "b", "body": "y"}), "b")

    def run(batches):
        for batch in batches:
            held: dict[bytes, np.ndarray] = {}  # each text of the batch is cut into its set once
            for name, body in ((0, 2), (1, 3)):
                nodes = batch.column(name).to_pylist()
                new = list({x: i for i, x in enumerate(nodes) if x not in held}.values())
                data, offs = column_bytes(batch.column(body).take(pa.array(new, pa.int64())))
                for a, b in slices(offs):
                    for i, s in zip(new[a:b], shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])):
                        held[nodes[i]] = s
            similar = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = held[x], held[y]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                similar.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.bool_())], ["a", "b", "similar"])

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a binary, b binary, similar boolean").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the least node of each node's component, for nodes that have edges (a, b)."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{folder}/edges-0")
    step = 0
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is joined to the least of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, f"{folder}/edges-{step}-large")
        # small star: the smaller neighbours, and the node itself, to the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        e = written(small, f"{folder}/edges-{step}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def around(members: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(a, b, held): pairs of members (centre, node, label) of one centre but of two components that sizes and parities do not rule out.

    Members are compared in pairs of blocks, each a group of its own. Of the pairs between two components a task emits at most ``most``, the
    most promising first; where that is 1, only as far as components are not connected by others before. held is true where it keeps some back.
    """
    m = members.join(classes.select("node", "n", "cells"), "node")
    count = members.groupBy("centre").agg(F.count(F.lit(1)).alias("_size"))
    m = m.join(count, "centre").withColumn("blocks", F.ceil(F.col("_size") / F.greatest(F.lit(BLOCK), F.least(F.lit(8 * BLOCK), F.floor(F.col("_size") / 8)))).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("centre", "i", "j", "block", "node", "label", "n", "cells")

    def run(key, table):
        node = np.array(table["node"].to_pylist(), object)
        label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
        n, block = table["n"].to_numpy(), table["block"].to_numpy()
        cells = Sketches(table["cells"].to_pylist())
        one = key[1].as_py() == key[2].as_py()
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        found = []
        for w in np.unique(cells.words).tolist():
            for v in np.unique(cells.words).tolist():
                x, y = left[cells.words[left] == w], right[cells.words[right] == v]
                if not len(x) or not len(y):
                    continue
                u = min(w, v)
                xs, ys = cells.take(x, u), cells.take(y, u)
                step = max(1, (1 << 18) // (len(y) * u))
                for a in range(0, len(x), step):
                    z = x[a : a + step]
                    room = allowed(n[z][:, None], n[y][None])
                    open_ = (label[z][:, None] != label[y][None]) & (room >= 0)
                    if one:
                        open_ &= z[:, None] < y[None]
                    if not open_.any():
                        continue
                    slack = room - np.bitwise_count(xs[a : a + step, None] ^ ys[None]).sum(2, dtype=np.int64)
                    i, j = np.nonzero(open_ & (slack >= 0))
                    found.append((z[i], y[j], slack[i, j]))
        none = {"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "held": pa.array([], pa.bool_())}
        if not found:
            return pa.table(none)
        p, q, slack = (np.concatenate(f) for f in zip(*found))
        order = np.argsort(-slack, kind="stable")
        p, q = p[order], q[order]
        la, lb = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
        two = np.unique(la.astype(np.int64) * (label.max() + 1) + lb, return_inverse=True)[1]
        by = np.argsort(two, kind="stable")  # the pairs of two components together, most promising first
        first = np.r_[True, two[by][1:] != two[by][:-1]]
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        root = np.arange(label.max() + 1)

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        use = nth < most
        if most == 1:
            for i in np.flatnonzero(use).tolist():
                x, y = top(la[i]), top(lb[i])
                use[i] = x != y
                root[x] = y
        held = bool((~use).any())
        a = [min(node[x], node[y]) for x, y in zip(p[use], q[use])]
        b = [max(node[x], node[y]) for x, y in zip(p[use], q[use])]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "held": pa.array([held] * len(a), pa.bool_())})

    return m.groupBy("centre", "i", "j").applyInArrow(run, "a binary, b binary, held boolean")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components (_a, _b) of their ends; an end without links is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.withColumnsRenamed({"node": c, "label": f"_{c}"}), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    return pairs


def join(docs: DataFrame, all_pairs: int = ALL_PAIRS, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, node (the class of equal sets), label (the component: its least node; null without words) for every
    document; ``key``: the name of a binary column of ``docs`` that comes along as ``key``."""
    with small_batches(docs.sparkSession):
        return _join(docs, all_pairs, key, shared_dir(docs.sparkSession))


def _join(docs: DataFrame, all_pairs: int, key: str | None, folder: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (docs[key] if key else F.lit(None).cast("binary")).alias("key"), docs["text"].alias("text"))
    n = partitions_for(narrow(docs, "doc_id", "text"), 8 << 20)
    bits = min(20, max(14, int(plan_bytes(texts) or 1 << 29).bit_length() - 11))
    profiles = written(profile(texts, bits), f"{folder}/profiles")
    each = profiles.where("slice is null").select("doc_id", "key", "n", "node", "cells", "coarse")
    classes = written(each.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("coarse").alias("coarse")), f"{folder}/classes")
    at = short_names(classes)
    classes = classes.withColumn("short", short_of(at))
    each = each.drop("cells", "coarse")
    found = written(candidates(texts, frequent(profiles, bits), bits, n, all_pairs, at), f"{folder}/candidates")
    release(spark)
    pairs = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("star").alias("star"))
    pairs = written(plausible(pairs, classes, folder), f"{folder}/pairs")
    remove(spark, f"{folder}/candidates")
    release(spark)
    spokes = pairs.where("star").select("a", "b")
    ruled_out = pairs.where("not ok").select("a", "b", F.lit(False).alias("similar"))
    pairs = pairs.where("ok").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").alias("shared"))

    def sets_for(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        reps = written(nodes.join(classes, "node").select("node", F.coalesce("rep", F.lit(-(1 << 63))).alias("rep")), f"{folder}/reps-{name}")
        return written(wanted_texts(texts.drop("key"), reps), f"{folder}/sets-{name}")

    sets = sets_for(pairs, "0")
    release(spark)
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("x")).select("x.a", "b")
    tested = written(verify(best, sets), f"{folder}/verified-0")
    release(spark)
    labels = written(components(tested.where("similar"), f"{folder}/c-0"), f"{folder}/labels-0")
    release(spark)
    more = _labelled(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"), labels).where("_a <> _b").select("a", "b")
    more = written(more, f"{folder}/more")
    again = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
    second = written(verify(more, sets.join(again, "node", "left_semi")), f"{folder}/verified-1")
    remove(spark, f"{folder}/sets-0")
    release(spark)

    def grown(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        if not links.limit(1).count():
            return labels
        edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links.select("a", "b"))
        out = written(components(edges, f"{folder}/c-{name}"), f"{folder}/labels-{name}")
        remove(spark, f"{folder}/c-{name}")
        return out

    labels = grown(labels, second.where("similar"), "1")
    swap = ruled_out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similar")
    tested = tested.unionByName(second).unionByName(swap)
    most, step, near = 1, 2, None
    while True:
        s = _labelled(spokes, labels)
        open_ = s.where("_a <> _b").select("a").distinct()
        s = s.join(open_, "a", "left_semi")
        members = s.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.col("_b").alias("label")).unionByName(s.select(F.col("a").alias("centre"), F.col("a").alias("node"), F.col("_a").alias("label")).distinct())
        members = written(members, f"{folder}/members-{step}")
        if not members.limit(1).count():
            break
        if near is None:  # later rounds have no members that the first has not
            near = written(classes_of(classes, members.select("node")), f"{folder}/near")
        got = written(around(members, near, most), f"{folder}/pairs-{step}")
        todo = written(got.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), f"{folder}/todo-{step}")
        if todo.limit(1).count():
            third = written(verify(todo, sets_for(todo, str(step))), f"{folder}/verified-{step}")
            remove(spark, f"{folder}/sets-{step}")
            tested = tested.unionByName(third)
            labels = grown(labels, third.where("similar"), str(step))
            release(spark)
        if not got.where("held").limit(1).count():
            break
        most, step = most * 4, step + 1

    of_class = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = of_class.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = written(of_class.join(ids, "label").select("node", "component_id", "label"), f"{folder}/of_class")
    release(spark)
    out = each.where("n > 0").join(of_class, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node", "label", "key")
    empty = each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node", F.lit(None).cast("binary").alias("label"), "key")
    out = out.unionByName(empty)
    return out if key else out.drop("key")


def kept_documents(docs: DataFrame, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """One document of each group of linked ones, with all its columns: the one of smallest doc_id, null ids last.

    Rows are told apart by doc_id and text; of rows that agree in both, which are linked, one stays. Documents without words all stay.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))).alias("key"))
    spark = docs.sparkSession
    work = shared_dir(spark)
    with small_batches(spark):
        rows = written(_join(keyed, all_pairs, "key", work).where("label is not null").select("doc_id", "key", "label"), f"{shared_dir(spark)}/rows")
    remove(spark, work)
    release(spark)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("key").alias("z"))
    first = rows.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    gone = rows.join(first, "label").where(order != F.col("first")).select(F.col("doc_id").alias("_g_id"), F.col("key").alias("_g_key")).distinct()
    text_key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    stays = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_g_id"]) & (text_key == gone["_g_key"]), "left_anti")
    if rows.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        marked = stays.select(F.struct(*[stays[c] for c in docs.columns]).alias("_row"), stays["doc_id"].cast("long").alias("_id"), text_key.alias("_key"))
        lone = F.col("_row")["text"].rlike(r"[^\x20\x09-\x0D]")
        first_row = marked.where(lone).groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        stays = marked.where(~lone | lone.isNull()).select("_row.*").unionByName(first_row.select("_row.*"))
    return stays
