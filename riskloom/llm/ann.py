"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

For maximum inner product a codeword's error along the vector matters more than across it. Vectors
are scaled to length 1, so the inner product is the cosine. A product codebook (``SUB`` dimensions
and 16 codewords a subspace: 4 bits) is fitted on a bounded sample by coordinate descent on
eta * |parallel residual|^2 + |orthogonal residual|^2, with eta = (d - 1) T^2 / (1 - T^2); the codewords of a
subspace solve small linear systems, assignment goes over the subspaces in turn with the other
subspaces' residual held. Every vector is then encoded the same way.

Search: codes stay where they are, packed in blocks beside their vectors; queries come to them in batches of at most ``BATCH_BYTES``, two
jobs a batch. A task adds up table entries, two subspaces (one byte) at a time, to estimates. (1) The best ``keep`` of a block that reach the query's floor (an estimate so low that, going by the
coded sample, at least four times ``keep`` vectors of all reach it) are scored exactly; the best k + 1 of all give the query's threshold t.
(2) Every estimate is held against what a vector of score t or more must have. With s the score, p the parallel and o the length of the orthogonal
residual of a unit vector x, the estimate is at least s (1 - p) - sqrt(1 - s^2) o, which grows with s from 0 on: the small parallel residuals, for which the
codebook is fitted, are what makes this tight. Whatever is not below it is scored exactly, in place, and t rises with what a task finds. No neighbour is lost, whatever the density:
estimates only decide how much is scored. A task hands on its k + 1 best of each query. Scores are the same sums, in the same order, as in the result.
``keep=None`` leaves out the estimates: every vector is scored.

Equal vectors are indexed once, with their ``k + 1`` smallest ids: any of them that could be among a query's k
nearest is there, and thousands of copies neither fill the lists nor one task.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part, as queries or candidates;
vectors of different lengths are never compared: each length is searched for itself. Rows that repeat an id are rows of their own: each is a candidate (one
of the query's own id and vector is left out), and a repeated query row repeats its answer. A null id is a candidate, last in ties, but no query.
With fewer candidates than k, all are returned; an empty table gives no rows. Lengths of vectors are scaled by powers of two before anything is
squared, so no finite component overflows. Extra columns are not read, whatever their names.

The sample (``SAMPLE`` distinct vectors, those of smallest hash) fits the codebook and the floors; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import lean, partitions_for, remove, shared_dir, written

SAMPLE = 16384
SUB = 2
T = 0.2
CODE_BLOCK = 8192
BATCH_BYTES = 8 << 20


def valid(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, n): components as doubles, scaled by a power of two to a largest one of 1 to 2; n rows agree in both."""
    t = table.select(table[id_col].cast("long").alias("id"), table[vec_col].cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    t = t.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # in two steps, as one power of two may lie beyond the range of a double
    half = F.floor(F.log2(F.col("_top")) / 2)
    t = t.withColumn("_top", top).select("id", F.transform("v", lambda x: x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), F.floor(F.log2(F.col("_top"))) - half)).alias("v"))
    return t.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))


def _blocks(u: np.ndarray) -> np.ndarray:
    """(n, subspaces, SUB), the last subspace filled up with zeros."""
    pad = -u.shape[1] % SUB
    return np.pad(u, ((0, 0), (0, pad))).reshape(len(u), -1, SUB)


def _assign(x: np.ndarray, book: np.ndarray, eta: float, codes: np.ndarray | None, sweeps: int = 3) -> np.ndarray:
    """Codes by coordinate descent; x: (n, m, SUB), book: (m, 16, SUB)."""
    n, m, _ = x.shape
    if codes is None:
        codes = np.stack([((x[:, j, None] - book[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    part = np.einsum("nms,nms->nm", x, x - book[np.arange(m), codes])  # each subspace's share of x . residual
    total = part.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            r = x[:, j, None] - book[j]
            along = (x[:, j, None] * r).sum(2)
            rest = (total - part[:, j])[:, None] + along
            best = ((r**2).sum(2) + (eta - 1) * rest**2).argmin(1)
            total += along[np.arange(n), best] - part[:, j]
            part[:, j], codes[:, j] = along[np.arange(n), best], best
    return codes


def fit(sample: np.ndarray, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """(codebook, eta) from unit vectors."""
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * T**2 / (1 - T**2))
    x = _blocks(sample)
    n, m, _ = x.shape
    rng = np.random.default_rng(seed)
    book = np.stack([x[rng.choice(n, 16, n < 16), j] for j in range(m)])
    codes = None
    for _ in range(rounds):
        codes = _assign(x, book, eta, codes, 1)
        part = np.einsum("nms,nms->nm", x, x - book[np.arange(m), codes])
        total = part.sum(1)
        for j in range(m):
            a = np.eye(SUB) + (eta - 1) * x[:, j, :, None] * x[:, j, None, :]
            b = x[:, j] * (1 + (eta - 1) * (total - part[:, j] + (x[:, j] ** 2).sum(1)))[:, None]
            for c in range(16):
                mine = codes[:, j] == c
                if mine.any():
                    book[j, c] = np.linalg.solve(a[mine].sum(0), b[mine].sum(0))
            new = (x[:, j] * (x[:, j] - book[j, codes[:, j]])).sum(1)
            total += new - part[:, j]
            part[:, j] = new
    return book, eta


def encode(unit: np.ndarray, book: np.ndarray, eta: float) -> np.ndarray:
    """Two 4-bit codes in a byte."""
    codes = _assign(_blocks(unit), book, eta, None).astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] << 4 | codes[:, 1::2]


def tables(unit: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each query's sums for every byte of codes: (queries, bytes, 256)."""
    lut = np.einsum("qms,mcs->qmc", _blocks(unit), book).astype(np.float32)
    if lut.shape[1] % 2:
        lut = np.pad(lut, ((0, 0), (0, 1), (0, 0)))
    return (lut[:, ::2, :, None] + lut[:, 1::2, None, :]).reshape(len(lut), -1, 256)


def nearest(table: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, keep: int | None = 320, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, id_col, score: the k nearest of every row for which ``is_query`` (an expression on ``id``) holds."""
    folder = shared_dir(table.sparkSession)
    rows = written(valid(table, id_col, vec_col), f"{folder}/rows")
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    out = table.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    for i, d in enumerate(lengths):
        found = _nearest(rows.where(F.size("v") == d), f"{folder}/{d}", id_col, is_query, k, keep, sample)
        out = found if i == 0 else out.unionByName(found)
    return out


def _nearest(rows: DataFrame, folder: str, id_col: str, is_query: Column, k: int, keep: int | None, sample: int) -> DataFrame:
    spark = rows.sparkSession
    # distinct vectors, with the smallest ids of each (null last); a hot vector is cut down by its parts first
    ids = rows.select("v", F.explode(F.array_repeat(F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("y")), F.least("n", F.lit(k + 1)).cast("int"))).alias("id"))
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    ranked = ids.withColumn("_r", F.row_number().over(Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("_r") <= k + 1)
    index = written(ranked.groupBy("v").agg(least(F.collect_list("id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id()), f"{folder}/index")
    queries = written(rows.where(is_query & F.col("id").isNotNull()).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "n", F.monotonically_increasing_id().alias("ask")), f"{folder}/queries")
    hits = _found(spark, index, queries, folder, k + 1, keep, sample)  # one more than k: the query's own vector may be among them

    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a * a), F.lit(0.0), lambda a, b: a + b))
    q = queries.withColumn("qn", norm("qv"))
    scored = hits.join(index, "rep").join(q, "ask").select("ask", "query_id", "n", "ids", F.equal_null("qv", "v").alias("_same"), (dot / (F.col("qn") * norm("v"))).alias("score"))
    own = F.struct(F.lit(False).alias("x"), F.col("query_id").alias("y"))
    # of the query's own vector, one row of its id is itself
    at = F.array_position("ids", own)
    others = F.when(F.col("_same") & (at > 0), F.filter("ids", lambda x, i: i != at - 1)).otherwise(F.col("ids"))
    scored = scored.select("ask", "query_id", "n", F.explode(others).alias("_id"), "score")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id.y").alias(id_col), "score")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rows(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1)


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products, component after component, as the result's expression adds them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[..., j]
    return out


class Block:
    """Up to CODE_BLOCK vectors, of 4 MB or so at most: numbers, smallest ids, vectors, codes a byte column each, and residuals of the unit vectors."""

    def __init__(self, reps, leads, null, vectors, codes, along, across, d: int):
        read = lambda x, t: np.frombuffer(x.as_buffer(), t)
        self.reps, self.leads, self.null, self.along, self.across = read(reps, "<i8"), read(leads, "<i8"), read(null, "?"), read(along, "<f4"), read(across, "<f4")
        self.v = read(vectors, "<f8").reshape(-1, d)
        self.unit = _unit(self.v)
        self.norm = np.sqrt(_in_turn(self.v, self.v))
        self.by_byte = np.ascontiguousarray(read(codes, np.uint8).reshape(len(self.reps), -1).T)

    def estimates(self, t: np.ndarray) -> np.ndarray:
        s = np.zeros(len(self.reps), np.float32)
        for m, c in enumerate(self.by_byte):
            s += t[m][c]
        return s

    def scores(self, at: np.ndarray, qv: np.ndarray, qn: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of those of ``at`` that score ``least`` or more."""
        at = at[self.unit[at] @ (qv / np.linalg.norm(qv)) >= least - 1e-9]
        s = _in_turn(self.v[at], qv) / (qn * self.norm[at])
        return at[s >= least], s[s >= least]


class Nearest:
    """The ``k`` best of one query in a task: highest score, then smallest id, null last."""

    def __init__(self, k: int, least: float):
        self.k, self.least, self.found = k, least, []

    def add(self, block: Block, at: np.ndarray, s: np.ndarray) -> None:
        if len(at) > self.k:  # cut down before anything is done a row at a time
            best = np.lexsort((block.leads[at], block.null[at], -s))[: self.k]
            at, s = at[best], s[best]
        if len(at):
            self.found = sorted(self.found + list(zip((-s).tolist(), block.null[at].tolist(), block.leads[at].tolist(), block.reps[at].tolist())))[: self.k]
            if len(self.found) == self.k:
                self.least = max(self.least, -self.found[-1][0])


CODES = "reps binary, leads binary, nulls binary, vectors binary, codes binary, along binary, across binary"
SLACK = 1e-4  # above the rounding of estimates, which are single-precision sums of at most some hundred terms of size 1


def _found(spark, index: DataFrame, queries: DataFrame, folder: str, k: int, keep: int | None, sample: int) -> DataFrame:
    """(ask, rep): among them each query's ``k`` best."""
    picked = index.orderBy(F.xxhash64("v"), "rep").limit(sample).select("v").toPandas()
    if not len(picked):
        return spark.createDataFrame([], "ask long, rep long")
    unit = _unit(np.stack(picked["v"].to_numpy()))
    book, eta = fit(unit)
    d, seen = unit.shape[1], encode(unit, book, eta)

    def coded(batches):
        for batch in batches:
            each = max(64, min(CODE_BLOCK, (4 << 20) // (8 * d)))
            for a in range(0, len(batch), each):
                part = batch.slice(a, each)
                v = _rows(part.column(1))
                u = _unit(v)
                codes = encode(u, book, eta)
                nibbles = np.stack([codes >> 4, codes & 15], 2).reshape(len(v), -1)[:, : book.shape[0]]
                blocks = _blocks(u)
                residual = blocks - book[np.arange(book.shape[0]), nibbles]
                along = (blocks * residual).sum((1, 2))
                across = np.sqrt(np.maximum((residual**2).sum((1, 2)) - along**2, 0))
                leads = part.column(3).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                out = (part.column(0).to_numpy().astype("<i8"), leads[0].astype("<i8"), leads[1].astype("?"), v.astype("<f8"), codes, along.astype("<f4"), across.astype("<f4"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], [c.split()[0] for c in CODES.split(", ")])

    parts = partitions_for(index, 16 << 20)
    first = index.select("rep", "v", F.col("ids")[0]["x"].alias("null"), F.coalesce(F.col("ids")[0]["y"], F.lit(0)).alias("lead"))
    codes = written(first.repartition(parts, "rep").mapInArrow(lean(coded), CODES), f"{folder}/codes")
    total = index.count()
    # by the sample, four times ``keep`` of all vectors reach the floor
    nth = min(len(seen), max(keep if total <= len(seen) else 0, 32, -(-4 * keep * len(seen) // total))) if keep else 0
    by_byte = np.ascontiguousarray(seen.T)

    def probe(shared):
        """Each query's best by exact score among the best by estimate."""

        def run(batches):
            ask, qv, qn, _ = shared.value
            u = _unit(qv)
            blocks = (Block(*row, d) for b in batches for row in zip(*b.columns))
            best = [Nearest(k, -2.0) for _ in ask]
            floor: np.ndarray | None = None
            for block in blocks:
                floors = [] if floor is None else floor
                for a in range(0, len(ask), 32):
                    for j, t in enumerate(tables(u[a : a + 32], book), a):
                        if floor is None:
                            s = np.zeros(by_byte.shape[1], np.float32)
                            for m, c in enumerate(by_byte):
                                s += t[m][c]
                            floors.append(np.partition(s, len(s) - nth)[len(s) - nth])
                        s = block.estimates(t)
                        edge = np.partition(s, len(s) - keep)[len(s) - keep] if len(s) > keep else -np.inf
                        best[j].add(block, *block.scores(np.flatnonzero(s >= max(edge, floors[j])), qv[j], qn[j], best[j].least))
                floor = floors
            yield _best_rows(ask, best)

        return run

    def search(shared, measured):
        """Each query's best of all vectors whose estimate allows them its threshold."""

        def run(batches):
            ask, qv, qn, least = shared.value
            u = _unit(qv)
            best = [Nearest(k, x) for x in least.tolist()]
            scored = 0
            for block in (Block(*row, d) for b in batches for row in zip(*b.columns)):
                radius = np.sqrt(block.along**2 + block.across**2)
                everything = np.arange(len(block.reps))
                for a in range(0, len(ask), 32):
                    for j, t in enumerate(tables(u[a : a + 32], book) if keep else u[a : a + 32], a):
                        x = best[j].least
                        if not keep or x <= -1:
                            at = everything
                        elif x < 0:
                            at = np.flatnonzero(block.estimates(t) + radius >= x - SLACK)
                        else:
                            at = np.flatnonzero(block.estimates(t) + np.float32(x) * block.along + np.float32(np.sqrt(max(0.0, 1 - x * x))) * block.across >= x - SLACK)
                        scored += len(at)
                        best[j].add(block, *block.scores(at, qv[j], qn[j], x))
            measured.add(scored)
            yield _best_rows(ask, best)

        return run

    order = Window.partitionBy("ask").orderBy(F.desc("score"), "null", "lead")
    jobs = max(1, -(-queries.count() * 8 * d // BATCH_BYTES))
    paths = []
    for job in range(jobs):
        mine = queries.where(F.pmod(F.xxhash64("ask"), F.lit(jobs)) == job).select("ask", "qv").toPandas()
        if not len(mine):
            continue
        ask, qv, least = mine["ask"].to_numpy(), np.stack(mine["qv"].to_numpy()), np.full(len(mine), -2.0)
        qn = np.sqrt(_in_turn(qv, qv))
        if keep:
            shared = spark.sparkContext.broadcast((ask, qv, qn, least))
            found = codes.mapInArrow(lean(probe(shared)), BEST).withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
            known = {r[0]: r[1] for r in found.select("ask", "score").collect()}  # a number a query of the batch
            least = np.array([known.get(x, -2.0) for x in ask.tolist()])
            shared.unpersist()
        shared = spark.sparkContext.broadcast((ask, qv, qn, least))
        SCORED.clear()
        measured = spark.sparkContext.accumulator(0)
        hits = codes.mapInArrow(lean(search(shared, measured)), BEST).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        paths.append(f"{folder}/hits/{job}")
        hits.select("ask", "rep").write.parquet(paths[-1])
        SCORED.append((measured.value, len(mine) * total))
        shared.unpersist()
    remove(spark, f"{folder}/codes")
    return spark.read.schema("ask long, rep long").parquet(*paths) if paths else spark.createDataFrame([], "ask long, rep long")


#: (vectors scored exactly, vectors times queries) of each batch of the last search, for tests and reports.
SCORED: list[tuple[int, int]] = []
BEST = "ask long, score double, null boolean, lead long, rep long"


def _best_rows(ask: np.ndarray, best: list[Nearest]) -> pa.RecordBatch:
    flat = [(a, -f[0], *f[1:]) for a, b in zip(ask.tolist(), best) for f in b.found]
    types = (pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], t) for c, t in enumerate(types)], [c.split()[0] for c in BEST.split(", ")])
