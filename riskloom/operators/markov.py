"""The six-state absorbing Markov chain of each (vulnerability, asset) pair, as scalar columns.

A transition matrix is the columns ``p01`` .. ``p55`` (``p`` and the two states), a distribution the columns ``s0`` ..
``s5``: whole-stage code evaluates them without arrays, lambdas or Python. k steps cost O(log k) matrix products.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import constants as C
from riskloom.functions.lineage import cut, many
from riskloom.functions.scalar import blend, clamp, d

N = range(6)
#: Cells that can be non-zero in any power: no state leads back to 0, 5 leads nowhere.
CELLS = [(0, j) for j in N] + [(i, j) for i in range(1, 5) for j in range(1, 6)] + [(5, 5)]
PI = [f"s{i}" for i in N]


def p(i: int, j: int, prefix: str = "p") -> str:
    return f"{prefix}{i}{j}"


def cell(i: int, j: int, prefix: str = "p") -> Column:
    return F.col(p(i, j, prefix)) if (i, j) in CELLS else d(0)


def _normalised(df: DataFrame, cells: dict[tuple[int, int], Column]) -> DataFrame:
    df = df.withColumns({f"_{i}{j}": x for (i, j), x in cells.items()})
    out = {}
    for i in N:
        row = [F.col(f"_{a}{b}") for a, b in cells if a == i]
        total = row[0]
        for x in row[1:]:
            total = total + x
        for a, b in cells:
            if a == i:
                out[p(a, b)] = F.when(total > 0, F.col(f"_{a}{b}") / total).otherwise(F.col(f"_{a}{b}"))
    return df.withColumns(out).drop(*[f"_{i}{j}" for i, j in cells])


def base_matrix(df: DataFrame) -> DataFrame:
    """M1: the base matrix, rows normalised, on every row.

    It comes from a one-row table and not as literals: the optimizer would fold literals through the powers of the matrix, at a cost that doubles each time.
    """
    row = tuple(C.BASE_TPM[i][j] / sum(C.BASE_TPM[i]) for i, j in CELLS)
    one = df.sparkSession.createDataFrame([row], ", ".join(f"{p(i, j)} double" for i, j in CELLS))
    return df.crossJoin(F.broadcast(one))


def modulated(df: DataFrame, exploit: str, impact: str, criticality: str) -> DataFrame:
    """M2: the base matrix shifted by exploit probability, impact (0 to 10) and criticality, rows normalised."""
    e, m, crit = F.col(exploit), F.col(impact) / 10, F.col(criticality)
    b = C.BASE_TPM
    cells = {(i, j): d(b[i][j]) for i, j in CELLS}
    cells[1, 2] = blend(b[1][2], e, 0.6)
    cells[2, 3] = blend(b[2][3], e * m, 0.5)
    cells[3, 4] = F.least(d(1), crit * 0.3 + b[3][4])
    cells[4, 5] = F.greatest(d(0.01), d(b[4][5]) - m * 0.2)
    cells[0, 1] = F.when(e > 0.5, min(1.0, b[0][1] * 1.3)).otherwise(b[0][1])
    return _normalised(df, cells)


def neighbour_pressure(states: DataFrame, connects: DataFrame) -> DataFrame:
    """(vuln_id, asset_id, pressure): mean of s2 + s3 of the same vulnerability on assets that the asset connects to."""
    near = states.select("vuln_id", F.col("asset_id").alias("dst"), (F.col("s2") + F.col("s3")).alias("mass"))
    return (
        states.select("vuln_id", "asset_id").join(connects.select(F.col("src").alias("asset_id"), "dst").distinct(), "asset_id").join(near, ["vuln_id", "dst"]).groupBy("vuln_id", "asset_id").agg(F.avg("mass").alias("pressure"))
    )


def coupled(df: DataFrame, pressure: DataFrame, strength: float = C.COUPLING) -> DataFrame:
    """M3: neighbours' pressure raises p12 and, by half as much, p23; unchanged without neighbours that have a state.

    All pairs see the previous cycle's states, so the result does not depend on the order of pairs.
    """
    df = df.join(pressure, ["vuln_id", "asset_id"], "left")
    boost = F.coalesce(F.col("pressure"), d(0)) * strength
    cells = {(i, j): F.col(p(i, j)) for i, j in CELLS}
    cells[1, 2] = F.least(d(1), cells[1, 2] + boost)
    cells[2, 3] = F.least(d(1), cells[2, 3] + boost / 2)
    return _normalised(df, cells)


def start(df: DataFrame, state: int = 0) -> DataFrame:
    """All mass on one state."""
    return df.withColumns({f"s{i}": d(i == state) for i in N})


def step(df: DataFrame, prefix: str = "p", out: str = "s") -> DataFrame:
    """One product with a matrix; then clipped and normalised."""
    raw = {}
    for j in N:
        terms = [F.col(f"s{i}") * cell(i, j, prefix) for i in N if (i, j) in CELLS]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        raw[f"_s{j}"] = clamp(total)
    df = df.withColumns(raw)
    total = F.col("_s0")
    for j in range(1, 6):
        total = total + F.col(f"_s{j}")
    return df.withColumns({f"{out}{j}": F.when(total > 0, F.col(f"_s{j}") / total).otherwise(F.col(f"_s{j}")) for j in N}).drop(*raw)


def squared(df: DataFrame, prefix: str, out: str) -> DataFrame:
    cells = {}
    for i, j in CELLS:
        terms = [cell(i, k, prefix) * cell(k, j, prefix) for k in N if (i, k) in CELLS and (k, j) in CELLS]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        cells[p(i, j, out)] = total
    return df.withColumns(cells)


def with_powers(df: DataFrame, up_to: int) -> DataFrame:
    """Columns of the matrix to the powers 2, 4, 8 .. up to ``up_to``: prefixes ``q1_``, ``q2_``, .."""
    prefix, level = "p", 0
    while 2 << level <= up_to:
        df = squared(df, prefix, f"q{level + 1}_")
        prefix, level = f"q{level + 1}_", level + 1
    return df


def evolved(df: DataFrame, steps: int) -> DataFrame:
    """M4: the distribution after so many steps; needs ``with_powers`` for more than one."""
    level = 0
    while steps:
        if steps & 1:
            df = step(df, f"q{level}_" if level else "p")
        steps, level = steps >> 1, level + 1
    return df


def walked(df: DataFrame, steps: int) -> DataFrame:
    """M4: as ``evolved``, without powers: every row's distribution goes through its matrix so many times, by numpy over an Arrow batch.

    As columns, the powers of a row's matrix outgrow what can be compiled. Null cells count 0.
    """
    import numpy as np
    import pyarrow as pa

    names = df.columns
    at, dist = {c: names.index(p(*c)) for c in CELLS}, [names.index(x) for x in PI]

    def run(batches):
        for batch in batches:
            n = len(batch)
            read = lambda i: batch.column(i).cast(pa.float64()).fill_null(0.0).to_numpy()
            cells, s = {c: read(i) for c, i in at.items()}, [read(i) for i in dist]
            for _ in range(steps):
                raw = [np.clip(sum((s[i] * cells[i, j] for i in N if (i, j) in cells), np.zeros(n)), 0, 1) for j in N]
                total = sum(raw, np.zeros(n))
                s = [x / np.where(total > 0, total, 1) for x in raw]
            columns = list(batch.columns)
            for i, x in zip(dist, s):
                columns[i] = pa.array(x)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in PI else f for f in df.schema.fields]))


def drop_powers(df: DataFrame) -> DataFrame:
    return df.drop(*[x for x in df.columns if x[0] == "q" and "_" in x and x[1:].replace("_", "").isdigit()])


def forecast(df: DataFrame, horizons: Iterable[int] = C.HORIZONS) -> DataFrame:
    """``risk_h`` at each horizon, the state risks' weighted sum of the distribution after h steps.

    Only that sum is asked for, so the state risks go backwards, P v, and no distribution forwards: one product of every row's matrix with its
    vector a step, by numpy over an Arrow batch. As columns, 90 steps outgrow what whole-stage code can hold.
    """
    import numpy as np
    import pyarrow as pa

    horizons = sorted(horizons)
    names = [c for c in df.columns if not any(c == f"risk_{h}" for h in horizons)]
    df = df.select(*names)
    at = {c: names.index(p(*c)) for c in CELLS}
    dist = [names.index(x) for x in PI]

    def run(batches):
        for batch in batches:
            n = len(batch)
            read = lambda i: batch.column(i).cast(pa.float64()).fill_null(0.0).to_numpy()
            cells = {c: read(i) for c, i in at.items()}
            v = [np.full(n, float(x)) for x in C.STATE_RISK]
            s = [read(i) for i in dist]
            out = []
            for step in range(1, horizons[-1] + 1):
                v = [sum((cells[i, j] * v[j] for j in N if (i, j) in cells), np.zeros(n)) for i in N]
                if step in horizons:
                    out.append(pa.array(sum((x * y for x, y in zip(s, v)), np.zeros(n))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*names, *[f"risk_{h}" for h in horizons]])

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"risk_{h}", T.DoubleType()) for h in horizons]])
    return df.mapInArrow(run, schema)


def state_risk() -> Column:
    total = F.col("s0") * C.STATE_RISK[0]
    for i in range(1, 6):
        total = total + F.col(f"s{i}") * C.STATE_RISK[i]
    return total


def absorption_time(df: DataFrame) -> DataFrame:
    """M8: expected steps until state 5, in closed form: the transient block is triangular but for state 4's row."""
    q = cell
    one = d(1)
    df = df.withColumns({"_a3": one / (one - q(3, 3)), "_b3": q(3, 4) / (one - q(3, 3))})
    a3, b3 = F.col("_a3"), F.col("_b3")
    df = df.withColumns({"_a2": (one + q(2, 3) * a3) / (one - q(2, 2)), "_b2": (q(2, 3) * b3 + q(2, 4)) / (one - q(2, 2))})
    a2, b2 = F.col("_a2"), F.col("_b2")
    df = df.withColumns({"_a1": (one + q(1, 2) * a2 + q(1, 3) * a3) / (one - q(1, 1)), "_b1": (q(1, 2) * b2 + q(1, 3) * b3 + q(1, 4)) / (one - q(1, 1))})
    a1, b1 = F.col("_a1"), F.col("_b1")
    df = df.withColumn("t4", (one + q(4, 1) * a1 + q(4, 2) * a2 + q(4, 3) * a3) / (one - q(4, 4) - q(4, 1) * b1 - q(4, 2) * b2 - q(4, 3) * b3))
    df = df.withColumns({"t3": a3 + b3 * F.col("t4"), "t2": a2 + b2 * F.col("t4"), "t1": a1 + b1 * F.col("t4")})
    df = df.withColumn("t0", (one + q(0, 1) * F.col("t1") + q(0, 2) * F.col("t2") + q(0, 3) * F.col("t3") + q(0, 4) * F.col("t4")) / (one - q(0, 0)))
    mass = F.col("s0") + F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")
    total = F.col("s0") * F.col("t0")
    for i in range(1, 5):
        total = total + F.col(f"s{i}") * F.col(f"t{i}")
    return df.withColumn("absorption_time", F.when(mass < 1e-12, d(0)).otherwise(total / mass)).drop("_a1", "_a2", "_a3", "_b1", "_b2", "_b3")


def entropy_of() -> Column:
    total = d(0)
    for i in N:
        total = total - F.when(F.col(f"s{i}") > 1e-12, F.col(f"s{i}") * F.ln(F.col(f"s{i}"))).otherwise(0.0)
    return total


def dominant() -> Column:
    """First state of the largest share."""
    out = F.lit(5)
    top = F.greatest(*[F.col(f"s{i}") for i in N])
    for i in reversed(range(5)):
        out = F.when(F.col(f"s{i}") == top, i).otherwise(out)
    return out


def similar(v: str = "", o: str = "_") -> Column:
    """Half the weaknesses' Jaccard share, 0.3 by score distance, 0.2 for the same vendor; columns of one side are prefixed ``v``, the other's ``o``."""
    x, y = F.col(f"{v}cwe_ids"), F.col(f"{o}cwe_ids")
    union = F.size(F.array_union(x, y))
    jaccard = F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(d(0))
    vendor = F.when((F.lower(f"{v}vendor") == F.lower(f"{o}vendor")) & (F.col(f"{v}vendor") != ""), 0.2).otherwise(0.0)
    return jaccard * 0.5 + F.greatest(d(0), d(1) - F.abs(F.col(f"{v}cvss") - F.col(f"{o}cvss")) / 10) * 0.3 + vendor


def _rounded(x: Column) -> Column:
    """Similarities are compared at nine digits, so the order of sums does not decide."""
    return F.floor(x * 1e9 + 0.5)


def _nearest_by_score(v: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, cvss, other): for each score of a group (``keys``) the k + 1 ids of the group nearest by score, ties to the smaller id.

    A group is first cut to k + 1 ids a score (partial top-k runs before the shuffle); what lies k scores away cannot be among the nearest.
    """
    first = v.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "cvss").orderBy("vuln_id"))).where(F.col("_n") <= k + 1)
    values = first.groupBy(*keys, "cvss").agg(F.sort_array(F.collect_list("vuln_id")).alias("_ids"))
    beside = Window.partitionBy(*keys).orderBy("cvss").rowsBetween(-k, k)
    near = values.withColumn("_near", F.collect_list(F.struct(F.col("cvss").alias("c"), F.col("_ids").alias("ids"))).over(beside))
    near = near.select(*keys, "cvss", F.explode("_near").alias("x")).select(*keys, "cvss", F.col("x.c").alias("_c"), F.explode("x.ids").alias("other"))
    order = [_rounded(F.abs(F.col("cvss") - F.col("_c"))), F.col("other")]
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "cvss").orderBy(*order))).where(F.col("_n") <= k + 1)
    return best.select(*keys, "cvss", "other")


def most_similar(vulns: DataFrame, k: int = 5, band: float = 2.0) -> DataFrame:
    """(vuln_id, other, similarity): the k most similar of the vulnerabilities that share a weakness or whose scores differ by less than ``band``.

    Exact, without comparing all pairs. Similarity depends on weaknesses, score and vendor alone, so vulnerabilities equal in these (a cell) have the
    same k + 1 most similar ones, of which each leaves out itself, and only the k + 1 smallest ids of a cell can be anyone's. The nearest by score in
    the own set of weaknesses, of the own vendor, in both and in all hold every partner that could be among them with equal sets or with no weakness in common. What they
    reach is a bound: another set is looked into only where its Jaccard share, with score and vendor at their best, could beat it.

    Cells may be as many as vulnerabilities, and the planner takes them for less than they are: their joins are told to sort, or all would go through the driver.
    """
    # neither a missing vendor nor an empty one is like another, neither missing weaknesses nor none are shared
    v = cut(vulns.select("vuln_id", "cvss", F.coalesce(F.array_sort(F.array_distinct("cwe_ids")), F.array().cast("array<string>")).alias("cwe_ids"), F.coalesce(F.lower("vendor"), F.lit("")).alias("vendor")))
    cell = F.struct("cwe_ids", "vendor", "cvss").alias("cell")  # structs are equal where their nulls are, so a cell without a score is one too
    own = Window.partitionBy("cwe_ids", "vendor", "cvss").orderBy("vuln_id")
    m = cut(v.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k + 1).drop("_n"))
    cells = m.select("cwe_ids", "vendor", "cvss").distinct().withColumn("_all", F.lit(1))
    pairs = None
    for g in (["cwe_ids"], ["cwe_ids", "vendor"], ["vendor"], ["_all"]):
        got = cells.join(_nearest_by_score(m.withColumn("_all", F.lit(1)), g, k).hint("merge"), [*g, "cvss"]).select(cell, "other")
        pairs = got if pairs is None else pairs.unionByName(got)
    o = m.select(F.col("vuln_id").alias("other"), *[F.col(x).alias(f"_{x}") for x in ("cvss", "cwe_ids", "vendor")])

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(o.hint("merge"), "other").select("cell", "cell.*", "other", "_cvss", "_cwe_ids", "_vendor")
        both = both.where(F.arrays_overlap("cwe_ids", "_cwe_ids") | (F.abs(F.col("cvss") - F.col("_cvss")) < band))
        return both.select("cell", "other", similar().alias("similarity"))

    best = Window.partitionBy("cell").orderBy(F.desc(_rounded(F.col("similarity"))), "other")
    top = cut(scored(pairs.distinct()).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1))
    bound = top.where(F.col("_n") == k + 1).select("cell", F.col("similarity").alias("_bound"))
    # pairs of different sets with a weakness in common, once for each pair of sets
    sets = m.select("cwe_ids").distinct().select("cwe_ids", F.explode("cwe_ids").alias("cwe"))
    other_sets = sets.join(sets.withColumnRenamed("cwe_ids", "_cwe_ids"), "cwe").where("cwe_ids <> _cwe_ids").select("cwe_ids", "_cwe_ids").distinct()
    share = F.size(F.array_intersect("cwe_ids", "_cwe_ids")) / F.size(F.array_union("cwe_ids", "_cwe_ids"))
    other_sets = other_sets.withColumn("_share", share)
    # a set's cells stay rows: one without weaknesses may hold a third of all; sets that no cell of the other can gain from go first
    asks = cut(cells.select(cell).join(bound.hint("merge"), "cell", "left").select("cell", F.col("cell.cwe_ids").alias("cwe_ids"), F.coalesce("_bound", d(0)).alias("bound")))
    best_share = F.col("_share") * 0.5 + 0.5 + 1e-9
    least = asks.groupBy("cwe_ids").agg(F.min("bound").alias("_least"))
    other_sets = other_sets.join(least, "cwe_ids").where(best_share >= F.col("_least")).drop("_least")
    asks = asks.join(other_sets, "cwe_ids").where(best_share >= F.col("bound")).drop("cwe_ids")
    reach = F.col("_share") * 0.5 + F.greatest(d(0), d(1) - F.abs(F.col("cell.cvss") - F.col("_cvss")) / 10) * 0.3 + F.when(F.col("cell.vendor") == F.col("_vendor"), 0.2).otherwise(0.0)
    more = asks.join(o.hint("merge"), "_cwe_ids").where(reach >= F.col("bound") - 1e-9).select("cell", "other")
    both = top.drop("_n").unionByName(scored(more.join(top.select("cell", "other").hint("merge"), ["cell", "other"], "left_anti")))
    both = both.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = both.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("_n", "other", "similarity"))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["other"] != F.col("vuln_id")), 1, k)
    return v.select("vuln_id", cell).join(lists.hint("merge"), "cell").select("vuln_id", F.explode(others).alias("x")).select("vuln_id", "x.other", "x.similarity")


def warm_start(vulns: DataFrame, states: DataFrame, k: int = 5) -> DataFrame:
    """For each vulnerability the similarity-weighted mean of its k most similar ones' distributions.

    The k are taken before looking whether they have a state; a vulnerability's state is that of its smallest asset_id. Without any, all
    mass is on state 0.
    """
    any_state = states.groupBy(F.col("vuln_id").alias("other")).agg(F.min_by(F.struct(*PI), "asset_id").alias("x")).select("other", "x.*")
    mean = most_similar(vulns, k).join(many(any_state), "other").groupBy("vuln_id").agg(F.sum("similarity").alias("_w"), *[F.sum(F.col("similarity") * F.col(s)).alias(s) for s in PI])
    out = vulns.select("vuln_id").join(many(mean), "vuln_id", "left")
    has = F.col("_w") > 0
    return out.select("vuln_id", *[F.when(has, F.col(f"s{i}") / F.col("_w")).otherwise(d(i == 0)).alias(f"s{i}") for i in N])


def time_in_state(history: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Updates since the dominant state last changed, at every history row (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    h = history.withColumn("_new", F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1))
    h = h.withColumn("_island", F.sum("_new").over(w))
    return h.withColumn("updates_in_state", F.row_number().over(Window.partitionBy(key, "_island").orderBy(*order)) - 1).drop("_new", "_island")


# ---------------------------------------------------------------- arbitrary matrices


def general_chain(df: DataFrame, matrix: str, dist: str, what: str, delta: float = 1.0) -> DataFrame:
    """M5, M7, M8, M9 for any 6 x 6 matrix column (array of rows): a column ``what``, by numpy on all matrices of an Arrow batch at once.

    what: ``continuous`` (distribution after ``delta`` by exp((P - I) delta)), ``steady`` (left eigenvector of the eigenvalue nearest 1),
    ``absorption`` (expected steps from each transient state; infinite if singular), ``probability`` (absorption probabilities into the last state)
    or ``conditional`` (steps from each transient state given absorption there). Null where matrix or distribution is null.
    """
    import numpy as np
    import pyarrow as pa

    def exp(q: np.ndarray) -> np.ndarray:
        squarings = max(0, int(np.ceil(np.log2(max(np.abs(q).sum((1, 2)).max(initial=0), 1e-12)))) + 4)
        x = q / 2**squarings
        out = term = np.broadcast_to(np.eye(6), q.shape)
        for n in range(1, 16):
            term = term @ x / n
            out = out + term
        for _ in range(squarings):
            out = out @ out
        return out

    def solve(m: np.ndarray, pi: np.ndarray) -> np.ndarray:
        if what == "continuous":
            x = np.clip(np.einsum("ni,nij->nj", pi, exp((m - np.eye(6)) * delta)), 0, 1)
            total = x.sum(1, keepdims=True)
            return np.where(total > 0, x / np.where(total > 0, total, 1), x)
        if what == "steady":
            values, vectors = np.linalg.eig(np.swapaxes(m, 1, 2))
            x = np.abs(np.real(vectors[np.arange(len(m)), :, np.abs(values - 1).argmin(1)]))
            return x / x.sum(1, keepdims=True)
        a = np.eye(5) - m[:, :5, :5]
        singular = np.abs(np.linalg.det(a)) < 1e-300
        a[singular] = np.eye(5)
        fundamental = np.linalg.inv(a)
        prob = np.einsum("nij,nj->ni", fundamental, m[:, :5, 5])
        if what == "absorption":
            out = fundamental.sum(2)
        elif what == "probability":
            out = prob
        else:
            out = np.einsum("nij,nj->ni", fundamental, prob) / np.where(prob > 0, prob, 1)
        out[singular] = np.inf
        return out

    at, by, names = df.columns.index(matrix), df.columns.index(dist), df.columns

    def run(batches):
        for batch in batches:
            m, pi = batch.column(at), batch.column(by)
            known = pa.array(m.is_valid().to_numpy(zero_copy_only=False) & pi.is_valid().to_numpy(zero_copy_only=False))
            ms = m.filter(known).flatten().flatten().cast(pa.float64()).to_numpy().reshape(-1, 6, 6)
            rows = iter(solve(ms, pi.filter(known).flatten().cast(pa.float64()).to_numpy().reshape(-1, 6)).tolist() if len(ms) else [])
            out = pa.array([next(rows) if k else None for k in known.to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, what])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(what, T.ArrayType(T.DoubleType()))]))


def as_matrix(prefix: str = "p") -> Column:
    return F.array(*[F.array(*[cell(i, j, prefix) for j in N]) for i in N])
