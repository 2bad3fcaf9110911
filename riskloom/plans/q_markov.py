"""Queries of the Markov operators (M*, W5, J9-J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions.scalar import q6
from riskloom.operators import markov as M
from riskloom.operators.graph import history_tail
from riskloom.plans import projection as P
from riskloom.plans.registry import query

# ---------------------------------------------------------------- SQL texts

_ROWS = [[j for j in range(6) if C.BASE_TPM[i][j] > 0] for i in range(6)]


def _raw(i: int, j: int) -> str:
    base = f"{C.BASE_TPM[i][j]}::DOUBLE"
    special = {
        (1, 2): f"greatest(0, least(1, 0.4::DOUBLE * {base} + 0.6::DOUBLE * exploit))",
        (2, 3): f"greatest(0, least(1, 0.5::DOUBLE * {base} + 0.5::DOUBLE * exploit * (impact / 10)))",
        (3, 4): f"least(1, {base} + 0.3::DOUBLE * crit)",
        (4, 5): f"greatest(0.01::DOUBLE, {base} - 0.2::DOUBLE * (impact / 10))",
        (0, 1): f"CASE WHEN exploit > 0.5 THEN least(1, 1.3::DOUBLE * {base}) ELSE {base} END",
    }
    return special.get((i, j), base)


RAW = "raw AS (SELECT *, " + ", ".join(f"{_raw(i, j)} AS r{i}{j}" for i in range(6) for j in _ROWS[i]) + " FROM state)"
TPM = "tpm AS (SELECT *, " + ", ".join(f"r{i}{j} / ({' + '.join(f'r{i}{k}' for k in _ROWS[i])}) AS p{i}{j}" for i in range(6) for j in _ROWS[i]) + " FROM raw)"
WITH_TPM = f"WITH {P.ASSET}, {P.PAIR}, {P.SIGNAL}, {P.STATE}, {RAW}, {TPM}"


def _step_sql(src: str = "", matrix: str = "p") -> str:
    return ", ".join("(" + " + ".join(f"{src}s{i} * {matrix}{i}{j}" for i in range(6) if j in _ROWS[i]) + f") AS s{j}" for j in range(6))


CELLS_SQL = ", ".join(f"p{i}{j}" for i in range(6) for j in _ROWS[i])


def _tpm(spark, sf):
    return M.modulated(P.with_state(P.with_criticality(P.pairs(spark, sf), spark, sf)), "exploit", "impact", "crit")


@query(WITH_TPM + " SELECT vuln_id, asset_id, " + ", ".join(f"{P.q6_sql(f'p{i}{j}')} AS p{i}{j}" for i in range(5) for j in _ROWS[i]) + " FROM tpm")
def tpm_modulate(spark, sf):
    df = _tpm(spark, sf)
    return df.select("vuln_id", "asset_id", *[q6(F.col(f"p{i}{j}")).alias(f"p{i}{j}") for i in range(5) for j in _ROWS[i]])


_CP = {(i, j): f"p{i}{j}" for i in range(6) for j in _ROWS[i]}
_CP[1, 2], _CP[2, 3] = "least(1, p12 + 0.15::DOUBLE * coalesce(pressure, 0))", "least(1, p23 + 0.075::DOUBLE * coalesce(pressure, 0))"
_NORM = lambda i, j: f"({_CP[i, j]}) / ({' + '.join(_CP[i, k] for k in _ROWS[i])})"
PRESSURE = f"""{P.CONNECT}, pressure AS (SELECT s.vuln_id, s.asset_id, avg(o.s2 + o.s3) AS pressure FROM state s JOIN connect c ON c.src = s.asset_id JOIN state o ON o.vuln_id = s.vuln_id AND o.asset_id = c.dst GROUP BY ALL)"""


@query(f"{WITH_TPM}, {PRESSURE} SELECT t.vuln_id, t.asset_id, {P.q6_sql('coalesce(pressure, 0)')} AS pressure, {P.q6_sql(_NORM(1, 2))} AS p12, {P.q6_sql(_NORM(2, 3))} AS p23, {P.q6_sql(_NORM(1, 1))} AS p11 FROM tpm t LEFT JOIN pressure USING (vuln_id, asset_id)")
def coupling(spark, sf):
    df = _tpm(spark, sf)
    df = M.coupled(df, M.neighbour_pressure(df, P.connects(spark, sf)))
    return df.select("vuln_id", "asset_id", q6(F.coalesce("pressure", F.lit(0.0))).alias("pressure"), *[q6(F.col(c)).alias(c) for c in ("p12", "p23", "p11")])


_OUT = ", ".join(f"{P.q6_sql(f's{i}')} AS s{i}" for i in range(6))


@query(f"{WITH_TPM}, one AS (SELECT vuln_id, asset_id, {_step_sql()} FROM tpm) SELECT vuln_id, asset_id, {_OUT} FROM one")
def evolve_1(spark, sf):
    df = M.evolved(_tpm(spark, sf), 1)
    return df.select("vuln_id", "asset_id", *[q6(F.col(s)).alias(s) for s in M.PI])


def _walk(n: int) -> str:
    """The chain step by step, in a recursive expression."""
    return f"""walk AS (SELECT vuln_id, asset_id, {CELLS_SQL}, s0, s1, s2, s3, s4, s5, 0 AS k FROM tpm
 UNION ALL SELECT vuln_id, asset_id, {CELLS_SQL}, {_step_sql()}, k + 1 FROM walk WHERE k < {n})"""


@query(f"{WITH_TPM.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_walk(10)} SELECT vuln_id, asset_id, {_OUT} FROM walk WHERE k = 10")
def evolve_k(spark, sf):
    df = M.walked(_tpm(spark, sf).select("vuln_id", "asset_id", *[M.p(*c) for c in M.CELLS], *M.PI), 10)
    return df.select("vuln_id", "asset_id", *[q6(F.col(s)).alias(s) for s in M.PI])


_RISK_SQL = " + ".join(f"{w}::DOUBLE * s{i}" for i, w in enumerate(C.STATE_RISK))


@query(f"{WITH_TPM.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_walk(90)} SELECT vuln_id, asset_id, k AS horizon, {P.q6_sql(_RISK_SQL)} AS risk FROM walk WHERE k IN (1, 7, 14, 30, 90)")
def forecast_horizons(spark, sf):
    df = M.forecast(_tpm(spark, sf))
    long = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), q6(F.col(f"risk_{h}")).alias("risk")) for h in C.HORIZONS]))
    return df.select("vuln_id", "asset_id", long.alias("x")).select("vuln_id", "asset_id", "x.*")


#: Expected steps to absorption from each transient state, t0 .. t4, by elimination.
STEPS = f"""{WITH_TPM}, solved AS (SELECT *, 1 / (1 - p33) AS a3, p34 / (1 - p33) AS b3 FROM tpm),
 s2_ AS (SELECT *, (1 + p23 * a3) / (1 - p22) AS a2, (p23 * b3 + p24) / (1 - p22) AS b2 FROM solved),
 s1_ AS (SELECT *, (1 + p12 * a2 + p13 * a3) / (1 - p11) AS a1, (p12 * b2 + p13 * b3 + p14) / (1 - p11) AS b1 FROM s2_),
 s4_ AS (SELECT *, (1 + p41 * a1 + p42 * a2 + p43 * a3) / (1 - p44 - p41 * b1 - p42 * b2 - p43 * b3) AS t4 FROM s1_),
 s3_ AS (SELECT *, a1 + b1 * t4 AS t1, a2 + b2 * t4 AS t2, a3 + b3 * t4 AS t3 FROM s4_),
 s0_ AS (SELECT *, (1 + p01 * t1 + p02 * t2 + p03 * t3 + p04 * t4) / (1 - p00) AS t0 FROM s3_)"""


@query(
    f"""{STEPS}
 SELECT vuln_id, asset_id, {P.q6_sql("(s0 * t0 + s1 * t1 + s2 * t2 + s3 * t3 + s4 * t4) / (s0 + s1 + s2 + s3 + s4)")} AS absorption_time FROM s0_"""
)
def absorption_time(spark, sf):
    df = M.absorption_time(_tpm(spark, sf))
    return df.select("vuln_id", "asset_id", q6(F.col("absorption_time")).alias("absorption_time"))


@query(f"WITH {P.ASSET}, {P.PAIR}, {P.SIGNAL}, {P.STATE} SELECT vuln_id, asset_id, {P.q6_sql('-(' + ' + '.join(f's{i} * ln(s{i})' for i in range(6)) + ')')} AS entropy, list_position([s0, s1, s2, s3, s4, s5], list_max([s0, s1, s2, s3, s4, s5])) - 1 AS dominant FROM state")
def entropy_dominant(spark, sf):
    df = P.with_state(P.with_criticality(P.pairs(spark, sf), spark, sf))
    return df.select("vuln_id", "asset_id", q6(M.entropy_of()).alias("entropy"), M.dominant().alias("dominant"))


def _arrays(spark, sf):
    """All pairs, with the matrix as an array."""
    return _tpm(spark, sf).select("vuln_id", "asset_id", M.as_matrix().alias("matrix"), F.array(*M.PI).alias("dist"))


def _long(df, col: str, name: str):
    return df.select("vuln_id", "asset_id", F.posexplode(col).alias("state", name)).withColumn(name, q6(F.col(name)))


# one state absorbs: it is reached with certainty, holds all mass in the end, and the condition of reaching it changes no expectation
@query(f"WITH {P.PAIR} SELECT vuln_id, asset_id, unnest(range(5)) AS state, 1.0::DOUBLE AS probability FROM pair")
def absorption_prob(spark, sf):
    return _long(M.general_chain(_arrays(spark, sf), "matrix", "dist", "probability"), "probability", "probability")


@query(f"{STEPS} SELECT vuln_id, asset_id, i AS state, {P.q6_sql('[t0, t1, t2, t3, t4][i + 1]')} AS steps FROM s0_, range(5) r(i)")
def conditional_absorption(spark, sf):
    return _long(M.general_chain(_arrays(spark, sf), "matrix", "dist", "conditional"), "conditional", "steps")


#: exp((P - I) * 2.5) as a Poisson mixture of the chain's steps, to 40 of them (the rest is below 1e-30).
@query(
    f"""{WITH_TPM.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_walk(40)}, mixed AS (SELECT vuln_id, asset_id, {", ".join(f"sum(s{i} * exp(-2.5::DOUBLE) * pow(2.5::DOUBLE, k) / gamma(k + 1)) AS s{i}" for i in range(6))} FROM walk GROUP BY vuln_id, asset_id)
 SELECT vuln_id, asset_id, i AS state, {P.q6_sql('[s0, s1, s2, s3, s4, s5][i + 1]')} AS share FROM mixed, range(6) r(i)"""
)
def evolve_continuous(spark, sf):
    return _long(M.general_chain(_arrays(spark, sf), "matrix", "dist", "continuous", 2.5), "continuous", "share")


@query(f"WITH {P.PAIR} SELECT vuln_id, asset_id, i AS state, CASE WHEN i = 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS share FROM pair, range(6) r(i)")
def steady_state(spark, sf):
    return _long(M.general_chain(_arrays(spark, sf), "matrix", "dist", "steady"), "steady", "share")


_SIM = """0.5::DOUBLE * (len(list_intersect(v.cwe_ids, o.cwe_ids)) / len(list_distinct(list_concat(v.cwe_ids, o.cwe_ids)))::DOUBLE) + 0.3::DOUBLE * greatest(0, 1 - abs(v.cvss - o.cvss) / 10) + CASE WHEN lower(v.vendor) = lower(o.vendor) AND v.vendor <> '' THEN 0.2::DOUBLE ELSE 0 END"""
WARM = f"""WITH {P.VULN}, {P.ASSET}, {P.PAIR}, {P.SIGNAL}, {P.STATE},
 cand AS (SELECT v.vuln_id, o.vuln_id AS other, {_SIM} AS sim FROM vuln v JOIN vuln o ON v.vuln_id <> o.vuln_id AND (list_has_any(v.cwe_ids, o.cwe_ids) OR abs(v.cvss - o.cvss) < 2.0)),
 top AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY vuln_id ORDER BY floor(sim * 1e9 + 0.5) DESC, other) <= 5),
 st AS (SELECT vuln_id AS other, s0, s1, s2, s3, s4, s5 FROM state WHERE vuln_id % 10 < 7 QUALIFY row_number() OVER (PARTITION BY vuln_id ORDER BY asset_id) = 1),
 m AS (SELECT t.vuln_id, sum(sim) AS w, {", ".join(f"sum(sim * s{i}) AS s{i}" for i in range(6))} FROM top t JOIN st USING (other) GROUP BY t.vuln_id)
 SELECT v.vuln_id, {", ".join(P.q6_sql(f"CASE WHEN w > 0 THEN s{i} / w ELSE {float(i == 0)}::DOUBLE END") + f" AS s{i}" for i in range(6))} FROM vuln v LEFT JOIN m USING (vuln_id)"""


@query(WARM)
def warm_start_knn(spark, sf):
    states = P.with_state(P.with_criticality(P.pairs(spark, sf), spark, sf)).where("vuln_id % 10 < 7")
    df = M.warm_start(P.vulns(spark, sf), states)
    return df.select("vuln_id", *[q6(F.col(s)).alias(s) for s in M.PI])


@query(
    f"""WITH {P.HISTORY}, a AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY key ORDER BY ts, event_id) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS n FROM history),
 b AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, event_id) AS island FROM a)
 SELECT key, event_id, CAST(row_number() OVER (PARTITION BY key, island ORDER BY ts, event_id) - 1 AS BIGINT) AS updates_in_state FROM b"""
)
def time_in_state(spark, sf):
    df = M.time_in_state(P.history(spark, sf), "key", ["ts", "event_id"], "state")
    return df.select("key", "event_id", F.col("updates_in_state").cast("long").alias("updates_in_state"))


@query(
    f"""WITH {P.HISTORY}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS b FROM history)
 SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS position FROM t WHERE b <= 10"""
)
def history_tail_10(spark, sf):
    return history_tail(P.history(spark, sf), ["key"], ["ts", "event_id"], 10).select("key", "event_id", F.col("position").cast("long").alias("position"))
