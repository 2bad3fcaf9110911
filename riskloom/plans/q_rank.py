"""Queries of the ranking operators (R*) and back-test metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.lineage import cut, many, saved
from riskloom.functions.scalar import q6
from riskloom.operators import backtest as B
from riskloom.operators import rank as K
from riskloom.plans import projection as P
from riskloom.plans.projection import q6_sql
from riskloom.plans.registry import query


def _items(spark, sf):
    v = P.vulns(spark, sf).select("vuln_id", "is_in_kev", "has_public_exploit", "exploit_velocity_days")
    r = P.risks(spark, sf).join(many(v), "vuln_id")
    return r.select(
        F.concat_ws("::", "vuln_id", "asset_id").alias("pair_key"),
        F.col("risk").alias("composite_risk"),
        F.col("cost").alias("remediation_cost"),
        F.col("exploit").alias("exploit_likelihood"),
        F.col("impact").alias("adjusted_impact"),
        "is_in_kev",
        "has_public_exploit",
        "exploit_velocity_days",
    )


ITEMS = f"""{P.WITH_PAIR}, {P.VULN}, items AS (SELECT r.vuln_id || '::' || r.asset_id AS pair_key, risk AS composite_risk, cost AS remediation_cost, exploit AS exploit_likelihood, impact AS adjusted_impact, is_in_kev, has_public_exploit, exploit_velocity_days
 FROM risk r JOIN vuln v ON v.vuln_id = r.vuln_id)"""


@query(f"{ITEMS} SELECT pair_key, composite_risk, remediation_cost FROM items i WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT composite_risk, remediation_cost FROM items) o WHERE o.composite_risk >= i.composite_risk AND o.remediation_cost <= i.remediation_cost AND (o.composite_risk > i.composite_risk OR o.remediation_cost < i.remediation_cost))")
def pareto_front1(spark, sf):
    return K.pareto_front(_items(spark, sf), "composite_risk", "remediation_cost").where("not dominated").select("pair_key", "composite_risk", "remediation_cost")


@query()
def pareto_layers(spark, sf):
    """Every item's front at full precision. In SQL a front is a longest chain, too slow on whole tables; tests hold it against brute force."""
    items = cut(_items(spark, sf).select("pair_key", "composite_risk", "remediation_cost"))
    return K.pareto_chain(items, "composite_risk", "remediation_cost").select("pair_key", "front")


@query(f"{ITEMS} SELECT pair_key, {q6_sql('composite_risk / greatest(remediation_cost, 0.01)')} AS benefit_ratio, row_number() OVER (ORDER BY {q6_sql('composite_risk / greatest(remediation_cost, 0.01)')} DESC, pair_key) AS cost_benefit_rank FROM items")
def cost_benefit(spark, sf):
    i = K.cost_benefit(_items(spark, sf), "composite_risk", "remediation_cost").select("pair_key", q6(F.col("benefit_ratio")).alias("benefit_ratio"))
    return K.global_rank(i, [F.desc("benefit_ratio"), F.col("pair_key")], "cost_benefit_rank").withColumn("cost_benefit_rank", F.col("cost_benefit_rank").cast("long"))


_URG = "composite_risk * CASE WHEN is_in_kev THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN has_public_exploit THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN exploit_velocity_days >= 0 THEN greatest(1::DOUBLE, 2 - exploit_velocity_days / 30.0::DOUBLE) ELSE 1 END"


@query(f"{ITEMS}, u AS (SELECT pair_key, {q6_sql(_URG)} AS urgency FROM items) SELECT *, row_number() OVER (ORDER BY urgency DESC, pair_key) AS time_rank FROM u")
def time_sensitive(spark, sf):
    i = K.urgency(_items(spark, sf), "composite_risk", "is_in_kev", "has_public_exploit", "exploit_velocity_days").select("pair_key", q6(F.col("urgency")).alias("urgency"))
    return K.global_rank(i, [F.desc("urgency"), F.col("pair_key")], "time_rank").withColumn("time_rank", F.col("time_rank").cast("long"))


_T = {"composite_risk": (0.35, True), "exploit_likelihood": (0.25, True), "adjusted_impact": (0.25, True), "remediation_cost": (0.15, False)}
TOPSIS = f"""{ITEMS}, nm AS (SELECT {", ".join(f"sqrt(sum({k} * {k})) AS n_{k}" for k in _T)} FROM items),
 sc AS (SELECT pair_key, {", ".join(f"{k} / n_{k} * {w}::DOUBLE AS v_{k}" for k, (w, _) in _T.items())} FROM items, nm),
 ex AS (SELECT {", ".join(f"max(v_{k}) AS hi_{k}, min(v_{k}) AS lo_{k}" for k in _T)} FROM sc),
 ds AS (SELECT pair_key, sqrt({" + ".join(f"pow(v_{k} - {'hi' if g else 'lo'}_{k}, 2)" for k, (_, g) in _T.items())}) AS best, sqrt({" + ".join(f"pow(v_{k} - {'lo' if g else 'hi'}_{k}, 2)" for k, (_, g) in _T.items())}) AS worst FROM sc, ex),
 topsis AS (SELECT pair_key, {q6_sql("worst / (best + worst + 1e-12)")} AS closeness FROM ds)"""


def _topsis(spark, sf):
    i = saved(_items(spark, sf).select("pair_key", *_T))  # read for the extremes, the norms and the rows
    return K.topsis(i, K.topsis_criteria(None)).select("pair_key", q6(F.col("closeness")).alias("closeness"))


@query(f"{TOPSIS} SELECT pair_key, closeness, row_number() OVER (ORDER BY closeness DESC, pair_key) AS topsis_rank FROM topsis")
def topsis(spark, sf):
    return K.global_rank(_topsis(spark, sf), [F.desc("closeness"), F.col("pair_key")], "topsis_rank").withColumn("topsis_rank", F.col("topsis_rank").cast("long"))


RANKS = f"""{TOPSIS}, ranks AS (SELECT i.pair_key, row_number() OVER (ORDER BY {q6_sql('composite_risk / greatest(remediation_cost, 0.01)')} DESC, i.pair_key) AS a, row_number() OVER (ORDER BY {q6_sql(_URG)} DESC, i.pair_key) AS b,
 row_number() OVER (ORDER BY closeness DESC, i.pair_key) AS c FROM items i JOIN topsis t ON t.pair_key = i.pair_key)"""


def _ranks(spark, sf):
    i = saved(_items(spark, sf))  # read for the norms, the extremes, the ranges and the rows
    i = K.urgency(K.cost_benefit(i, "composite_risk", "remediation_cost"), "composite_risk", "is_in_kev", "has_public_exploit", "exploit_velocity_days")
    i = K.topsis(i, K.topsis_criteria(None)).select("pair_key", *[q6(F.col(c)).alias(c) for c in ("benefit_ratio", "urgency", "closeness")])
    for order, name in (("benefit_ratio", "a"), ("urgency", "b"), ("closeness", "c")):
        i = K.global_rank(i, [F.desc(order), F.col("pair_key")], name)
    return i


def _ensemble(method: str, sql: str):
    @query(f"{RANKS} SELECT pair_key, {sql} AS ensemble_score, row_number() OVER (ORDER BY {sql}, pair_key) AS final_rank FROM ranks", name=f"ensemble_{method.removeprefix('rank_')}")
    def run(spark, sf):
        i = K.ensemble(_ranks(spark, sf), ["a", "b", "c"], method, [0.5, 0.25, 0.25] if method == "weighted" else None)
        i = i.select("pair_key", q6(F.col("ensemble_score")).alias("ensemble_score"))
        return K.global_rank(i, [F.col("ensemble_score"), F.col("pair_key")], "final_rank").withColumn("final_rank", F.col("final_rank").cast("long"))

    return run


_ensemble("rank_average", q6_sql("(a + b + c) / 3.0::DOUBLE"))
_ensemble("rank_min", q6_sql("least(a, b, c)::DOUBLE"))
_ensemble("weighted", q6_sql("a * 0.5::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE"))


@query()
def prioritization_pipeline(spark, sf):
    cols = ["pair_key", "pareto_rank", "cost_benefit_rank", "time_rank", "topsis_rank", "final_rank"]
    return K.pipeline(_items(spark, sf), keep=["pair_key"]).select(*cols)


# ---------------------------------------------------------------- back-test


def _scored(spark, sf):
    """labels.quality as truth; the document's length, folded, as score."""
    docs = P.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 1000 / 1000).alias("score"))
    return docs.join(P.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


SCORED = "WITH scored AS (SELECT l.doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality AS label, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(f"{SCORED} SELECT {q6_sql('sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)')} AS auc FROM scored p, scored n WHERE p.label = 1 AND n.label <> 1")
def auc(spark, sf):
    return B.auc(_scored(spark, sf), "score", "label").select(q6(F.col("auc")).alias("auc"))


@query(
    f"""{SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM scored),
 r AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall FROM c) SELECT tp, fp, fn, tn, {q6_sql('precision')} AS precision, {q6_sql('recall')} AS recall, {q6_sql('2 * precision * recall / (precision + recall)')} AS f1 FROM r"""
)
def confusion_metrics(spark, sf):
    return B.confusion(_scored(spark, sf), "score", "label").select("tp", "fp", "fn", "tn", *[q6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{SCORED} SELECT {q6_sql('avg(abs(score - label))')} AS mae, {q6_sql('sqrt(avg((score - label) * (score - label)))')} AS rmse FROM scored")
def mae_rmse(spark, sf):
    return B.errors(_scored(spark, sf), "score", "label").select(q6(F.col("mae")).alias("mae"), q6(F.col("rmse")).alias("rmse"))


@query(f"{P.WITH_PAIR} SELECT {q6_sql('avg(CASE WHEN list_position([s0, s1, s2, s3, s4, s5], list_max([s0, s1, s2, s3, s4, s5])) - 1 = vuln_id % 6 THEN 1.0 ELSE 0 END)')} AS accuracy, count(*) AS n FROM risk")
def state_accuracy(spark, sf):
    from riskloom.operators.markov import dominant

    r = P.risks(spark, sf).select(dominant().alias("p"), (F.col("vuln_id") % 6).cast("int").alias("a"))
    return B.state_accuracy(r, "p", "a").select(q6(F.col("accuracy")).alias("accuracy"), "n")


@query(f"{SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 10) SELECT {q6_sql('(SELECT count(*) FILTER (label = 1) / 10.0::DOUBLE FROM t)')} AS precision_at_k, {q6_sql('(SELECT count(*) FILTER (label = 1)::DOUBLE FROM t) / (SELECT count(*) FILTER (label = 1) FROM scored)')} AS recall_at_k")
def precision_at_10(spark, sf):
    x = B.top_k(_scored(spark, sf), [F.desc("score"), F.col("doc_id")], "label")
    return x.select(q6(F.col("precision_at_k")).alias("precision_at_k"), q6(F.col("recall_at_k")).alias("recall_at_k"))


@query(
    f"""{SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 10),
 a AS (SELECT sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM scored p, scored n WHERE p.label = 1 AND n.label <> 1),
 m AS (SELECT avg(abs(score - label)) AS mae FROM scored), c AS (SELECT avg(CASE WHEN toxic = label THEN 1.0 ELSE 0 END) AS acc FROM scored), k AS (SELECT count(*) FILTER (label = 1) / 10.0::DOUBLE AS p FROM t)
 SELECT {q6_sql('(auc + (1 - least(1, mae / 10)) + acc + p) / 4')} AS overall_score FROM a, m, c, k"""
)
def overall_score(spark, sf):
    s = _scored(spark, sf)
    x = B.auc(s, "score", "label").crossJoin(B.errors(s, "score", "label")).crossJoin(B.state_accuracy(s, "toxic", "label")).crossJoin(B.top_k(s, [F.desc("score"), F.col("doc_id")], "label"))
    return x.select(q6(B.overall(F.col("auc"), F.col("mae"), F.col("accuracy"), F.col("precision_at_k"))).alias("overall_score"))


@query(f"""WITH {P.HISTORY}, last AS (SELECT key, mass FROM history QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1) SELECT c_custkey AS key, {q6_sql('mass')} AS actual, {q6_sql('abs(c_acctbal) / 10000')} AS predicted FROM customer JOIN last ON key = c_custkey""")
def backtest_match(spark, sf):
    p = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.abs("c_acctbal") / 10000).alias("predicted"))
    x = B.matched(p, P.history(spark, sf).select("key", "mass", "event_id"), ["key"], "event_id")
    return x.select("key", q6(F.col("mass")).alias("actual"), q6(F.col("predicted")).alias("predicted"))


