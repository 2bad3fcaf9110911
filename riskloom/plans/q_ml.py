"""Queries of the text features and the models (E*, L*). Sizes are the operators' defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scalar import d, q6
from riskloom.operators import ml, text
from riskloom.plans import projection as P
from riskloom.plans.projection import q6_sql
from riskloom.plans.registry import query

def _texts(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


#: Spark's list of English stop words, as the queries pass it and the SQL texts list it.
STOP = ("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now would could ought cannot").split()  # fmt: skip


def _tfidf_sql(table: str, key: str, body: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"""WITH t AS (SELECT {key}, unnest(regexp_extract_all(lower({body}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {table}), tf AS (SELECT {key}, term, count(*) AS tf FROM t WHERE term NOT IN ({stop}) GROUP BY ALL),
 v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000), w AS (SELECT {key}, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {table})) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN v USING (term))
 SELECT {key}, term, {q6_sql(f'w / sqrt(sum(w * w) OVER (PARTITION BY {key}))')} AS weight FROM w"""


@query(_tfidf_sql("part", "p_partkey", "p_name || ' ' || p_type || ' ' || p_brand"))
def tfidf(spark, sf):
    return text.tfidf(_texts(spark, sf), "p_partkey", "text", stop=text.stop_words()).select("p_partkey", "term", q6(F.col("weight")).alias("weight"))


@query(_tfidf_sql("documents", "doc_id", "text"))
def tfidf_documents(spark, sf):
    """E1 on prose in four languages, with letters beyond ASCII."""
    return text.tfidf(P.table(spark, sf, "documents"), "doc_id", "text", stop=text.stop_words()).select("doc_id", "term", q6(F.col("weight")).alias("weight"))


@query()
def svd_embed(spark, sf):
    return text.svd_embedding(text.tfidf(_texts(spark, sf), "p_partkey", "text", stop=text.stop_words()), "p_partkey")


NAMES = ["cvss", "cvss_exploitability", "cvss_impact", "patch_lag_days", "missing_feature"]


def _training(spark, sf):
    v = P.vulns(spark, sf)
    return v.select("vuln_id", *[c for c in NAMES if c in v.columns], F.col("is_in_kev").cast("double").alias("y"), F.least(d(10), F.col("cvss") * 1.1).alias("impact"), F.when(F.col("cvss") >= 9, 3.0).when(F.col("cvss") >= 7, 2.0).when(F.col("cvss") >= 4, 1.0).otherwise(0.0).alias("tier"))


@query()
def elp_gbt(spark, sf):
    t = _training(spark, sf)
    return ml.predict(t, ml.train_elp(t, NAMES, "y"), NAMES, "elp")


@query()
def isa_gbt(spark, sf):
    t = _training(spark, sf)
    return ml.predict(t, ml.train_isa(t, NAMES, "impact"), NAMES, "isa")


@query()
def acc_rf(spark, sf):
    t = _training(spark, sf)
    return ml.predict(t, ml.train_acc(t, NAMES, "tier"), NAMES, "acc").select("vuln_id", F.posexplode("acc").alias("tier", "probability"))


_CONF = lambda raw: f"greatest(0.05::DOUBLE, least(1, {raw} * 0.8::DOUBLE * greatest(0.05::DOUBLE, exp(-ln(2::DOUBLE) / 90 * (vuln_id % 200)))))"


@query(
    f"""WITH {P.VULN}, s AS (SELECT vuln_id, greatest(0, least(1, 0.5::DOUBLE * (cvss / 10) + CASE WHEN has_public_exploit THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_in_kev THEN 0.30::DOUBLE ELSE 0 END)) AS elp, cvss AS isa FROM vuln)
 SELECT vuln_id, {q6_sql(_CONF('elp'))} AS exploit_probability, isa AS impact_adjustment, {q6_sql(_CONF('1'))} AS confidence FROM s"""
)
def inference_bundle(spark, sf):
    out = ml.bundle(ml.rule_scores(P.vulns(spark, sf)), d(0.8), (F.col("vuln_id") % 200).cast("double"))
    return out.select("vuln_id", q6(F.col("exploit_probability")).alias("exploit_probability"), "impact_adjustment", q6(F.col("confidence")).alias("confidence"))
