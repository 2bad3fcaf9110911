"""Queries of the scalar functions (F-*) and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions import scalar as S
from riskloom.functions.scalar import d, q6
from riskloom.operators import freshness
from riskloom.plans import projection as P
from riskloom.plans.projection import q6_sql
from riskloom.plans.registry import query

_CPE = """CASE p_partkey % 4 WHEN 0 THEN 'cpe:2.3:a:' || lower(p_brand) || ':' || p_type || ':' || p_size || ':*:*:*:*:*:*:*' WHEN 1 THEN 'cpe:/a:' || p_brand || ':' || p_type
 WHEN 2 THEN 'cpe:/o:' || p_brand || ':' || p_type || ':' || p_size ELSE upper(p_name) END"""


def cpe_column():
    k = F.col("p_partkey") % 4
    c = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    return F.when(k == 0, c("cpe:2.3:a:", F.lower("p_brand"), ":", F.col("p_type"), ":", F.col("p_size"), ":*:*:*:*:*:*:*")).when(k == 1, c("cpe:/a:", F.col("p_brand"), ":", F.col("p_type"))).when(k == 2, c("cpe:/o:", F.col("p_brand"), ":", F.col("p_type"), ":", F.col("p_size"))).otherwise(F.upper("p_name"))


CPE_SQL = f"""cpe AS (SELECT p_partkey, {_CPE} AS cpe FROM part),
 canon AS (SELECT *, CASE WHEN regexp_matches(lower(cpe), '^cpe:2\\.3:[aoh]:([^:]+):([^:]+):([^:]+)') THEN
   array_to_string(list_slice(string_split(lower(cpe), ':'), 4, 6), ':')
  WHEN regexp_matches(lower(cpe), '^cpe:/[aoh]:([^:]+):([^:]+)') THEN split_part(lower(cpe), ':', 3) || ':' || split_part(lower(cpe), ':', 4) || ':' || CASE WHEN split_part(lower(cpe), ':', 5) = '' THEN '*' ELSE split_part(lower(cpe), ':', 5) END
  ELSE lower(trim(cpe)) END AS canonical FROM cpe)"""


@query(f"WITH {CPE_SQL} SELECT p_partkey, canonical FROM canon")
def cpe_canonical(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", S.cpe_canonical(cpe_column()).alias("canonical"))


@query(
    f"WITH {P.VULN} SELECT vuln_id, {q6_sql(f'''greatest(0, date_diff('microsecond', published_ts, TIMESTAMP '{P.REF}') / 86400e6)''')} AS disclosed, {q6_sql('''CASE WHEN patch_ts IS NOT NULL THEN greatest(0, date_diff('microsecond', published_ts, patch_ts) / 86400e6) END''')} AS lag FROM vuln"
)
def days_between(spark, sf):
    return P.vulns(spark, sf).select("vuln_id", q6(S.days_between(F.col("published_ts"), P.ref())).alias("disclosed"), q6(S.days_between(F.col("published_ts"), F.col("patch_ts"))).alias("lag"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS none FROM events")
def safe_float(spark, sf):
    return P.table(spark, sf, "events").select("event_id", S.safe_float(F.get_json_object("props", "$.k"), -1.0).alias("k"), S.safe_float(F.col("event_type")).alias("none"))


@query(f"WITH {P.VULN} SELECT vuln_id, {q6_sql('greatest(0, least(1, 0.5::DOUBLE * (cvss / 10) + CASE WHEN has_public_exploit THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_in_kev THEN 0.30::DOUBLE ELSE 0 END))')} AS epss FROM vuln")
def epss_estimate(spark, sf):
    return P.vulns(spark, sf).select("vuln_id", q6(S.epss_estimate(F.col("cvss"), F.col("has_public_exploit"), F.col("is_in_kev"))).alias("epss"))


@query(f"WITH {P.VULN} SELECT vuln_id, CASE lower(exploit_maturity) WHEN 'unproven' THEN 0.1::DOUBLE WHEN 'poc' THEN 0.3::DOUBLE WHEN 'functional' THEN 0.6::DOUBLE WHEN 'weaponized' THEN 0.9::DOUBLE WHEN 'high' THEN 0.8::DOUBLE ELSE 0 END AS maturity FROM vuln")
def maturity_map(spark, sf):
    return P.vulns(spark, sf).select("vuln_id", S.maturity_score(F.col("exploit_maturity")).alias("maturity"))


_AGE = f"date_diff('microsecond', ts, TIMESTAMP '{P.REF}') / 86400e6"


@query(f"SELECT event_id, {q6_sql(f'greatest(0.05::DOUBLE, least(1, least(1, value / 100) * greatest(0.05::DOUBLE, least(1, 0.5::DOUBLE + (user_id % 5) / 10.0::DOUBLE)) * greatest(0.05::DOUBLE, exp(-ln(2::DOUBLE) / 90 * ({_AGE})))))')} AS confidence FROM events")
def confidence_decay(spark, sf):
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), P.ref()) / 86400e6
    return P.table(spark, sf, "events").select("event_id", q6(S.confidence(F.least(d(1), F.col("value") / 100), d(0.5) + (F.col("user_id") % 5) / 10, age)).alias("confidence"))


@query("SELECT event_id, 4 + event_id % 2 AS state, " + q6_sql(f"CASE event_id % 2 WHEN 0 THEN 0.3::DOUBLE * exp(-ln(2::DOUBLE) / 14 * ({_AGE})) ELSE 0.05::DOUBLE * exp(-ln(2::DOUBLE) / 3 * ({_AGE})) END") + " AS residual FROM events")
def risk_decay(spark, sf):
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), P.ref()) / 86400e6
    return P.table(spark, sf, "events").select("event_id", (F.col("event_id") % 2 + 4).alias("state"), q6(S.residual_risk(F.col("event_id") % 2 + 4, age)).alias("residual"))


@query(f"SELECT s_suppkey, {q6_sql('CASE s_suppkey % 3 WHEN 0 THEN -ln(0.01::DOUBLE / 0.3) / (ln(2::DOUBLE) / 14) WHEN 1 THEN -ln(0.01::DOUBLE / 0.05) / (ln(2::DOUBLE) / 3) END')} AS days FROM supplier")
def time_to_negligible(spark, sf):
    return P.table(spark, sf, "supplier").select("s_suppkey", q6(S.time_to_negligible(F.col("s_suppkey") % 3 + 4, 0.01)).alias("days"))


@query(f"WITH {P.VULN} SELECT vuln_id, CASE WHEN cvss >= 9 THEN 3 WHEN cvss >= 7 THEN 2 WHEN cvss >= 4 THEN 1 ELSE 0 END AS tier, CASE WHEN cvss / 10 >= 0.8 THEN 'critical' WHEN cvss / 10 >= 0.6 THEN 'high' WHEN cvss / 10 >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM vuln")
def tier_banding(spark, sf):
    return P.vulns(spark, sf).select("vuln_id", S.tier_of_cvss(F.col("cvss")).alias("tier"), S.risk_band(F.col("cvss") / 10).alias("band"))


@query("SELECT o_orderkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(CAST(o_orderkey AS VARCHAR)), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 10000) AS bucket, CASE WHEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(CAST(o_orderkey AS VARCHAR)), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 10000) / 10000.0 < 0.3 THEN 'A' ELSE 'B' END AS variant FROM orders")
def ab_bucket(spark, sf):
    from riskloom.operators.store import variants

    return variants(P.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query("SELECT c_custkey, " + q6_sql("pow(greatest(0.1::DOUBLE, abs(c_acctbal) / 10000) * (1 + c_nationkey) / 25 * 0.5::DOUBLE, 1 / 3.0::DOUBLE)") + " AS confidence FROM customer")
def geometric_confidence(spark, sf):
    return P.table(spark, sf, "customer").select("c_custkey", q6(S.geometric_mean(F.greatest(d(0.1), F.abs("c_acctbal") / 10000), (F.col("c_nationkey") + 1) / 25, d(0.5))).alias("confidence"))


@query(f"WITH {P.ASSET} SELECT asset_id, 'part ' || hostname || ' ' || zone AS text, CAST(asset_id AS VARCHAR) || '::' || bu AS key FROM asset")
def joined_text(spark, sf):
    return P.assets(spark, sf).select("asset_id", S.joined_text([F.lit(" part "), F.col("hostname"), F.lit(""), F.col("zone")], F.col("asset_id")).alias("text"), S.pair_key(F.col("asset_id"), F.col("bu")).alias("key"))


@query("SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_name || ' ; CWE-' || p_size || ';;' || p_type, ';'), lambda x: trim(x)), lambda x: x <> '')) AS item FROM part")
def split_items(spark, sf):
    joined = F.concat("p_name", F.lit(" ; CWE-"), "p_size", F.lit(";;"), "p_type")
    return P.table(spark, sf, "part").select("p_partkey", F.explode(S.split_list(joined, ";")).alias("item"))


_THRESHOLDS = ", ".join(f"('{k}', {v})" for k, v in C.FRESHNESS_DAYS.items())
_WEIGHTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in C.FRESHNESS_WEIGHT.items())
_FRESH = f"""WITH {P.IMPORTS}, th(source, threshold_days) AS (VALUES {_THRESHOLDS}), wt(source, weight) AS (VALUES {_WEIGHTS}),
 l AS (SELECT source, max(import_ts) AS last_import FROM imports GROUP BY source),
 a AS (SELECT th.*, last_import, greatest(0, date_diff('microsecond', last_import, TIMESTAMP '{P.REF}') / 86400e6) AS age_days FROM th LEFT JOIN l USING (source)),
 r AS (SELECT source, threshold_days, CASE WHEN last_import IS NULL THEN NULL ELSE age_days END AS age_days, last_import IS NULL OR age_days > threshold_days AS stale,
  CASE WHEN last_import IS NULL THEN 0 WHEN age_days <= threshold_days THEN 1 - 0.5::DOUBLE * age_days / threshold_days ELSE 0.5::DOUBLE * exp(-(age_days - threshold_days) / threshold_days) END AS score FROM a)"""


def _report(spark, sf):
    t = spark.createDataFrame(list(C.FRESHNESS_DAYS.items()), "source string, threshold_days int")
    return freshness.report(P.import_log(spark, sf), t, P.ref())


@query(f"{_FRESH} SELECT source, threshold_days, {q6_sql('age_days')} AS age_days, stale, {q6_sql('score')} AS score FROM r")
def freshness_report(spark, sf):
    return _report(spark, sf).select("source", "threshold_days", q6(F.col("age_days")).alias("age_days"), "stale", q6(F.col("score")).alias("score"))


@query(f"{_FRESH} SELECT {q6_sql('sum(weight * score) / sum(weight)')} AS overall_freshness FROM r JOIN wt USING (source)")
def overall_freshness(spark, sf):
    w = spark.createDataFrame(list(C.FRESHNESS_WEIGHT.items()), "source string, weight double")
    return freshness.overall(_report(spark, sf), w).select(q6(F.col("overall_freshness")).alias("overall_freshness"))


@query(f"WITH {P.IMPORTS} SELECT source, max(import_ts) AS last_import FROM imports GROUP BY source")
def latest_import(spark, sf):
    return freshness.latest_imports(P.import_log(spark, sf))


# ---------------------------------------------------------------- distributions, tolerant dates, cosines

_RAW = "[value / 100 - 0.5, (event_id % 7) / 10.0, CASE WHEN event_id % 3 = 0 THEN 2.0 ELSE 0.0 END]::DOUBLE[]"


@query(
    f"""WITH r AS (SELECT event_id, list_transform({_RAW}, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))) AS c FROM events)
 SELECT event_id, i AS state, {q6_sql('CASE WHEN list_sum(c) > 0 THEN c[i + 1] / list_sum(c) ELSE c[i + 1] END')} AS share FROM r, range(3) t(i)"""
)
def renormalised_distribution(spark, sf):
    e = F.col("event_id")
    raw = F.array(F.col("value") / 100 - 0.5, (e % 7) / 10.0, F.when(e % 3 == 0, 2.0).otherwise(0.0))
    x = P.table(spark, sf, "events").select("event_id", F.posexplode(S.renormalised(raw)).alias("state", "share"))
    return x.select("event_id", "state", q6(F.col("share")).alias("share"))


@query(f"SELECT a.vec_id, {q6_sql('list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))')} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l1_distance(spark, sf):
    """The convergence measure, between neighbouring vectors."""
    e = P.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(o, "vec_id").select("vec_id", q6(S.l1(F.col("v"), F.col("w"))).alias("distance"))


@query(f"SELECT a.vec_id, {q6_sql('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, sf):
    from riskloom.operators.text import cosine

    e = P.table(spark, sf, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", q6(cosine("embedding", "other")).alias("cosine"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T12:30:00' END AS TIMESTAMP) AS parsed FROM orders")
def tolerant_timestamps(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("soon")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:30:00")))
    return P.table(spark, sf, "orders").select("o_orderkey", S.parse_ts(raw).cast("timestamp_ntz").alias("parsed"))
