"""The feature families, each at its own grain (vulnerability, asset or pair), and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.lineage import many
from riskloom.functions.scalar import argmax, d, days_between, epss_estimate, maturity_score, padded, safe_float

MOST_COLUMNS = 10_000


def temporal(pairs: DataFrame, vulns: DataFrame, assets: DataFrame, exploits: DataFrame, ref: Column) -> DataFrame:
    """F-date3: six features a pair; -1 where unknown. exploits: (vuln_id, published_ts) of linked exploit indicators.

    vulns: vuln_id, published_ts, patch_ts; assets: asset_id, last_scan_ts.
    """
    first = exploits.groupBy("vuln_id").agg(F.min("published_ts").alias("_exploit"))
    x = pairs.select("vuln_id", "asset_id").join(many(vulns.select("vuln_id", "published_ts", "patch_ts")), "vuln_id").join(many(first), "vuln_id", "left").join(assets.select("asset_id", "last_scan_ts"), "asset_id", "left")
    known = lambda e: F.coalesce(e, d(-1))
    return x.select(
        "vuln_id",
        "asset_id",
        known(days_between(F.col("published_ts"), ref)).alias("days_since_disclosure"),
        known(days_between(F.col("_exploit"), ref)).alias("days_since_exploit_published"),
        known(days_between(F.col("published_ts"), F.col("_exploit"))).alias("exploit_velocity"),
        known(days_between(F.col("patch_ts"), ref)).alias("days_since_patch_available"),
        known(days_between(F.col("published_ts"), F.col("patch_ts"))).alias("patch_lag"),
        known(days_between(F.col("last_scan_ts"), ref)).alias("days_since_last_scan"),
    )


def threat_intel(vulns: DataFrame, edges: DataFrame, nodes: DataFrame, ref: Column) -> DataFrame:
    """Eight features a vulnerability: flags, maturity, distinct neighbours by type (both directions) and the newest one's age.

    vulns: vuln_id, has_public_exploit, is_in_kev, exploit_maturity; nodes: node_id, node_type, modified_ts.
    """
    v = vulns.select("vuln_id")
    both = edges.select(F.col("src").alias("vuln_id"), F.col("dst").alias("node_id")).unionAll(edges.select(F.col("dst").alias("vuln_id"), F.col("src").alias("node_id")))
    near = both.join(many(v), "vuln_id", "left_semi").distinct().join(many(nodes.select("node_id", "node_type", "modified_ts")), "node_id")
    n = lambda t: F.sum(F.when(F.col("node_type") == t, 1.0).otherwise(0.0))
    g = near.groupBy("vuln_id").agg(n("ThreatActor").alias("ta"), n("Campaign").alias("ca"), n("Indicator").alias("io"), n("TTP").alias("tt"), F.max("modified_ts").alias("newest"))
    x = vulns.join(many(g), "vuln_id", "left")
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    return x.select(
        "vuln_id",
        flag("has_public_exploit").alias("has_public_exploit"),
        maturity_score(F.col("exploit_maturity")).alias("exploit_maturity_score"),
        flag("is_in_kev").alias("is_in_kev"),
        *[F.coalesce(c, d(0)).alias(name) for c, name in (("ta", "threat_actor_interest"), ("ca", "campaign_count"), ("io", "ioc_count"), ("tt", "ttp_count"))],
        F.coalesce(days_between(F.col("newest"), ref), d(-1)).alias("intel_freshness_days"),
    )


def weakness_siblings(vulns: DataFrame, exploited: str = "exploited") -> DataFrame:
    """Vulnerabilities that share a weakness, itself included: how many, and the exploited share.

    Weaknesses are few and hot, so each vulnerability's distinct *set* of weaknesses stands for all that have it: sets are counted, siblings of a set are sums over
    sets that overlap it, and no pair of vulnerabilities is formed.
    """
    v = vulns.select("vuln_id", F.array_sort(F.array_distinct("cwe_ids")).alias("cwes"), F.col(exploited).cast("int").alias("hit"))
    sets = v.where(F.size("cwes") > 0).groupBy("cwes").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    a = sets.select("cwes", F.explode("cwes").alias("cwe"))
    b = sets.select(F.col("cwes").alias("other"), "n", "hits", F.explode("cwes").alias("cwe"))
    near = a.join(b, "cwe").select("cwes", "other", "n", "hits").distinct().groupBy("cwes").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    out = v.join(near, "cwes", "left")
    return out.select("vuln_id", F.coalesce("n", F.lit(0)).cast("double").alias("sibling_vuln_count"), F.coalesce(F.col("hits") / F.col("n"), d(0)).alias("historical_exploit_rate"))


def vendor_patch_rate(vulns: DataFrame) -> DataFrame:
    """Mean patch lag (0 or more) of the vendor, whatever its case; -1 if none."""
    key = F.lower(F.col("vendor"))
    rate = vulns.where(F.col("patch_lag_days") >= 0).groupBy(key.alias("_v")).agg(F.avg("patch_lag_days").alias("_rate"))
    return vulns.withColumn("_v", key).join(rate, "_v", "left").select("vuln_id", F.coalesce("_rate", d(-1)).alias("vendor_patch_rate"))


def historical(vulns: DataFrame) -> DataFrame:
    """Seven features a vulnerability: scores, the local likelihood estimate, siblings and the vendor's patch rate."""
    base = vulns.select(
        "vuln_id",
        safe_float(F.col("cvss").cast("string")).alias("cvss_base_score"),
        safe_float(F.col("cvss_exploitability").cast("string")).alias("cvss_exploitability"),
        safe_float(F.col("cvss_impact").cast("string")).alias("cvss_impact"),
        epss_estimate(F.col("cvss"), F.col("has_public_exploit"), F.col("is_in_kev")).alias("epss_score_estimate"),
    )
    siblings = weakness_siblings(vulns.withColumn("exploited", F.col("is_in_kev") | F.col("has_public_exploit")))
    return base.join(many(siblings), "vuln_id").join(many(vendor_patch_rate(vulns)), "vuln_id")


def trajectory_slope(history: DataFrame, current: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Least-squares slope of the value over the last 3 history rows and the current one; 0 under 2 history rows."""
    back = Window.partitionBy(*key).orderBy(*[F.desc(x) for x in order])
    h = history.withColumn("_n", F.row_number().over(back)).where("_n <= 3").select(*key, (-F.col("_n")).cast("double").alias("x"), F.col(value).alias("y"))
    c = current.select(*key, d(0).alias("x"), F.col(value).alias("y"), F.lit(1).alias("_cur"))
    g = h.withColumn("_cur", F.lit(0)).unionByName(c).groupBy(*key)
    return g.agg(F.regr_slope("y", "x").alias("_s"), F.sum(1 - F.col("_cur")).alias("_h"), F.sum("_cur").alias("_c")).where("_c > 0").select(*key, F.when(F.col("_h") >= 2, F.coalesce("_s", d(0))).otherwise(d(0)).alias("risk_trajectory_slope"))


def markov_feedback(pairs: DataFrame, states: DataFrame, slopes: DataFrame | None = None) -> DataFrame:
    """Eleven features a pair from its stored state (distribution array, entropy, updates_in_state, absorption_time); defaults without one."""
    x = pairs.select("vuln_id", "asset_id").join(many(states), ["vuln_id", "asset_id"], "left")
    dist = padded(F.coalesce(F.col("distribution"), F.array().cast("array<double>")))
    x = x.withColumn("_d", dist)
    if slopes is not None:
        x = x.join(many(slopes), ["vuln_id", "asset_id"], "left")
    else:
        x = x.withColumn("risk_trajectory_slope", d(0))
    return x.select(
        "vuln_id",
        "asset_id",
        *[F.get("_d", F.lit(i)).alias(f"state_prob_{i}") for i in range(6)],
        F.coalesce("entropy", d(0)).alias("entropy"),
        F.coalesce(F.col("updates_in_state").cast("double"), d(0)).alias("time_in_current_state"),
        F.coalesce("absorption_time", d(-1)).alias("expected_absorption_time"),
        F.when(F.col("distribution").isNull(), d(0)).otherwise(argmax(F.col("_d")).cast("double")).alias("dominant_state"),
        F.coalesce("risk_trajectory_slope", d(0)).alias("risk_trajectory_slope"),
    )


def assemble(pairs: DataFrame, by_pair: list[DataFrame] = (), by_vuln: list[DataFrame] = (), by_asset: list[DataFrame] = (), missing: float = 0.0) -> DataFrame:
    """B1, B2: all families joined to the pairs; each family is computed once at its own grain. Missing values get ``missing``."""
    out = pairs.select("vuln_id", "asset_id")
    for keys, families in ((["vuln_id", "asset_id"], by_pair), (["vuln_id"], by_vuln), (["asset_id"], by_asset)):
        for f in families:
            out = out.join(f if keys == ["asset_id"] else many(f), keys, "left")
    numbers = [c for c, t in out.dtypes if t == "double"]
    return out.fillna(missing, numbers)


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these feature columns in this order, as floats; a missing one is 0."""
    have = set(df.columns)
    keys = [c for c in ("vuln_id", "asset_id") if c in have]
    return df.select(*keys, *[(F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) if n in have else F.lit(0.0).cast("float")).alias(n) for n in names])


def pivoted(maps: DataFrame, key: list[str], features: str, names: list[str] | None = None) -> DataFrame:
    """Ragged maps as columns: the sorted union of the keys, missing 0. Only the distinct key names come to the driver; more than ``MOST_COLUMNS`` are an error."""
    if names is None:
        names = sorted(r[0] for r in maps.select(F.explode(F.map_keys(features))).distinct().limit(MOST_COLUMNS + 1).collect())
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} feature names; name those to keep")
    return maps.select(*key, *[F.coalesce(F.try_element_at(F.col(features), F.lit(n)), d(0)).alias(n) for n in names])


