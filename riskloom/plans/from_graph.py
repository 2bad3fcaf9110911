"""A stored graph as what the batch works on: nodes and edges to vulnerabilities, assets, pairs, links and intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import d, days_between, parse_ts, split_list
from riskloom.operators import graph
from riskloom.plans.batch import Estate


def estate_of(nodes: DataFrame, edges: DataFrame, ref: Column) -> Estate:
    """nodes: node_id, node_type, attrs map<string,string>; edges: src, dst, relation. Attributes that a node lacks are null.

    A pair is a vulnerability present on an asset, or one that affects a platform which the asset runs, whatever the platform's spelling.
    """
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    number = lambda name: attr(name).try_cast("double")
    flag = lambda name: F.coalesce(F.lower(attr(name)) == "true", F.lit(False))
    time = lambda *names: F.coalesce(*[parse_ts(attr(n)) for n in names]).cast("timestamp_ntz")
    of = lambda kind: nodes.where(F.col("node_type") == kind)
    links = lambda relation: edges.where(F.col("relation") == relation)

    vulns = of("Vulnerability").select(
        F.col("node_id").alias("vuln_id"), number("cvss_base_score").alias("cvss"), F.coalesce(split_list(attr("cwe_ids"), ";"), F.array().cast("array<string>")).alias("cwe_ids"),
        F.coalesce(attr("vendor"), attr("kev_vendor")).alias("vendor"), attr("description").alias("description"), flag("is_in_kev").alias("is_in_kev"), flag("has_public_exploit").alias("has_public_exploit"),
        time("published_date").alias("published_ts"), time("patch_date").alias("patch_ts"), attr("exploit_maturity").alias("exploit_maturity"), number("cvss_exploitability").alias("cvss_exploitability"), number("cvss_impact").alias("cvss_impact"),
        F.coalesce(number("exploit_velocity_days").cast("int"), F.lit(-1)).alias("exploit_velocity_days"),
    )
    vulns = vulns.withColumn("patch_lag_days", F.coalesce(days_between(F.col("published_ts"), F.col("patch_ts")), d(-1)))
    assets = of("Asset").select(
        F.col("node_id").alias("asset_id"), attr("hostname").alias("hostname"), F.coalesce(attr("criticality"), F.lit("medium")).alias("criticality"), attr("network_zone").alias("zone"), attr("business_unit").alias("bu"),
        F.lit(None).cast("string").alias("parent_bu"), time("last_scan_date").alias("last_scan_ts"),
    )
    from riskloom.functions.scalar import cpe_canonical

    affects = links("AFFECTS").select(F.col("src").alias("vuln_id"), cpe_canonical(F.col("dst")).alias("cpe"))
    runs = links("RUNS").select(F.col("src").alias("asset_id"), cpe_canonical(F.col("dst")).alias("cpe"))
    present = links("PRESENT_ON").select(F.col("src").alias("vuln_id"), F.col("dst").alias("asset_id"))
    pairs = graph.link_by_cpe(affects, runs).unionByName(present).distinct().join(vulns.select("vuln_id"), "vuln_id", "left_semi").join(assets.select("asset_id"), "asset_id", "left_semi").select("vuln_id", "asset_id")
    intel = nodes.select("node_id", "node_type", time("modified", "modified_date", "created", "date_published").alias("modified_ts"))
    exploits = links("REFERENCES").select(F.col("src").alias("vuln_id"), F.col("dst").alias("node_id")).join(nodes.where(attr("indicator_type") == "exploit").select("node_id", time("date_published").alias("published_ts")), "node_id").select("vuln_id", "published_ts")
    starts = edges.join(of("Indicator").select(F.col("node_id").alias("src")), "src", "left_semi").join(vulns.select(F.col("vuln_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("vuln_id"), F.col("src").alias("node"))
    return Estate(vulns, assets, pairs, links("CONNECTS_TO").select("src", "dst"), exploits, edges.select("src", "dst"), intel, ref, starts, edges.select("src", "dst"), F.col("vuln_id"))
