"""Queries of the sources and sinks (S*, K1, K2, K10, K11, G2): feeds written from the driver's tables and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.lineage import new_folder
from riskloom.operators import store
from riskloom.plans import projection as P
from riskloom.plans.registry import query
from riskloom.sources import readers as R
from riskloom.sources import sinks as W


def _cve(x):
    return F.concat(F.lit("CVE-"), x)


def _feed(spark, rows, wrapper: str, name: str) -> str:
    path = f"{new_folder(spark, 'feed')}/{name}"
    W.json_documents(rows, wrapper, path)
    return path


def _attrs(df, *names):
    return df.select("node_id", "node_type", *[F.try_element_at("attrs", F.lit(n)).alias(n) for n in names])


# ---------------------------------------------------------------- S1: vulnerabilities


def _nvd_feed(spark, sf) -> str:
    k, size = F.col("p_partkey"), F.col("p_size")
    scored = lambda when, add: F.when(when, F.array(F.struct(F.struct(((size + add) / 10).alias("baseScore"), F.concat(F.lit("V"), k).alias("vectorString")).alias("cvssData"), (size / 20).alias("impactScore"))))
    cve = F.struct(
        _cve(k).alias("id"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("published"),
        F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions"),
        F.struct(scored(k % 3 == 0, 0).alias("cvssMetricV31"), scored(k % 2 == 0, 1).alias("cvssMetricV30"), scored(k % 5 == 0, 2).alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), size % 7).alias("value")), F.struct(F.lit("NVD-CWE-noinfo").alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.concat(F.lit("cpe:2.3:a:"), F.col("p_brand"), F.lit(":x:1")).alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
        F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.struct(F.concat(F.lit("http://r/"), i).alias("url"))).alias("references"),
    )
    return _feed(spark, P.table(spark, sf, "part").select(cve.alias("cve")), "vulnerabilities", "nvd_cves.json")


_SCORE = "CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE WHEN p_partkey % 2 = 0 THEN (p_size + 1) / 10.0::DOUBLE WHEN p_partkey % 5 = 0 THEN (p_size + 2) / 10.0::DOUBLE END"


@query(
    f"""SELECT 'CVE-' || p_partkey AS node_id, 'Vulnerability' AS node_type, p_name AS description, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS published_date, 'CWE-' || p_size % 7 AS cwe_ids,
 CASE WHEN ({_SCORE}) IS NOT NULL THEN 'V' || p_partkey END AS cvss_vector, coalesce({_SCORE}, 0.0::DOUBLE) AS cvss FROM part"""
)
def source_nvd(spark, sf):
    n, _ = R.nvd(spark, _nvd_feed(spark, sf))
    n = _attrs(n.where("node_type = 'Vulnerability'"), "description", "published_date", "cwe_ids", "cvss_vector", "cvss_base_score")
    return n.withColumn("cvss", F.col("cvss_base_score").cast("double")).drop("cvss_base_score")


@query("SELECT DISTINCT 'CVE-' || p_partkey AS src, 'CWE-' || p_size % 7 AS dst, 'HAS_CWE' AS relation FROM part UNION SELECT 'CVE-' || p_partkey, 'cpe:2.3:a:' || p_brand || ':x:1', 'AFFECTS' FROM part")
def source_nvd_edges(spark, sf):
    return R.nvd(spark, _nvd_feed(spark, sf))[1]


# ---------------------------------------------------------------- S2-S4: the catalogue of exploited vulnerabilities

_KEV_SQL = "SELECT 'CVE-' || p_partkey AS node_id, 'Vulnerability' AS node_type, 'true' AS is_in_kev, p_brand AS kev_vendor, p_name AS kev_product, '2024-02-0' || p_partkey % 9 AS kev_date_added FROM part WHERE p_partkey % 17 = 0"


def _kev_rows(spark, sf, *names: str):
    k = F.col("p_partkey")
    cols = [_cve(k), F.col("p_brand"), F.col("p_name"), F.concat(F.lit("2024-02-0"), k % 9)]
    return P.table(spark, sf, "part").where(k % 17 == 0).select(*[c.alias(n) for c, n in zip(cols, names)])


@query(_KEV_SQL)
def source_kev_json(spark, sf):
    path = _feed(spark, _kev_rows(spark, sf, "cveID", "vendorProject", "product", "dateAdded"), "vulnerabilities", "kev.json")
    return _attrs(R.kev(spark, path)[0], "is_in_kev", "kev_vendor", "kev_product", "kev_date_added")


@query(_KEV_SQL)
def source_kev_csv(spark, sf):
    """The other known spellings, as CSV."""
    path = f"{new_folder(spark, 'feed')}/kev.csv"
    _kev_rows(spark, sf, "cve_id", "vendor_project", "product", "date_added").write.csv(path, header=True)
    return _attrs(R.kev(spark, path)[0], "is_in_kev", "kev_vendor", "kev_product", "kev_date_added")


# ---------------------------------------------------------------- S5: exploits


def _exploit_csv(spark, sf) -> str:
    path = f"{new_folder(spark, 'feed')}/exploitdb.csv"
    o, k = P.table(spark, sf, "orders"), F.col("o_orderkey")
    o.select(k.alias("id"), F.concat(F.col("o_clerk"), F.lit(', "quoted"')).alias("description") if "o_clerk" in o.columns else F.concat(F.col("o_orderpriority"), F.lit(', "quoted"')).alias("description"), F.col("o_orderdate").cast("date").cast("string").alias("date_published"), F.col("o_orderstatus").alias("type"), F.concat(_cve(k % 50), F.lit("; OSVDB-1;"), _cve(k % 7 + 1)).alias("codes")).write.csv(path, header=True, escape='"')
    return path


@query("SELECT DISTINCT 'CVE-' || unnest([o_orderkey % 50, o_orderkey % 7 + 1]) AS src, 'EDB-' || o_orderkey AS dst, 'REFERENCES' AS relation FROM orders")
def source_exploitdb_edges(spark, sf):
    return R.exploitdb(spark, _exploit_csv(spark, sf))[1]


@query("SELECT 'EDB-' || o_orderkey AS node_id, 'Indicator' AS node_type, strftime(o_orderdate, '%Y-%m-%d') AS date_published, o_orderstatus AS exploit_type FROM orders")
def source_exploitdb(spark, sf):
    n, _ = R.exploitdb(spark, _exploit_csv(spark, sf))
    return _attrs(n.where("node_type = 'Indicator'"), "date_published", "exploit_type")


# ---------------------------------------------------------------- S6: STIX bundles

_KIND = "['indicator', 'threat-actor', 'campaign', 'attack-pattern', 'relationship', 'report'][event_id % 6 + 1]"
_REL = "['uses', 'targets', 'attributed-to', 'indicates', 'other'][event_id % 5 + 1]"


def _stix_feed(spark, sf) -> str:
    e = F.col("event_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (e % n + 1).cast("int"))
    kind = pick(("indicator", "threat-actor", "campaign", "attack-pattern", "relationship", "report"), 6)
    refs = F.when(e % 6 == 0, F.array(F.struct(F.lit("cve").alias("source_name"), _cve(e % 40).alias("external_id")))).when(e % 6 == 3, F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), e % 90).alias("external_id"))))
    rel = e % 6 == 4
    rows = P.table(spark, sf, "events").select(
        kind.alias("type"), F.concat(F.lit("x--"), e).alias("id"), F.col("event_type").alias("name"), refs.alias("external_references"),
        F.when(rel, pick(("uses", "targets", "attributed-to", "indicates", "other"), 5)).alias("relationship_type"), F.when(rel, F.concat(F.lit("x--"), e - 3)).alias("source_ref"), F.when(rel, F.concat(F.lit("x--"), e - 1)).alias("target_ref"),
    )
    return _feed(spark, rows, "objects", "otx.json")


@query(
    f"""SELECT 'x--' || event_id AS node_id, CASE event_id % 6 WHEN 0 THEN 'Indicator' WHEN 1 THEN 'ThreatActor' WHEN 2 THEN 'Campaign' ELSE 'TTP' END AS node_type, event_type AS name,
 CASE WHEN event_id % 6 = 3 THEN 'T' || event_id % 90 END AS mitre_id FROM events WHERE event_id % 6 < 4"""
)
def source_stix(spark, sf):
    return _attrs(R.stix(spark, _stix_feed(spark, sf))[0], "name", "mitre_id")


@query(
    f"""SELECT DISTINCT 'CVE-' || event_id % 40 AS src, 'x--' || event_id AS dst, 'REFERENCES' AS relation FROM events WHERE event_id % 6 = 0
 UNION SELECT 'x--' || (event_id - 3), 'x--' || (event_id - 1), CASE {_REL} WHEN 'uses' THEN 'USES_TTP' WHEN 'targets' THEN 'TARGETS' WHEN 'attributed-to' THEN 'ATTRIBUTED_TO' ELSE 'INDICATES' END FROM events WHERE event_id % 6 = 4 AND {_REL} <> 'other'"""
)
def source_stix_edges(spark, sf):
    return R.stix(spark, _stix_feed(spark, sf))[1]


# ---------------------------------------------------------------- S7: asset inventory


def _inventory(spark, sf):
    k = F.col("s_suppkey")
    return P.table(spark, sf, "supplier").select(
        F.concat(F.lit("h"), k).alias("asset_id"), F.col("s_name").alias("hostname"), F.when(k % 4 > 0, F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high")]), (k % 3 + 1).cast("int"))).alias("criticality"),
        F.concat(F.lit("unit"), k % 5).alias("business_unit"), F.concat(F.lit("zone"), k % 3).alias("network_zone"), F.concat(F.lit("cpe:2.3:a:b"), k % 25, F.lit(":x:1, ")).alias("cpe_list"), F.concat(F.lit("h"), k + 1, F.lit(",h"), k + 2).alias("connects_to"),
    )


_ASSETS_SQL = "SELECT 'h' || s_suppkey AS node_id, 'Asset' AS node_type, s_name AS hostname, CASE WHEN s_suppkey % 4 > 0 THEN ['low', 'medium', 'high'][s_suppkey % 3 + 1] ELSE 'medium' END AS criticality, 'unit' || s_suppkey % 5 AS business_unit FROM supplier"


@query(_ASSETS_SQL)
def source_cmdb_csv(spark, sf):
    path = f"{new_folder(spark, 'feed')}/cmdb.csv"
    _inventory(spark, sf).write.csv(path, header=True)
    return _attrs(R.cmdb(spark, path)[0].where("node_type = 'Asset'"), "hostname", "criticality", "business_unit")


@query(_ASSETS_SQL)
def source_cmdb_json(spark, sf):
    path = _feed(spark, _inventory(spark, sf), "assets", "cmdb.json")
    return _attrs(R.cmdb(spark, path)[0].where("node_type = 'Asset'"), "hostname", "criticality", "business_unit")


@query("SELECT DISTINCT * FROM (SELECT 'h' || s_suppkey AS src, unnest(['unit' || s_suppkey % 5, 'zone' || s_suppkey % 3, 'cpe:2.3:a:b' || s_suppkey % 25 || ':x:1', 'h' || (s_suppkey + 1), 'h' || (s_suppkey + 2)]) AS dst, unnest(['BELONGS_TO', 'IN_ZONE', 'RUNS', 'CONNECTS_TO', 'CONNECTS_TO']) AS relation FROM supplier)")
def source_cmdb_edges(spark, sf):
    path = _feed(spark, _inventory(spark, sf).withColumns({"cpe_list": F.split(F.regexp_replace("cpe_list", ", $", ""), ","), "connects_to": F.split("connects_to", ",")}), "assets", "cmdb.json")
    return R.cmdb(spark, path)[1]


# ---------------------------------------------------------------- S8-S10: scans, advisories, alerts


def _scan_feed(spark, sf) -> str:
    k = F.col("c_custkey")
    service = F.struct((k % 1000 + 1).alias("port"), F.when(k % 2 == 0, "udp").alias("protocol"), F.lit("svc").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("cpe:2.3:a:b"), k % 25, F.lit(":x:1"))).alias("cpe"))
    rows = P.table(spark, sf, "customer").select(F.concat(F.lit("h"), k).alias("hostname"), F.concat(F.lit("10.0.0."), k % 256).alias("ip"), F.array(service).alias("services"), F.array(F.concat(F.lit("h"), k + 1)).alias("connected_to"))
    return _feed(spark, rows, "hosts", "network_scan.json")


@query(
    """SELECT 'h' || c_custkey AS node_id, 'Asset' AS node_type, '10.0.0.' || c_custkey % 256 AS ip_address, NULL AS port FROM customer
 UNION ALL SELECT 'h' || c_custkey || ':' || (c_custkey % 1000 + 1) || '/' || CASE WHEN c_custkey % 2 = 0 THEN 'udp' ELSE 'tcp' END, 'Service', NULL, CAST(c_custkey % 1000 + 1 AS VARCHAR) FROM customer
 UNION ALL SELECT DISTINCT 'cpe:2.3:a:b' || c_custkey % 25 || ':x:1', 'CPE', NULL, NULL FROM customer WHERE c_custkey % 3 = 0"""
)
def source_network_scan(spark, sf):
    return _attrs(R.network_scan(spark, _scan_feed(spark, sf))[0], "ip_address", "port")


def _advisory_feed(spark, sf) -> str:
    k = F.col("o_orderkey")
    rows = P.table(spark, sf, "orders").select(F.concat(F.lit("ad"), k).alias("advisory_id"), F.col("o_orderpriority").alias("severity"), F.array(_cve(k % 60), _cve(k % 11)).alias("cve_ids"), F.when(k % 3 > 0, k % 3 == 1).alias("patch_available"))
    return _feed(spark, rows, "advisories", "vendor_advisory.json")


@query("SELECT 'ad' || o_orderkey AS node_id, 'Indicator' AS node_type, o_orderpriority AS severity, CASE WHEN o_orderkey % 3 = 1 THEN 'true' ELSE 'false' END AS patch_available FROM orders")
def source_vendor_advisory(spark, sf):
    n, _ = R.vendor_advisories(spark, _advisory_feed(spark, sf))
    return _attrs(n.where("node_type = 'Indicator'"), "severity", "patch_available")


@query("SELECT DISTINCT 'CVE-' || unnest([o_orderkey % 60, o_orderkey % 11]) AS src, 'ad' || o_orderkey AS dst, 'REFERENCES' AS relation FROM orders")
def source_vendor_advisory_edges(spark, sf):
    return R.vendor_advisories(spark, _advisory_feed(spark, sf))[1]


@query(
    """SELECT DISTINCT 'al' || event_id AS src, 'h' || user_id % 90 AS dst, 'INDICATES' AS relation FROM events
 UNION SELECT 'CVE-' || event_id % 70, 'al' || event_id, 'REFERENCES' FROM events WHERE event_id % 4 > 0"""
)
def source_siem_edges(spark, sf):
    e = F.col("event_id")
    rows = P.table(spark, sf, "events").select(F.concat(F.lit("al"), e).alias("alert_id"), F.col("event_type").alias("rule_name"), F.concat(F.lit("h"), F.col("user_id") % 90).alias("asset_id"), F.when(e % 4 > 0, _cve(e % 70)).alias("cve_id"))
    return R.siem_alerts(spark, _feed(spark, rows, "alerts", "siem.json"))[1]


# ---------------------------------------------------------------- S12-S18, S20


@query(
    """SELECT 'cmdb' AS source, (SELECT count(*) FROM supplier) + 5 + 3 + (SELECT count(DISTINCT s_suppkey % 25) FROM supplier) AS nodes_added, (SELECT count(*) * 5 FROM supplier) AS edges_added, true AS success
 UNION ALL SELECT 'nvd', (SELECT count(*) + count(DISTINCT p_size % 7) + count(DISTINCT p_brand) FROM part), (SELECT count(*) * 2 FROM part), true
 UNION ALL SELECT 'unknown', 0, 0, false"""
)
def import_directory(spark, sf):
    nvd = _nvd_feed(spark, sf)
    csv = f"{new_folder(spark, 'feed')}/cmdb.csv"
    _inventory(spark, sf).write.csv(csv, header=True)
    _, _, report = R.import_report(spark, [nvd, csv, "/nowhere/readme.txt"])
    return report.select("source", "nodes_added", "edges_added", "success")


def _graph(spark, sf):
    n = P.table(spark, sf, "supplier").select(F.concat(F.lit("h"), "s_suppkey").alias("node_id"), F.lit("Asset").alias("node_type"), F.create_map(F.lit("hostname"), F.concat("s_name", F.lit(' <&"')), F.lit("balance"), F.col("s_acctbal").cast("int").cast("string")).alias("attrs"))
    e = P.connects(spark, sf).select(F.concat(F.lit("h"), "src").alias("src"), F.concat(F.lit("h"), "dst").alias("dst"), F.lit("CONNECTS_TO").alias("relation"))
    return n, e


@query("SELECT 'h' || s_suppkey AS node_id, 'Asset' AS node_type, s_name || ' <&\"' AS hostname, CAST(CAST(trunc(s_acctbal) AS INT) AS VARCHAR) AS balance FROM supplier")
def graphml_round_trip(spark, sf):
    path = new_folder(spark, "graphml")
    W.save_graphml(*_graph(spark, sf), path)
    return _attrs(R.graphml(spark, path)[0], "hostname", "balance")


@query(f"WITH {P.CONNECT} SELECT 'h' || src AS src, 'h' || dst AS dst, 'CONNECTS_TO' AS relation FROM connect")
def graphml_edges(spark, sf):
    path = new_folder(spark, "graphml")
    W.save_graphml(*_graph(spark, sf), path)
    return R.graphml(spark, path)[1]


@query(f"WITH {P.CONNECT} SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM connect) AS edges")
def graph_save_load(spark, sf):
    path = new_folder(spark, "graph")
    W.save_graph(*_graph(spark, sf), path)
    n, e = W.load_graph(spark, path)
    return n.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '[1,2]' WHEN event_id % 4 = 1 THEN '{\"a\":' || user_id || '}' WHEN event_id % 4 = 2 THEN event_type ELSE '' END AS value FROM events")
def sanitised_attributes(spark, sf):
    e = F.col("event_id") % 4
    raw = F.when(e == 0, F.lit("[1,2]")).when(e == 1, F.concat(F.lit('{"a":'), "user_id", F.lit("}"))).when(e == 2, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.lit("null"))
    return P.table(spark, sf, "events").select("event_id", W.sanitised(F.parse_json(raw)).alias("value"))


@query("SELECT 'f' || event_id % 500 AS batch_id, arg_max(event_type, event_id) AS source, arg_max(CAST(user_id AS BIGINT), event_id) AS records FROM events GROUP BY 1")
def import_log_upsert(spark, sf):
    rows = P.table(spark, sf, "events").select(F.concat(F.lit("f"), F.col("event_id") % 500).alias("batch_id"), F.col("event_type").alias("source"), F.col("user_id").cast("long").alias("records"), "event_id")
    half = rows.where("event_id % 3 > 0")
    first = store.latest(half, ["batch_id"], ["event_id"])
    rest = store.latest(rows, ["batch_id"], ["event_id"])
    return store.upsert_log(first, rest).drop("event_id")


@query("SELECT r_name AS key, '{\"id\": ' || r_regionkey || '}' AS value FROM region")
def config_lookup(spark, sf):
    path = f"{new_folder(spark, 'config')}/weights.yaml"
    rows = P.table(spark, sf, "region").select(F.concat(F.lit("  "), "r_name", F.lit(": {id: "), "r_regionkey", F.lit("}")).alias("value"))
    lines = rows.agg(F.concat(F.lit("regions:\n"), F.array_join(F.array_sort(F.collect_list("value")), "\n")).alias("value"))
    lines.write.text(path)
    return R.config_table(spark, path, "regions")


@query("SELECT c_custkey AS pair, abs(c_acctbal) / 10000 AS predicted FROM customer WHERE c_custkey % 2 = 0")
def backtest_documents(spark, sf):
    path = new_folder(spark, "reports")
    rows = P.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pair"), (F.abs("c_acctbal") / 10000).alias("predicted"))
    docs = rows.groupBy(F.pmod(F.xxhash64("pair"), F.lit(4)).alias("n")).agg(F.to_json(F.collect_list(F.struct("pair", "predicted"))).alias("value"))
    docs.write.partitionBy("n").text(path)
    return R.backtest_file(spark, path, "pair long, predicted double").select("pair", "predicted")


@query(
    """SELECT 'CVE-' || p_partkey AS cve_id, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE WHEN p_partkey % 2 = 0 THEN (p_size + 1) / 10.0::DOUBLE ELSE 0 END AS cvss_base_score, 0.0::DOUBLE AS exploitability,
 CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN p_size / 20.0::DOUBLE ELSE 0 END AS impact, (p_partkey % 4 + 1)::DOUBLE AS ref_count, 1.0::DOUBLE AS config_count, CASE WHEN p_partkey % 17 = 0 THEN 1.0::DOUBLE ELSE 0 END AS y_elp,
 CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN p_size / 20.0::DOUBLE ELSE 0 END AS y_isa FROM part"""
)
def training_scan(spark, sf):
    kev = _feed(spark, _kev_rows(spark, sf, "cveID", "vendorProject", "product", "dateAdded"), "vulnerabilities", "kev.json")
    return R.training_scan(spark, _nvd_feed(spark, sf), kev)


@query("SELECT 'data' AS name, 5 AS files, true AS sound")
def transfer_package(spark, sf):
    feed = new_folder(spark, "feed")
    P.table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct("*")).alias("value")).write.partitionBy("r_regionkey").text(feed)
    path = new_folder(spark, "package")
    W.transfer_package(spark, {"data": feed}, path, "2024-01-01")
    # what the package's manifest and checksums say, against its files
    files = spark.read.parquet(f"{path}/files").select("name", (F.sha2("content", 256) == F.col("sha256")).alias("same"), F.concat("sha256", F.lit("  "), "name", F.lit("/"), "file").alias("line"))
    lines = spark.read.text(f"{path}/checksums").select(F.col("value").alias("line"), F.lit(True).alias("listed"))
    good = files.join(lines, "line", "left").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and(F.col("same") & F.coalesce("listed", F.lit(False))).alias("sound"))
    manifest = spark.read.json(f"{path}/manifest").select("name", F.size("files").alias("files"))
    return good.join(manifest, "name").select("name", "files", (F.col("sound") & (F.col("n") == F.col("files"))).alias("sound"))
