"""File sources: feeds and inventories as node and edge DataFrames.

Every reader returns ``(nodes, edges)``: nodes (node_id, node_type, attrs map<string,string>), edges (src, dst, relation). Links to
vulnerabilities that are not loaded are cut by ``resolve_links`` once everything is read, so the order of files does not matter. JSON
documents may be the wrapped object or a bare list. Rows without an id are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath
from posixpath import normpath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions.lineage import cut
from riskloom.functions.scalar import split_list
from riskloom.sources import json_ranges

NODE = "node_id string, node_type string, attrs map<string,string>"
EDGE = "src string, dst string, relation string"


def route(path: str) -> str | None:
    """Which source a file name means."""
    name = PurePosixPath(path).name.lower()
    return next((source for part, source in C.ROUTES if part in name), None)


RANGE_BYTES = 2 << 20  # a document of more is cut in byte ranges, whose batches do not grow with it; smaller ones are held whole, as many as the files of one split


def _has_large(fs, folder) -> bool:
    found = fs.listFiles(folder, True)
    while found.hasNext():
        if found.next().getLen() > RANGE_BYTES:
            return True
    return False


def documents(spark: SparkSession, path: str, wrapper: str) -> DataFrame:
    """One VARIANT column ``v`` a record: the elements of ``wrapper`` in each document, or of the document itself if that is a list.

    Files are cut into their records' texts, so that no VARIANT ever holds a whole feed; a record is parsed where it is used. Small files are cut each in one
    task, larger ones in byte ranges by all tasks (``json_ranges``), which never hold a file: its bytes, its text and the other files of its Arrow batch in
    Python are several times its size, in every task at once.
    """
    import pyarrow as pa

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if any(f.getLen() > RANGE_BYTES if f.isFile() else _has_large(fs, f.getPath()) for f in fs.globStatus(p) or []):
        return json_ranges.records(spark, path, wrapper).select(F.parse_json("value").alias("v"))

    def cut_up(batches):
        for batch in batches:
            for content in batch.column(0):
                held: list[str] = []
                for text in record_texts(content.as_py().decode("utf-8-sig"), wrapper):
                    held.append(text)
                    if len(held) == 512:
                        yield pa.RecordBatch.from_pydict({"value": held})
                        held = []
                yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(cut_up, "value string").select(F.parse_json("value").alias("v"))


def record_texts(text: str, wrapper: str) -> Iterator[str]:
    """The JSON texts of a document's records: of its member ``wrapper``, or of the document if that is a list."""
    decoder, space = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
    skip = lambda i: space.match(text, i).end()

    def elements(i: int) -> Iterator[str]:
        i = skip(i + 1)
        while text[i] != "]":
            _, end = decoder.raw_decode(text, i)
            yield text[i:end]
            i = skip(end)
            if text[i] == ",":
                i = skip(i + 1)

    i = skip(0)
    if text[i : i + 1] == "[":
        yield from elements(i)
        return
    if text[i : i + 1] != "{":
        raise ValueError("a feed is a JSON object or list")
    i = skip(i + 1)
    while text[i] != "}":
        key, end = decoder.raw_decode(text, i)
        i = skip(skip(end) + 1)
        if key == wrapper and text[i] == "[":
            yield from elements(i)
            return
        _, end = decoder.raw_decode(text, i)
        i = skip(end)
        if text[i] == ",":
            i = skip(i + 1)


def get(path: str, kind: str = "string", col: str = "v") -> Column:
    return F.try_variant_get(F.col(col), path, kind)


def _attrs(**values: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), x.cast("string").alias("value")) for k, x in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def nodes_of(df: DataFrame, node_id: Column, kind: str, **attrs: Column) -> DataFrame:
    return df.select(node_id.cast("string").alias("node_id"), F.lit(kind).alias("node_type"), _attrs(**attrs).alias("attrs")).where("node_id is not null and node_id <> ''")


def edges_of(df: DataFrame, src: Column, dst: Column, relation: str) -> DataFrame:
    return df.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(relation).alias("relation")).where("src <> '' and dst <> ''").distinct()


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def nvd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1, S1a-d: vulnerabilities with score, description, weaknesses and platforms."""
    d = documents(spark, path, "vulnerabilities").select(F.coalesce(F.try_variant_get("v", "$.cve", "variant"), F.col("v")).alias("v"))
    d = d.withColumn("id", F.coalesce(get("$.id"), get("$.cve_id"))).where("id is not null")
    # score and vector come from one version: the first that is given
    d = d.withColumn("cvss", F.coalesce(*[get(f"$.metrics.cvssMetric{v}[0].cvssData", "variant") for v in ("V31", "V30", "V2")]))
    metric = lambda f, t: get(f"$.{f}", t, "cvss")
    texts = get("$.descriptions", "array<struct<lang:string,value:string>>")
    english = F.get(F.filter(texts, lambda x: F.coalesce(x["lang"], F.lit("en")) == "en"), F.lit(0))["value"]
    weak = F.flatten(F.transform(get("$.weaknesses", "array<struct<description:array<struct<value:string>>>>"), lambda w: F.transform(w["description"], lambda x: x["value"])))
    cwes = F.filter(weak, lambda x: x.startswith("CWE-"))
    nested = get("$.configurations", "array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>")
    cpes = F.filter(F.flatten(F.flatten(F.transform(nested, lambda c: F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"]))))), lambda x: x.isNotNull() & (x != ""))
    d = d.withColumns({"cwes": cwes, "cpes": cpes})
    id_ = F.col("id")
    vuln = nodes_of(
        d, id_, "Vulnerability",
        description=F.substring(F.coalesce(english, F.lit("")), 1, 2000), cvss_base_score=F.coalesce(metric("baseScore", "double"), F.lit(0.0)), cvss_vector=metric("vectorString", "string"),
        published_date=get("$.published"), modified_date=get("$.lastModified"), cwe_ids=F.array_join("cwes", ";"), source=F.lit("nvd"),
    )
    by_cwe, by_cpe = d.select("id", F.explode(F.array_distinct("cwes")).alias("x")), d.select("id", F.explode(F.array_distinct("cpes")).alias("x"))
    nodes = union(vuln, _plain(by_cwe, "CWE"), _plain(by_cpe, "CPE", attr="uri"))
    return nodes, union(edges_of(by_cwe, id_, F.col("x"), "HAS_CWE"), edges_of(by_cpe, id_, F.col("x"), "AFFECTS"))


def _plain(df: DataFrame, kind: str, col: str = "x", attr: str = "name") -> DataFrame:
    """Nodes that are only a name, kept as one attribute too."""
    return df.select(F.col(col).alias("node_id")).distinct().select("node_id", F.lit(kind).alias("node_type"), F.create_map(F.lit(attr), F.col("node_id")).alias("attrs"))


def kev(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue of exploited vulnerabilities, from JSON or CSV (with byte order mark, any of the known column spellings)."""
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        have = {c.lstrip("﻿").strip(): c for c in raw.columns}
        pick = lambda name: next((F.col(f"`{have[s]}`") for s in C.KEV_FIELDS[name] if s in have), F.lit(None).cast("string"))
        d = raw.select(*[F.trim(pick(n)).alias(n) for n in C.KEV_FIELDS])
    else:
        d = documents(spark, path, "vulnerabilities").select(*[F.coalesce(*[get(f"$.{s}") for s in spellings]).alias(n) for n, spellings in C.KEV_FIELDS.items()])
    nodes = nodes_of(
        d, F.col("cveID"), "Vulnerability",
        is_in_kev=F.lit("true"), kev_vendor=F.col("vendorProject"), kev_product=F.col("product"), kev_date_added=F.col("dateAdded"), kev_due_date=F.col("dueDate"), kev_action=F.col("requiredAction"), kev_ransomware=F.col("knownRansomwareCampaignUse"),
    )
    return nodes, spark.createDataFrame([], EDGE)


def exploitdb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S5, S5a."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"').where("trim(id) <> ''").withColumn("node", F.concat(F.lit("EDB-"), F.trim("id")))
    col = lambda n: F.col(n) if n in d.columns else F.lit(None).cast("string")
    nodes = nodes_of(d, F.col("node"), "Indicator", indicator_type=F.lit("exploit"), description=F.substring(col("description"), 1, 1000), date_published=F.coalesce(col("date_published"), col("date")), platform=col("platform"), exploit_type=col("type"), source=F.lit("exploitdb"))
    links = d.select("node", F.explode(split_list(col("codes"), ";", "CVE-")).alias("cve"))
    flags = nodes_of(links, F.col("cve"), "Vulnerability", has_public_exploit=F.lit("true"))
    return union(nodes, flags.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("_only_if_known"), F.lit("1"))))), edges_of(links, F.col("cve"), F.col("node"), "REFERENCES")


def stix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S6, S6a-d: indicators, actors, campaigns, techniques and the relationships between them."""
    d = documents(spark, path, "objects").withColumns({"type": get("$.type"), "id": get("$.id")})
    of = lambda t: d.where(F.col("type") == t)
    refs = get("$.external_references", "array<struct<source_name:string,external_id:string>>")
    mitre = F.get(F.filter(refs, lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    text = F.substring(get("$.description"), 1, 500)
    nodes = union(
        nodes_of(of("indicator"), F.col("id"), "Indicator", indicator_type=F.lit("stix_indicator"), name=get("$.name"), pattern=get("$.pattern"), created=get("$.created"), modified=get("$.modified"), source=F.lit("otx")),
        nodes_of(of("threat-actor"), F.col("id"), "ThreatActor", name=get("$.name"), description=text, source=F.lit("otx")),
        nodes_of(of("campaign"), F.col("id"), "Campaign", name=get("$.name"), description=text, first_seen=get("$.first_seen"), source=F.lit("otx")),
        nodes_of(of("attack-pattern"), F.col("id"), "TTP", name=get("$.name"), mitre_id=mitre, source=F.lit("otx")),
    )
    cves = of("indicator").select("id", F.explode(refs).alias("r")).where(F.col("r.external_id").startswith("CVE-"))
    rel = of("relationship").withColumns({"kind": get("$.relationship_type"), "a": get("$.source_ref"), "b": get("$.target_ref")})
    names = {"uses": "USES_TTP", "targets": "TARGETS", "attributed-to": "ATTRIBUTED_TO", "indicates": "INDICATES"}
    edges = [edges_of(cves, F.col("r.external_id"), F.col("id"), "REFERENCES")] + [edges_of(rel.where(F.col("kind") == k), F.col("a"), F.col("b"), r) for k, r in names.items()]
    return nodes, union(*edges)


def cmdb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The asset inventory from CSV or JSON; lists may be comma-separated text."""
    fields = ("asset_id", "hostname", "ip_address", "os", "criticality", "business_unit", "network_zone", "cpe_list", "software", "connects_to")
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        d = raw.select(*[(F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in fields])
        d = d.withColumn("asset_id", F.col("asset_id") if "asset_id" in raw.columns else F.col("hostname"))
    else:
        as_text = lambda c: F.coalesce(F.array_join(get(f"$.{c}", "array<string>"), ","), get(f"$.{c}"))
        d = documents(spark, path, "assets").select(*[as_text(c).alias(c) for c in fields]).withColumn("asset_id", F.coalesce("asset_id", "hostname"))
    d = d.where("asset_id is not null and asset_id <> ''")
    a = F.col("asset_id")
    nodes = nodes_of(d, a, "Asset", hostname=F.col("hostname"), ip_address=F.col("ip_address"), os=F.col("os"), criticality=F.coalesce("criticality", F.lit("medium")), business_unit=F.col("business_unit"), network_zone=F.col("network_zone"), source=F.lit("cmdb"))
    cpes = d.select("asset_id", F.explode(split_list(F.coalesce("cpe_list", "software"), ",")).alias("x"))
    near = d.select("asset_id", F.explode(split_list(F.col("connects_to"), ",")).alias("x"))
    unit, zone = (d.select("asset_id", F.col(c).alias("x")).where("x <> ''") for c in ("business_unit", "network_zone"))
    return union(nodes, _plain(unit, "BusinessUnit"), _plain(zone, "NetworkZone"), _plain(cpes, "CPE", attr="uri")), union(edges_of(unit, a, F.col("x"), "BELONGS_TO"), edges_of(zone, a, F.col("x"), "IN_ZONE"), edges_of(cpes, a, F.col("x"), "RUNS"), edges_of(near, a, F.col("x"), "CONNECTS_TO"))


def network_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hosts, their services and what they connect to."""
    d = documents(spark, path, "hosts").withColumn("host", F.coalesce(get("$.asset_id"), get("$.hostname"), get("$.ip"))).where("host <> ''")
    nodes = nodes_of(d, F.col("host"), "Asset", ip_address=F.coalesce(get("$.ip"), get("$.ip_address")), os_detected=get("$.os"), last_scan_date=get("$.scan_date"), source=F.lit("network_scan"))
    s = d.select("host", F.explode(get("$.services", "array<struct<port:string,protocol:string,name:string,version:string,cpe:string>>")).alias("s")).select("host", "s.*")
    s = s.withColumns({"protocol": F.coalesce("protocol", F.lit("tcp"))}).withColumn("svc", F.concat("host", F.lit(":"), "port", F.lit("/"), "protocol"))
    near = d.select("host", F.explode(get("$.connected_to", "array<string>")).alias("x"))
    cpes = s.where("cpe <> ''").select("host", F.col("cpe").alias("x"))
    services = nodes_of(s, F.col("svc"), "Service", port=F.col("port"), protocol=F.col("protocol"), name=F.col("name"), version=F.col("version"), cpe=F.col("cpe"))
    return union(nodes, services, _plain(cpes, "CPE", attr="uri")), union(edges_of(s, F.col("host"), F.col("svc"), "HOSTS_SERVICE"), edges_of(cpes, F.col("host"), F.col("x"), "RUNS"), edges_of(near, F.col("host"), F.col("x"), "CONNECTS_TO"))


def vendor_advisories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S9."""
    d = documents(spark, path, "advisories").withColumn("id", F.coalesce(get("$.advisory_id"), get("$.id"))).where("id <> ''")
    patch = F.coalesce(get("$.patch_available", "boolean"), F.lit(False))
    nodes = nodes_of(d, F.col("id"), "Indicator", indicator_type=F.lit("vendor_advisory"), vendor=get("$.vendor"), title=get("$.title"), severity=get("$.severity"), patch_available=patch, source=F.lit("vendor_advisories"))
    links = d.select("id", patch.alias("patch"), F.explode(get("$.cve_ids", "array<string>")).alias("cve"))
    flags = nodes_of(links.where("patch"), F.col("cve"), "Vulnerability", patch_available=F.lit("true"), _only_if_known=F.lit("1"))
    return union(nodes, flags), edges_of(links, F.col("cve"), F.col("id"), "REFERENCES")


def siem_alerts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S10."""
    d = documents(spark, path, "alerts").withColumn("id", F.coalesce(get("$.alert_id"), get("$.id"))).where("id <> ''")
    nodes = nodes_of(d, F.col("id"), "Indicator", indicator_type=F.lit("siem_alert"), rule_name=get("$.rule_name"), severity=get("$.severity"), src_ip=get("$.src_ip"), dst_ip=get("$.dst_ip"), created=get("$.timestamp"), source=F.lit("siem_alerts"))
    return nodes, union(edges_of(d, F.col("id"), get("$.asset_id"), "INDICATES"), edges_of(d, get("$.cve_id"), F.col("id"), "REFERENCES"))


READERS = {"nvd": nvd, "cisa_kev": kev, "exploitdb": exploitdb, "otx": stix, "cmdb": cmdb, "network_scan": network_scan, "vendor_advisories": vendor_advisories, "siem_alerts": siem_alerts}


FILES_A_PLAN = 32
STRICT = ("REFERENCES", "INDICATES", "USES_TTP", "TARGETS", "ATTRIBUTED_TO")


def loaded(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(nodes, edges, errors): the rows of all files with the file's place in the list as ``_seq``, and why files could not be read.

    Many files are one plan and one job each for nodes and edges; where that fails, its halves are read, down to the file at fault.
    """
    failed: dict[str, str] = {}
    nodes, edges = [], []

    def read(part: list[tuple[int, str]]) -> None:
        try:
            frames = [(i, *READERS[route(p)](spark, p)) for i, p in part]
            done = cut(union(*[n.withColumn("_seq", F.lit(i)) for i, n, _ in frames])), cut(union(*[e.withColumn("_seq", F.lit(i)) for i, _, e in frames]))
        except (PySparkException, Py4JJavaError, ValueError) as x:
            if len(part) == 1:
                failed[part[0][1]] = str(x).splitlines()[0]
                return
            read(part[: len(part) // 2])
            read(part[len(part) // 2 :])
            return
        nodes.append(done[0])
        edges.append(done[1])

    numbered = list(enumerate(paths))
    for a in range(0, len(numbered), FILES_A_PLAN):
        read(numbered[a : a + FILES_A_PLAN])
    none = spark.createDataFrame([], f"{NODE}, _seq int"), spark.createDataFrame([], f"{EDGE}, _seq int")
    return union(none[0], *nodes), union(none[1], *edges), failed


def _waits() -> Column:
    """Rows that only add to a node which something else brings."""
    return F.coalesce(F.map_contains_key("attrs", F.lit("_only_if_known")), F.lit(False))


def added(nodes: DataFrame, edges: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """For each file, the nodes and the edges that it brings first (before entity resolution); rows of the stored graph have a ``_seq`` below 0."""
    first = nodes.where(~_waits()).groupBy("node_id").agg(F.min("_seq").alias("_seq"))
    links = edges.groupBy("src", "dst", "relation").agg(F.min("_seq").alias("_seq"))
    return tuple({r[0]: r[1] for r in x.where("_seq >= 0").groupBy("_seq").count().collect()} for x in (first, links))


def graph_of(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, waiting nodes, waiting edges) of rows with ``_seq``: attributes merged by node, the last file's value kept; what waits for a node is handed back as it is."""
    known = nodes.where(~_waits()).select("node_id").distinct()
    each = nodes.select("node_id", "node_type", "_seq", F.explode_outer("attrs").alias("k", "v")).join(known, "node_id", "left_semi")
    attrs = each.where("k is not null and k <> '_only_if_known'").groupBy("node_id", "k").agg(F.max_by("v", "_seq").alias("v")).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))
    merged = cut(each.groupBy("node_id").agg(F.max_by("node_type", "_seq").alias("node_type")).join(attrs, "node_id", "left"))
    waiting = nodes.where(_waits()).join(merged.select("node_id"), "node_id", "left_anti").select("node_id", "node_type", "attrs")
    links = cut(edges.select("src", "dst", "relation").distinct())
    kept = resolve_links(links, merged)
    return merged, kept, waiting, links.where(F.col("relation").isin(*STRICT)).join(kept, ["src", "dst", "relation"], "left_anti")


def import_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph of all files, whatever their order: attributes merged per node, links kept whose vulnerability is known."""
    nodes, edges, failed = loaded(spark, [p for p in sorted(paths) if route(p)])
    if failed:
        raise ValueError("; ".join(f"{p}: {x}" for p, x in failed.items()))
    return graph_of(nodes, edges)[:2]


def resolve_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References keep only ends that exist; other edges may dangle."""
    ids = nodes.select("node_id")
    strict = edges.where(F.col("relation").isin(*STRICT))
    for end in ("src", "dst"):
        strict = strict.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return union(edges.where(~F.col("relation").isin(*STRICT)), strict.select("src", "dst", "relation"))


def import_report(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): the graph of all files, and for each file in order its source, the nodes and edges that it added to
    those before it (before entity resolution), and whether it could be read; a file that cannot be counts as a failure and adds nothing."""
    known = [p for p in sorted(paths) if route(p)]
    rows, links, failed = loaded(spark, known)
    nodes, edges = added(rows, links)
    log = [(p, "unknown", 0, 0, False, f"No reader matched for file: {PurePosixPath(p).name}") for p in paths if not route(p)]
    log += [(p, route(p), 0, 0, False, failed[p]) if p in failed else (p, route(p), nodes.get(i, 0), edges.get(i, 0), True, None) for i, p in enumerate(known)]
    graph = graph_of(rows, links)
    return graph[0], graph[1], spark.createDataFrame(sorted(log), "file string, source string, nodes_added long, edges_added long, success boolean, error string")


def importable(spark: SparkSession, folder: str) -> list[str]:
    """The files right in a folder for which there is a reader, sorted."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(str(x.getPath().toString()) for x in found if x.isFile() and route(x.getPath().getName()))


def within(path: str, folder: str) -> bool:
    """Does a path, its dots resolved, lie in a folder?"""
    inside, outer = (PurePosixPath(normpath(x)) for x in (path, folder))
    return inside.is_relative_to(outer)


def trigger_import(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """S12 behind P4: the report of one file, refused outside the folder for imports."""
    if not within(path, folder):
        return spark.createDataFrame([(path, "unknown", 0, 0, False, "Path must be within the configured imports directory")], "file string, source string, nodes_added long, edges_added long, success boolean, error string")
    return import_report(spark, [path])[2]


GRAPHML_KEY = {"node": ("node_type", "attrs"), "edge": ("relation",)}


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved GraphML graph by the XML source, its keys resolved: nodes (node_id, node_type, attrs), edges (src, dst, relation)."""
    data = "struct<_key:string,_VALUE:string>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = F.broadcast(read("key", "_id string, `_attr.name` string, _for string").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name")).distinct())
    n = read("node", f"_id string, data array<{data}>").select(F.col("_id").alias("node_id"), F.explode_outer("data").alias("d"))
    n = n.select("node_id", F.col("d._key").alias("key"), F.col("d._VALUE").alias("value")).join(keys, "key", "left")
    pairs = F.collect_list(F.when(F.col("name").isNotNull() & (F.col("name") != "node_type"), F.struct("name", "value")))
    nodes = n.groupBy("node_id").agg(F.max(F.when(F.col("name") == "node_type", F.col("value"))).alias("node_type"), F.map_from_entries(pairs).alias("attrs"))
    e = read("edge", f"_source string, _target string, data array<{data}>").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.explode_outer("data").alias("d"))
    e = e.select("src", "dst", F.col("d._key").alias("key"), F.col("d._VALUE").alias("value")).join(keys, "key", "left")
    edges = e.groupBy("src", "dst").agg(F.max(F.when(F.col("name") == "relation", F.col("value"))).alias("relation"))
    return nodes, edges


def config_table(spark: SparkSession, path: str, section: str) -> DataFrame:
    """A section of a YAML configuration file as a lookup table (key, value as JSON); empty if file or section is missing."""
    import yaml

    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a configuration file is small
        config = yaml.safe_load(text) or {}
    except (PySparkException, Py4JJavaError):
        config = {}
    return spark.createDataFrame([(str(k), json.dumps(v)) for k, v in (config.get(section) or {}).items()], "key string, value string")


def backtest_file(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Predictions or what happened, a JSON document that is a list of records."""
    return spark.read.schema(fields).json(path, multiLine=True)


def training_scan(spark: SparkSession, nvd_path: str, kev_path: str) -> DataFrame:
    """Five features and two labels for each vulnerability of the feeds: is it in the catalogue of exploited ones, and its impact."""
    d = documents(spark, nvd_path, "vulnerabilities").select(F.coalesce(F.try_variant_get("v", "$.cve", "variant"), F.col("v")).alias("v"))
    d = d.withColumn("m", F.coalesce(get("$.metrics.cvssMetricV31[0]", "variant"), get("$.metrics.cvssMetricV30[0]", "variant")))
    number = lambda f: F.coalesce(get(f"$.cvssData.{f}", "double", "m"), get(f"$.{f}", "double", "m"), F.lit(0.0))
    size = lambda f: F.coalesce(F.size(get(f"$.{f}", "array<variant>")), F.lit(0)).cast("double")
    known = documents(spark, kev_path, "vulnerabilities").select(get("$.cveID").alias("cve_id")).where("cve_id is not null").distinct().withColumn("_kev", F.lit(1.0))
    x = d.select(get("$.id").alias("cve_id"), number("baseScore").alias("cvss_base_score"), number("exploitabilityScore").alias("exploitability"), number("impactScore").alias("impact"), size("references").alias("ref_count"), size("configurations").alias("config_count"))
    return x.join(known, "cve_id", "left").withColumns({"y_elp": F.coalesce("_kev", F.lit(0.0)), "y_isa": F.col("impact")}).drop("_kev")
