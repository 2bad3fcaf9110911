"""Queries of graph storage, resolution and topology (G*, J1, J2, J18, T*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions.scalar import q6
from riskloom.operators import graph as G
from riskloom.operators import store
from riskloom.plans import projection as P
from riskloom.plans.projection import q6_sql
from riskloom.plans.q_scalar import CPE_SQL, cpe_column
from riskloom.plans.registry import query


@query(
    """WITH r AS (SELECT o_custkey AS node_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority END AS b FROM orders)
 SELECT node_id, arg_max(a, CASE WHEN a IS NOT NULL THEN seq END) AS a, arg_max(b, CASE WHEN b IS NOT NULL THEN seq END) AS b FROM r GROUP BY node_id"""
)
def node_upsert_merge(spark, sf):
    o, k = P.table(spark, sf, "orders"), F.col("o_orderkey")
    r = o.select(F.col("o_custkey").alias("node_id"), k.alias("seq"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("a"), F.when(k % 4 == 1, F.col("o_orderpriority")).alias("b"))
    return G.upsert_nodes(r, "seq")


_EDGES = "edges AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, o_orderstatus AS relation, o_orderkey AS seq FROM orders)"


def _edges(spark, sf):
    return P.table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst"), F.col("o_orderstatus").alias("relation"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {_EDGES} SELECT src, dst, arg_max(relation, seq) AS relation FROM edges GROUP BY src, dst")
def edge_single(spark, sf):
    return G.dedupe_edges(_edges(spark, sf), "seq", single=True)


@query(f"WITH {_EDGES} SELECT DISTINCT src, dst, relation FROM edges")
def edge_dedupe(spark, sf):
    return G.dedupe_edges(_edges(spark, sf), "seq")


@query(f"WITH {_EDGES} SELECT DISTINCT src AS node, dst AS neighbour FROM edges WHERE relation = 'F'")
def neighbors(spark, sf):
    return G.neighbours(_edges(spark, sf), "F")


@query(f"WITH {_EDGES} SELECT DISTINCT dst AS node, src AS neighbour FROM edges")
def predecessors(spark, sf):
    return G.neighbours(_edges(spark, sf), reverse=True)


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM customer) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def stats(spark, sf):
    return G.stats(P.table(spark, sf, "customer"), _edges(spark, sf))


@query("SELECT s_suppkey AS asset_id, s_name AS hostname FROM supplier WHERE s_suppkey % 2 = 0")
def nodes_by_type(spark, sf):
    s = P.table(spark, sf, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("hostname"), F.when(F.col("s_suppkey") % 2 == 0, "Asset").otherwise("Service").alias("node_type"))
    return nodes.where(F.col("node_type") == "Asset").drop("node_type")


_AFF = "aff AS (SELECT DISTINCT p_partkey AS vuln_id, p_brand AS cpe FROM part), runs AS (SELECT DISTINCT s_suppkey AS asset_id, 'Brand#' || (s_suppkey * 3 % 25) AS cpe FROM supplier)"


@query(f"WITH {_AFF} SELECT DISTINCT vuln_id, asset_id FROM aff JOIN runs USING (cpe) EXCEPT SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def vuln_asset_link(spark, sf):
    aff = P.table(spark, sf, "part").select(F.col("p_partkey").alias("vuln_id"), F.col("p_brand").alias("cpe"))
    runs = P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") * 3 % 25).alias("cpe"))
    known = P.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vuln_id"), F.col("l_suppkey").alias("asset_id"))
    return G.link_by_cpe(aff, runs, known)


@query(f"WITH {CPE_SQL}, f AS (SELECT canonical, arg_min(cpe, p_partkey) AS kept FROM canon GROUP BY canonical) SELECT DISTINCT cpe, kept FROM canon JOIN f USING (canonical)")
def cpe_merge(spark, sf):
    return G.merge_cpes(P.table(spark, sf, "part").select(cpe_column().alias("cpe"), F.col("p_partkey").alias("seq")), "seq")


_TYPED = """n AS (SELECT s_suppkey AS node_id, ['Vulnerability', 'Asset', 'CPE', 'Indicator'][s_suppkey % 4 + 1] AS node_type FROM supplier),
 e AS (SELECT src, dst, ['AFFECTS', 'PRESENT_ON', 'RUNS', 'CONNECTS_TO', 'REFERENCES'][(src + dst) % 5 + 1] AS relation FROM connect)"""


@query(f"""WITH {P.CONNECT}, {_TYPED}, ok(s, r, t) AS (VALUES {", ".join(str(x) for x in C.ONTOLOGY)}) SELECT src, dst, relation FROM e JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst WHERE NOT EXISTS (SELECT 1 FROM ok WHERE s = a.node_type AND r = relation AND t = b.node_type)""")
def ontology_violations(spark, sf):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    nodes = P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), pick(("Vulnerability", "Asset", "CPE", "Indicator"), F.col("s_suppkey") % 4).alias("node_type"))
    edges = P.connects(spark, sf).withColumn("relation", pick(("AFFECTS", "PRESENT_ON", "RUNS", "CONNECTS_TO", "REFERENCES"), (F.col("src") + F.col("dst")) % 5))
    return G.ontology_violations(edges, nodes, G.allowed_edges(spark)).select("src", "dst", "relation")


@query("SELECT o_custkey AS node_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def node_versions(spark, sf):
    v = G.versions(P.table(spark, sf, "orders").select(F.col("o_custkey").alias("node_id"), "o_orderdate", "o_orderkey"), "node_id", ["o_orderdate", "o_orderkey"])
    return v.select("node_id", "o_orderkey", F.col("version").cast("long").alias("version"))


@query(f"WITH {P.CONNECT} SELECT src AS node, count(*)::DOUBLE AS degree FROM connect GROUP BY src")
def degrees(spark, sf):
    return G.degrees(P.connects(spark, sf))


@query(f"WITH {P.ASSET}, {P.CONNECT}, b AS (SELECT src AS a, dst AS o FROM connect UNION ALL SELECT dst, src FROM connect) SELECT asset_id, (SELECT count(*)::DOUBLE FROM b JOIN asset x ON x.asset_id = b.o WHERE b.a = asset.asset_id AND x.criticality IN ('critical', 'high')) AS connected_critical_assets FROM asset")
def critical_neighbors(spark, sf):
    return G.critical_neighbours(P.assets(spark, sf), P.connects(spark, sf))


@query(
    f"""WITH {P.CONNECT}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM connect), s AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT x, count(*) AS k FROM s GROUP BY x),
 t AS (SELECT p.x, count(*) / 2 AS t FROM s p JOIN s q ON q.x = p.x AND q.y <> p.y JOIN s r ON r.x = p.y AND r.y = q.y GROUP BY p.x) SELECT d.x AS node, {q6_sql('CASE WHEN k > 1 THEN coalesce(t, 0) * 2.0::DOUBLE / (k * (k - 1)) ELSE 0 END')} AS clustering FROM d LEFT JOIN t ON t.x = d.x"""
)
def clustering(spark, sf):
    return G.clustering(P.connects(spark, sf)).select("node", q6(F.col("clustering")).alias("clustering"))


#: No walk needs more hops than there are assets.
@query(
    f"""WITH RECURSIVE {P.CONNECT}, st AS (SELECT vuln_id, min(vuln_id * 3 % 100) AS node FROM (SELECT DISTINCT p_partkey AS vuln_id FROM part) GROUP BY vuln_id),
 w AS (SELECT DISTINCT node AS root, node, 0 AS h FROM st UNION SELECT w.root, c.dst, h + 1 FROM w JOIN connect c ON c.src = w.node WHERE h < (SELECT count(*) FROM supplier)), m AS (SELECT root, node, min(h) AS h FROM w GROUP BY ALL)
 SELECT p.vuln_id, p.asset_id, coalesce(h, -1)::DOUBLE AS attack_path_depth FROM (SELECT DISTINCT l_partkey AS vuln_id, l_suppkey AS asset_id FROM lineitem) p LEFT JOIN st ON st.vuln_id = p.vuln_id LEFT JOIN m ON m.root = st.node AND m.node = p.asset_id"""
)
def path_depth(spark, sf):
    starts = P.table(spark, sf, "part").select(F.col("p_partkey").alias("vuln_id"), (F.col("p_partkey") * 3 % 100).alias("node"))
    pairs = P.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vuln_id"), F.col("l_suppkey").alias("asset_id")).distinct()
    return G.path_depth(P.connects(spark, sf), starts, pairs)


#: Ego graphs of radius 3, in which no two nodes are more than 6 hops apart; shortest paths counted hop by hop.
BETWEEN = """ub AS (SELECT src AS a, dst AS b FROM connect UNION SELECT dst, src FROM connect), ego0 AS (SELECT s_suppkey AS ego, s_suppkey AS m, 0 AS h FROM supplier UNION SELECT ego, b, h + 1 FROM ego0 JOIN ub ON a = m WHERE h < 3),
 ego AS (SELECT DISTINCT ego, m FROM ego0), ee AS (SELECT x.ego, ub.a, ub.b FROM ub JOIN ego x ON x.m = ub.a JOIN ego y ON y.ego = x.ego AND y.m = ub.b),
 walks AS (SELECT ego, m AS s, m AS v, 0 AS h FROM ego UNION SELECT w.ego, s, b, h + 1 FROM walks w JOIN ee ON ee.ego = w.ego AND ee.a = w.v WHERE h < 6), apart AS (SELECT ego, s, v, min(h) AS h FROM walks GROUP BY ALL),
 ways AS (SELECT ego, s, v, h, 1.0::DOUBLE AS n FROM apart WHERE h = 0 UNION ALL SELECT d.ego, d.s, d.v, d.h, sum(n) FROM ways w JOIN ee ON ee.ego = w.ego AND ee.a = w.v JOIN apart d ON d.ego = w.ego AND d.s = w.s AND d.v = ee.b AND d.h = w.h + 1 GROUP BY ALL),
 centre AS (SELECT st.ego, sum(a.n * c.n / st.n) AS x FROM ways st JOIN ways a ON a.ego = st.ego AND a.s = st.s AND a.v = st.ego JOIN ways c ON c.ego = st.ego AND c.s = st.ego AND c.v = st.v WHERE st.s <> st.ego AND st.v <> st.ego AND st.s <> st.v AND a.h + c.h = st.h GROUP BY st.ego),
 between_ AS (SELECT e.ego AS node, CASE WHEN count(*) > 2 THEN coalesce(any_value(x), 0) / ((count(*) - 1) * (count(*) - 2)) ELSE 0 END AS network_exposure_score FROM ego e LEFT JOIN centre USING (ego) GROUP BY e.ego)"""


@query(f"WITH RECURSIVE {P.CONNECT}, {BETWEEN} SELECT node, {q6_sql('network_exposure_score')} AS network_exposure_score FROM between_")
def betweenness(spark, sf):
    b = G.betweenness(P.connects(spark, sf), P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))
    return b.select("node", q6(F.col("network_exposure_score")).alias("network_exposure_score"))


WITH_TOPOLOGY = f"""WITH RECURSIVE {P.ASSET}, {P.CONNECT}, {BETWEEN}, pp AS (SELECT DISTINCT l_partkey AS vuln_id, l_suppkey AS asset_id FROM lineitem),
 st AS (SELECT DISTINCT p_partkey AS vuln_id, p_partkey * 3 % 100 AS node FROM part), w AS (SELECT DISTINCT node AS root, node, 0 AS h FROM st UNION SELECT w.root, c.dst, h + 1 FROM w JOIN connect c ON c.src = w.node WHERE h < (SELECT count(*) FROM supplier)),
 far AS (SELECT root, node, min(h) AS h FROM w GROUP BY ALL), deg AS (SELECT src, count(*)::DOUBLE AS n FROM connect GROUP BY src), reach AS (SELECT vuln_id, count(*)::DOUBLE AS n FROM pp GROUP BY vuln_id),
 crit AS (SELECT b.a, count(*)::DOUBLE AS n FROM (SELECT src AS a, dst AS o FROM connect UNION ALL SELECT dst, src FROM connect) b JOIN asset x ON x.asset_id = b.o WHERE x.criticality IN ('critical', 'high') GROUP BY b.a),
 tri AS (SELECT p.vuln_id, count(*)::DOUBLE AS t FROM pp p JOIN pp q ON q.vuln_id = p.vuln_id AND q.asset_id > p.asset_id JOIN ub ON ub.a = p.asset_id AND ub.b = q.asset_id GROUP BY p.vuln_id)
 SELECT p.vuln_id, p.asset_id, coalesce(deg.n, 0) AS asset_degree, reach.n AS vuln_reach, coalesce(far.h, -1)::DOUBLE AS attack_path_depth, {q6_sql('network_exposure_score')} AS network_exposure_score,
 {q6_sql('CASE WHEN reach.n > 1 THEN coalesce(t, 0) * 2 / (reach.n * (reach.n - 1)) ELSE 0 END')} AS vuln_clustering, coalesce(crit.n, 0) AS connected_critical_assets
 FROM pp p JOIN reach USING (vuln_id) LEFT JOIN deg ON deg.src = p.asset_id LEFT JOIN st USING (vuln_id) LEFT JOIN far ON far.root = st.node AND far.node = p.asset_id LEFT JOIN between_ ON between_.node = p.asset_id LEFT JOIN tri USING (vuln_id) LEFT JOIN crit ON crit.a = p.asset_id"""


@query(f"WITH {P.CONNECT}, m AS (SELECT s_suppkey AS x, s_suppkey // 3 * 3 AS kept FROM supplier) SELECT DISTINCT a.kept AS src, b.kept AS dst FROM connect JOIN m a ON a.x = src JOIN m b ON b.x = dst WHERE a.kept <> b.kept")
def repointed_edges(spark, sf):
    """Edges after a merge of nodes: ends moved, without loops and repeats."""
    k = F.col("s_suppkey")
    return G.repoint(P.connects(spark, sf), P.table(spark, sf, "supplier").select(k.alias("cpe"), (k - k % 3).alias("kept")))


@query("SELECT c_custkey AS node_id, c_custkey IN (SELECT s_suppkey FROM supplier) AS is_node FROM customer")
def node_lookup(spark, sf):
    nodes = P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"))
    return G.present(nodes, P.table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id")))


# ---------------------------------------------------------------- stores

_FV = "fv AS (SELECT o_custkey AS vuln_id, o_orderkey % 7 AS asset_id, o_orderdate AS computed_at, 'c' || strftime(o_orderdate, '%Y%m') AS cycle_id, o_totalprice AS f1, o_orderkey FROM orders)"


def _features(spark, sf):
    return P.table(spark, sf, "orders").select(F.col("o_custkey").alias("vuln_id"), (F.col("o_orderkey") % 7).alias("asset_id"), F.col("o_orderdate").alias("computed_at"), F.concat(F.lit("c"), F.date_format("o_orderdate", "yyyyMM")).alias("cycle_id"), F.col("o_totalprice").alias("f1"), "o_orderkey")


@query(f"WITH {_FV} SELECT vuln_id, asset_id, computed_at, cycle_id, f1, o_orderkey FROM fv QUALIFY row_number() OVER (PARTITION BY vuln_id, asset_id ORDER BY computed_at DESC, o_orderkey DESC) = 1")
def latest_features(spark, sf):
    return store.latest(_features(spark, sf), ["vuln_id", "asset_id"], ["computed_at", "o_orderkey"])


@query(f"WITH {_FV}, keep AS (SELECT DISTINCT cycle_id FROM fv ORDER BY cycle_id DESC LIMIT 30) SELECT o_orderkey, cycle_id FROM fv WHERE cycle_id IN (SELECT cycle_id FROM keep)")
def prune_cycles(spark, sf):
    return store.kept_cycles(_features(spark, sf), 30).select("o_orderkey", "cycle_id")


@query(
    f"""WITH {_FV}, l AS (SELECT * FROM fv QUALIFY row_number() OVER (PARTITION BY vuln_id, asset_id ORDER BY computed_at DESC, cycle_id DESC) = 1)
 SELECT l.vuln_id, l.asset_id, l.computed_at, quality AS label FROM l JOIN labels ON doc_id = l.vuln_id WHERE l.asset_id = 3"""
)
def training_dataset(spark, sf):
    labels = P.table(spark, sf, "labels").select(F.col("doc_id").alias("vuln_id"), F.lit(3).cast("long").alias("asset_id"), F.lit("exploited").alias("label_name"), F.col("quality").alias("label_value"))
    return store.training_dataset(_features(spark, sf).drop("o_orderkey"), labels, "exploited").select("vuln_id", "asset_id", "computed_at", F.col("label_value").alias("label"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS click, CASE WHEN event_type = 'error' THEN value ELSE 0 END AS error FROM events")
def feature_pivot(spark, sf):
    from riskloom.operators.features import pivoted

    m = P.table(spark, sf, "events").select("event_id", F.create_map("event_type", "value").alias("features"))
    return pivoted(m, ["event_id"], "features", ["click", "error"])


@query("SELECT o_custkey AS model, arg_max(o_orderkey, o_orderdate + to_microseconds(o_orderkey)) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def production_models(spark, sf):
    r = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "production").otherwise("staged").alias("status"), F.col("o_orderdate").alias("trained_at"))
    return store.production(r).select("model", "version")


@query("SELECT o_orderkey AS version, CASE WHEN o_custkey = 7 AND o_orderkey = 100 THEN 'production' WHEN o_custkey = 7 AND o_orderstatus = 'F' THEN 'archived' WHEN o_orderstatus = 'F' THEN 'production' ELSE 'staged' END AS status FROM orders")
def promote_model(spark, sf):
    r = P.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("model"), F.col("o_orderkey").cast("string").alias("version"), F.when(F.col("o_orderstatus") == "F", "production").otherwise("staged").alias("status"))
    return store.promote(r, "7", "100").select(F.col("version").cast("long").alias("version"), "status")


@query(f"WITH {P.HISTORY}, l AS (SELECT key, state, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM history) SELECT a.key, a.state AS dominant_state, CASE WHEN a.state = b.state THEN a.key % 3 + 1 ELSE 0 END AS updates_in_state FROM l a JOIN l b ON a.key = b.key AND a.n = 1 AND b.n = 2")
def update_states(spark, sf):
    from pyspark.sql import Window

    h = P.history(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id"))))
    old = h.where("n = 2").select("key", F.col("state").alias("dominant_state"), (F.col("key") % 3).cast("int").alias("updates_in_state"))
    new = h.where("n = 1").select("key", F.col("state").alias("dominant_state"))
    return store.update_states(old, new, ["key"])[1]
