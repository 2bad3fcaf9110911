"""The property graph as two DataFrames: nodes (node_id, node_type, attrs) and edges (src, dst, relation)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions.lineage import HOPS_A_CUT, cut, many, saved, spread_by
from riskloom.functions.scalar import cpe_canonical, d


def upsert_nodes(rows: DataFrame, seq: str, key: str = "node_id") -> DataFrame:
    """G1: one row for each node: every attribute from the last row in which it is not null."""
    attrs = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in attrs])


def dedupe_edges(rows: DataFrame, seq: str, single: bool = False) -> DataFrame:
    """One edge for each (src, dst, relation), or with ``single`` each (src, dst): the last relation wins."""
    keys = ["src", "dst"] if single else ["src", "dst", "relation"]
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_x")).select(*keys, "_x.*")


def neighbours(edges: DataFrame, relation: str | None = None, reverse: bool = False) -> DataFrame:
    """(node, neighbour) along edges, or against them."""
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G12."""
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edge_count"))))


LINK_BLOCK = 4096  # assets in one list
FEW_WAYS = 1_000_000  # ways between classes, or assets in lists, that are sent to all tasks


def _alike(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """((key, class), (class, cpe)): those with the same set of platforms are one class."""
    of = rows.where("cpe is not null").groupBy(key).agg(F.array_sort(F.collect_set("cpe")).alias("_cpes"))
    of = cut(of.select(key, F.sha2(F.to_json("_cpes"), 256).alias(name), "_cpes"))
    return of.select(key, name), of.groupBy(name).agg(F.first("_cpes").alias("_cpes")).select(name, F.explode("_cpes").alias("cpe"))


def link_by_cpe(affects: DataFrame, runs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New (vuln_id, asset_id) links: an equi-join on the platform, distinct, less existing links.

    No link is shuffled: vulnerabilities and assets with the same platforms are a class each, pairs of classes are made distinct, and the links are
    spread last, from lists of at most ``LINK_BLOCK`` assets less the vulnerability's existing ones. Only the rows that
    come in move, existing links once, by vulnerability; few ways and assets are sent to where the vulnerabilities lie.
    """
    vulns, v_cpes = _alike(affects, "vuln_id", "_v")
    assets, a_cpes = _alike(runs, "asset_id", "_a")
    sizes = assets.groupBy("_a").agg(F.ceil(F.count(F.lit(1)) / (LINK_BLOCK // 2)).alias("_lists"))
    # dealt by hash to lists of half that length on average
    dealt = assets.join(F.broadcast(sizes), "_a").groupBy("_a", F.pmod(F.xxhash64("asset_id"), F.col("_lists"))).agg(F.collect_list("asset_id").alias("_ids"))
    lists = cut(dealt.select("_a", F.monotonically_increasing_id().alias("_list"), "_ids"))
    ways = cut(v_cpes.join(a_cpes, "cpe").select("_v", "_a").distinct().join(lists.select("_a", "_list"), "_a").select("_v", "_list"))
    todo, left = vulns, F.col("_ids")
    if existing is not None:
        known = spread_by(existing.select("vuln_id", "asset_id"), "vuln_id", bytes_each=1 << 20).groupBy("vuln_id").agg(F.collect_set("asset_id").alias("_known"))
        todo = todo.join(many(known), "vuln_id", "left")
        left = F.when(F.col("_known").isNull(), left).otherwise(F.array_except(left, F.col("_known")))
    few = lambda df, n: F.broadcast(df) if n <= FEW_WAYS else df
    todo = todo.join(few(ways, ways.count()), "_v")
    ends = lists.agg(F.sum(F.size("_ids"))).first()[0] or 0
    return todo.join(few(lists.select("_list", "_ids"), ends), "_list").select("vuln_id", F.explode(left).alias("asset_id"))


def merge_cpes(cpes: DataFrame, seq: str) -> DataFrame:
    """(cpe, kept): spellings of one platform map to the one seen first."""
    canon = cpe_canonical(F.col("cpe"))
    first = cpes.groupBy(canon.alias("_canon")).agg(F.min_by("cpe", F.struct(seq, "cpe")).alias("kept"))
    return cpes.select("cpe", canon.alias("_canon")).distinct().join(first, "_canon").select("cpe", "kept")


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends, without loops and repeats."""
    cols = edges.columns
    for end in ("src", "dst"):
        edges = edges.join(mapping.select(F.col("cpe").alias(end), F.col("kept").alias("_k")), end, "left").withColumn(end, F.coalesce("_k", end)).drop("_k")
    return edges.where("src <> dst").select(*cols).distinct()


def ontology_violations(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (source type, relation, target type) is not allowed."""
    t = nodes.select("node_id", "node_type")
    typed = edges.join(t.withColumnsRenamed({"node_id": "src", "node_type": "src_type"}), "src").join(t.withColumnsRenamed({"node_id": "dst", "node_type": "dst_type"}), "dst")
    return typed.join(F.broadcast(allowed), ["src_type", "relation", "dst_type"], "left_anti")


def allowed_edges(spark) -> DataFrame:
    return spark.createDataFrame(C.ONTOLOGY, "src_type string, relation string, dst_type string")


def versions(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """K3: a version number from 1 for each snapshot of a node."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def history_tail(history: DataFrame, key: list[str], order: list[str], limit: int = 10) -> DataFrame:
    """The last ``limit`` rows of each key with their position in ascending order."""
    back = Window.partitionBy(*key).orderBy(*[F.desc(x) for x in order])
    tail = history.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= limit)
    return tail.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_back")))).drop("_back")


# ---------------------------------------------------------------- topology


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("degree"))


def critical_neighbours(assets: DataFrame, connects: DataFrame) -> DataFrame:
    """Neighbours of high or critical tier, out and in counted apart."""
    crit = assets.where(F.col("criticality").isin("critical", "high")).select(F.col("asset_id").alias("other"))
    both = connects.select(F.col("src").alias("asset_id"), F.col("dst").alias("other")).unionAll(connects.select(F.col("dst").alias("asset_id"), F.col("src").alias("other")))
    hit = both.join(crit, "other").groupBy("asset_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return assets.select("asset_id").join(hit, "asset_id", "left").select("asset_id", F.coalesce("n", d(0)).alias("connected_critical_assets"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient on the undirected graph: 2 * triangles / (degree * (degree - 1)).

    Each triangle is found once: edges point from the end of lower degree to the higher, and each brings along what its head points to; the tail's row
    looks for its own heads among that. No two neighbours of a node make a row, so what moves is the edges and the heads' lists.
    """
    u = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = u.select(F.col("a").alias("n")).unionAll(u.select(F.col("b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    deg = saved(deg)
    e = u.join(many(deg.withColumnsRenamed({"n": "a", "deg": "da"})), "a").join(many(deg.withColumnsRenamed({"n": "b", "deg": "db"})), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = saved(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")))
    heads = e.join(many(e.select(F.col("hi").alias("lo")).distinct()), "lo", "left_semi").groupBy(F.col("lo").alias("hi")).agg(F.collect_list("hi").alias("_to"))
    own = e.join(many(heads), "hi", "left").groupBy("lo").agg(F.collect_list("hi").alias("_own"), F.collect_list(F.when(F.col("_to").isNotNull(), F.struct("hi", "_to"))).alias("_ways"))
    ways = own.select("lo", "_own", F.explode("_ways").alias("w")).select("lo", F.col("w.hi").alias("x"), F.explode(F.array_intersect("w._to", "_own")).alias("y"))
    per = ways.select(F.explode(F.array("lo", "x", "y")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("t"))
    k = F.col("deg")
    return deg.join(many(per), "n", "left").select(F.col("n").alias("node"), F.when(k > 1, F.coalesce("t", F.lit(0)) * 2.0 / (k * (k - 1))).otherwise(d(0)).alias("clustering"))


def path_depth(edges: DataFrame, starts: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Per (vuln_id, asset_id), least hops from any start of the vulnerability (vuln_id, node) to the asset; -1 if there is no path.

    The walk ends when a hop reaches nothing new, or after ``max_hops`` if given (then -1 also stands for longer paths).
    """
    e = cut(edges.select("src", "dst").distinct())
    # walked once for each distinct start, however many vulnerabilities share it; 64 starts are the bits of one number
    bits = cut(starts.where("node is not null").select(F.col("node").alias("root")).distinct().withColumn("_i", F.monotonically_increasing_id()).selectExpr("root", "shiftright(_i, 6) AS _block", "CAST(_i & 63 AS int) AS _bit"))
    state = bits.groupBy(F.col("root").alias("node"), "_block").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_new")).withColumn("_seen", F.col("_new"))
    reached = state.select("node", "_block", "_new").withColumn("hops", F.lit(0))
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        ahead = state.where("_new <> 0").select(F.col("node").alias("src"), "_block", "_new").join(e, "src").groupBy(F.col("dst").alias("node"), "_block").agg(F.expr("bit_or(_new)").alias("_in"))
        both = state.select("node", "_block", "_seen").join(ahead, ["node", "_block"], "full")
        state = cut(both.selectExpr("node", "_block", "coalesce(_in, 0) & ~coalesce(_seen, 0) AS _new", "coalesce(_in, 0) | coalesce(_seen, 0) AS _seen"))
        frontier = state.where("_new <> 0").select("node", "_block", "_new")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
        if hop % HOPS_A_CUT == 0:
            reached = cut(reached)
    seen = reached.join(bits, "_block").where("shiftright(_new, _bit) & 1 = 1").select("root", "node", "hops")
    roots = starts.select("vuln_id", F.col("node").alias("root")).distinct()
    depth = pairs.select("vuln_id", "asset_id").join(roots, "vuln_id").join(seen.withColumnRenamed("node", "asset_id"), ["root", "asset_id"]).groupBy("vuln_id", "asset_id").agg(F.min("hops").alias("hops"))
    return pairs.select("vuln_id", "asset_id").join(depth, ["vuln_id", "asset_id"], "left").select("vuln_id", "asset_id", F.coalesce(F.col("hops"), F.lit(-1)).cast("double").alias("attack_path_depth"))


EGO_NODES = 512  # of one ego graph whose pairs are a matrix in a task; larger ones are joined


def _through_centres(levels: int):
    """For rows (ego, nodes, w, src, dst) of an ego graph each: (ego, x), the weighted share of shortest paths between two nodes that run through the centre."""
    import numpy as np
    import pyarrow as pa

    def share(ego, nodes, w, src, dst) -> float:
        order = np.argsort(nodes)
        nodes, w = nodes[order], w[order]
        links, c = np.zeros((len(nodes), len(nodes))), int(np.searchsorted(nodes, ego))
        links[np.searchsorted(nodes, src), np.searchsorted(nodes, dst)] = 1
        last = np.eye(len(nodes))
        ways, apart = last.copy(), np.zeros(links.shape, np.int64)
        for h in range(1, levels + 1):
            last = (last @ links) * (ways == 0)
            if not last.any():
                break
            ways += last
            apart[last > 0] = h
        a, far = ways[:, c] * w, apart[:, c]
        a[c] = 0
        on = (ways > 0) & (apart == far[:, None] + far)
        np.fill_diagonal(on, False)
        return float((np.outer(a, a)[on] / ways[on]).sum())

    def run(batches):
        for batch in batches:
            lists = [(col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)) for col in batch.columns[1:]]
            egos = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([share(ego, *[v[o[i] : o[i + 1]] for o, v in lists]) for i, ego in enumerate(egos)], pa.float64())], ["ego", "x"])

    return run


def _through_by_joins(member: DataFrame, ways_on: DataFrame, radius: int) -> DataFrame:
    """As ``_through_centres``, for ego graphs of any size: level by level, by joins on (ego, node); a level needs only the two before it."""
    last = member.select("ego", F.col("node").alias("s"), "node", d(1).alias("ways"))
    counted, near = last.withColumn("h", F.lit(0)), last.limit(0)
    for h in range(1, 2 * radius + 1):
        step = last.join(ways_on, ["ego", "node"]).groupBy("ego", "s", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        before = near.unionByName(last).select("ego", "s", "node")
        last, near = cut(step.join(before, ["ego", "s", "node"], "left_anti")), last
        counted = counted.unionByName(last.withColumn("h", F.lit(h)))
    to_centre = cut(counted.where("node = ego and s <> ego").select("ego", "s", "ways", "h").join(member.withColumnRenamed("node", "s"), ["ego", "s"]))
    pairs = counted.where("s < node and s <> ego and node <> ego")
    pairs = pairs.join(to_centre.select("ego", "s", F.col("ways").alias("_a"), F.col("h").alias("_ha"), F.col("w").alias("_wa")), ["ego", "s"])
    pairs = pairs.join(to_centre.select("ego", F.col("s").alias("node"), F.col("ways").alias("_b"), F.col("h").alias("_hb"), F.col("w").alias("_wb")), ["ego", "node"])
    return pairs.where("h = _ha + _hb").groupBy("ego").agg(F.sum(F.expr("2 * _wa * _wb * _a * _b / ways")).alias("x"))


def betweenness(edges: DataFrame, nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Normalised betweenness of each node in its undirected ego graph of that radius; 0 under three nodes.

    Shortest paths are counted level by level for all sources of an ego graph at once: in a matrix where it has at most ``EGO_NODES`` nodes, else by joins.
    Of the paths between two nodes, those through the centre are the product of the counts to it and from it, where the lengths add up.
    Nodes with one neighbour are weights of that neighbour, on the centre they are counted in closed form, and as centres they have 0:
    a star of any size is one row.
    """
    flat = edges.where("src <> dst").select("src", "dst")
    u = cut(flat.unionAll(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = cut(u.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n")))
    inner, leaf = degree.where("_n > 1").select("node"), degree.where("_n = 1").select(F.col("node").alias("src"))
    leaves = u.join(leaf, "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_leaves"))
    e = cut(u.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    last = cut(nodes.select("node").distinct().join(inner, "node", "left_semi").select(F.col("node").alias("ego"), "node"))
    member, near = last.withColumn("h", F.lit(0)), last
    for h in range(1, radius + 1):
        step = last.withColumnRenamed("node", "src").join(e, "src").select("ego", F.col("dst").alias("node")).distinct()
        last, near = cut(step.join(near, ["ego", "node"], "left_anti")), last
        member, near = member.unionByName(last.withColumn("h", F.lit(h))), near.unionByName(last)
    weight = F.when(F.col("h") < radius, F.coalesce("_leaves", F.lit(0))).otherwise(F.lit(0)) + 1  # leaves of the rim lie outside
    member = cut(member.join(leaves, "node", "left").select("ego", "node", weight.cast("double").alias("w")))
    inside = member.select("ego", "node")
    ways_on = cut(inside.withColumnRenamed("node", "src").join(e, "src").join(inside.withColumnRenamed("node", "dst"), ["ego", "dst"]).select("ego", F.col("src").alias("node"), "dst"))
    size = member.groupBy("ego").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("ego") == F.col("node"), F.col("w") - 1)).alias("own"), F.count(F.lit(1)).alias("_m"))
    large = cut(size.where(F.col("_m") > EGO_NODES).select("ego"))
    small = member.join(large, "ego", "left_anti").groupBy("ego").agg(F.collect_list("node").alias("nodes"), F.collect_list("w").alias("w"))
    links = ways_on.join(large, "ego", "left_anti").groupBy("ego").agg(F.collect_list("node").alias("src"), F.collect_list("dst").alias("dst"))
    kind = member.schema["ego"].dataType.simpleString()
    through = small.join(links, "ego").select("ego", "nodes", "w", "src", "dst").mapInArrow(_through_centres(2 * radius), f"ego {kind}, x double")
    if not large.isEmpty():
        through = through.unionByName(_through_by_joins(member.join(large, "ego", "left_semi"), ways_on.join(large, "ego", "left_semi"), radius))
    scored = size.join(through, "ego", "left").select(F.col("ego").alias("node"), F.expr("CASE WHEN n > 2 THEN (coalesce(x, 0) + own * (2 * n - 3 - own)) / ((n - 1) * (n - 2)) END").alias("network_exposure_score"))
    return nodes.select("node").join(scored, "node", "left").select("node", F.coalesce("network_exposure_score", d(0)).alias("network_exposure_score"))


def topological(pairs: DataFrame, connects: DataFrame, assets: DataFrame, starts: DataFrame, edges: DataFrame, vuln_node: Column, radius: int = 3) -> DataFrame:
    """T5: the six topological features of each pair: asset_degree, vuln_reach, attack_path_depth, network_exposure_score, vuln_clustering and
    connected_critical_assets. Each comes once at its own grain.

    ``starts``: (vuln_id, node) of what exploits a vulnerability; ``edges``: (src, dst) of the whole graph, in which a vulnerability's node is ``vuln_node``.
    """
    by_asset = assets.select("asset_id").join(degrees(connects).select(F.col("node").alias("asset_id"), F.col("degree").alias("asset_degree")), "asset_id", "left")
    by_asset = by_asset.join(critical_neighbours(assets, connects), "asset_id", "left").join(betweenness(connects, assets.select(F.col("asset_id").alias("node")), radius).withColumnRenamed("node", "asset_id"), "asset_id", "left")
    reach = pairs.select("vuln_id", "asset_id").distinct().groupBy("vuln_id").agg(F.count(F.lit(1)).cast("double").alias("vuln_reach"))
    near = clustering(edges).select(F.col("node").alias("_node"), F.col("clustering").alias("vuln_clustering"))
    by_vuln = reach.withColumn("_node", vuln_node).join(near, "_node", "left").drop("_node")
    out = path_depth(connects, starts, pairs).join(by_vuln, "vuln_id", "left").join(by_asset, "asset_id", "left")
    names = ("asset_degree", "vuln_reach", "attack_path_depth", "network_exposure_score", "vuln_clustering", "connected_critical_assets")
    return out.select("vuln_id", "asset_id", *[F.coalesce(F.col(c), d(0)).alias(c) for c in names])


def node(nodes: DataFrame, node_id) -> DataFrame:
    """A node, or no row."""
    return nodes.where(F.col("node_id") == node_id)


def present(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Which of the keys are nodes."""
    known = nodes.select("node_id").distinct().withColumn("is_node", F.lit(True))
    return keys.join(known, "node_id", "left").withColumn("is_node", F.coalesce("is_node", F.lit(False)))
