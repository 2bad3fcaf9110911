"""Composite risk, propagation over the asset network, roll-up over the organisation, critical paths, trends, what-if."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import constants as C
from riskloom.functions.lineage import HOPS_A_CUT, cut, drop_cut, drop_folder, new_folder
from riskloom.functions.scalar import clamp, d, tier_number


def criticality_score(tier: Column) -> Column:
    """A2 for a known tier: 1, .75, .5, .25."""
    return tier_number(tier, C.TIER_SCORE, 0.5, 0.5)


def criticality_of_distribution(dist: Column, score: Column) -> Column:
    """A2: the tiers' scores weighted by their shares (a map), or ``score`` where there are none."""
    total = d(0)
    for tier, v in C.TIER_SCORE.items():
        total = total + F.coalesce(F.element_at(dist, tier), d(0)) * v
    return F.when(F.coalesce(F.size(dist), F.lit(0)) > 0, total).otherwise(score)


def composite(exploit: Column, impact: Column, active_mass: Column, criticality: Column) -> Column:
    """A1; ``active_mass`` is s2 + s3, null where there is no state (then 0.5)."""
    w = C.COMPOSITE
    return clamp(exploit * w["exploit"] + impact / 10 * w["impact"] + F.coalesce(active_mass, d(0.5)) * w["state"] + criticality * w["criticality"])


def hops_upstream(connects: DataFrame, max_hops: int = C.MAX_HOPS) -> DataFrame:
    """(asset_id, upstream, hop): every asset that reaches asset_id over 1 .. max_hops edges, at its least hop.

    A frontier a hop is joined to the edges; what was reached before is taken off by an anti-join.
    """
    e = cut(connects.select("src", "dst").where("src <> dst").distinct())
    frontier = e.select(F.col("dst").alias("asset_id"), F.col("src").alias("upstream"), F.lit(1).alias("hop"))
    seen = frontier
    for hop in range(2, max_hops + 1):
        step = frontier.select("asset_id", F.col("upstream").alias("dst")).join(e, "dst").select("asset_id", F.col("src").alias("upstream")).where("asset_id <> upstream").distinct()
        frontier = cut(step.join(seen.select("asset_id", "upstream"), ["asset_id", "upstream"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def propagated(pairs: DataFrame, connects: DataFrame, damping: float = C.DAMPING, max_hops: int = C.MAX_HOPS) -> DataFrame:
    """A3, A4: (asset_id, direct_risk, propagated_risk) from pairs (asset_id, risk, active_mass or null).

    Pairs are summed by asset before the network is walked, so the walk's size follows assets and not pairs.
    """
    by_asset = pairs.groupBy("asset_id").agg(F.sum("risk").alias("direct_risk"), F.sum(F.col("risk") * F.coalesce(F.col("active_mass"), d(1))).alias("_weighted"))
    up = by_asset.select(F.col("asset_id").alias("upstream"), "_weighted")
    inflow = hops_upstream(connects, max_hops).join(up, "upstream").groupBy("asset_id").agg(F.sum(F.col("_weighted") * F.pow(d(damping), F.col("hop"))).alias("_inflow"))
    out = by_asset.join(inflow, "asset_id", "full")
    return out.select("asset_id", F.coalesce("direct_risk", d(0)).alias("direct_risk"), (F.coalesce("direct_risk", d(0)) + F.coalesce("_inflow", d(0))).alias("propagated_risk"))


def unit_rollup(assets: DataFrame) -> DataFrame:
    """A5: per business unit, from (asset_id, bu, tier, risk): total, weighted by tier, count, mean and max. A null unit is "Unassigned"."""
    weight = tier_number(F.col("tier"), C.TIER_WEIGHT, 2.0, 1.0)
    return assets.groupBy(F.coalesce("bu", F.lit("Unassigned")).alias("bu")).agg(
        F.sum("risk").alias("total_risk"), F.sum(weight * F.col("risk")).alias("weighted_risk"), F.count(F.lit(1)).alias("asset_count"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk")
    )


def hierarchy_closure(tree: DataFrame) -> DataFrame:
    """(ancestor, unit) for each unit and all above it, however far, itself included; tree has (unit, parent), parent null at the top. A circle is walked once."""
    closure = tree.select(F.col("unit").alias("ancestor"), "unit")
    frontier = tree.where("parent is not null").select(F.col("parent").alias("ancestor"), "unit")
    up = tree.where("parent is not null").select(F.col("unit").alias("ancestor"), F.col("parent").alias("_up"))
    for level in count(1):
        closure = closure.unionByName(frontier)
        if level % HOPS_A_CUT == 0:
            closure = cut(closure)
        step = frontier.join(up, "ancestor").select(F.col("_up").alias("ancestor"), "unit").distinct()
        frontier = cut(step.join(closure, ["ancestor", "unit"], "left_anti"))
        if frontier.isEmpty():
            return closure


def _fold(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """The sums of a unit's rows; null where a sum has no value."""
    return rows.groupBy(F.col(unit).alias("unit")).agg(*[F.sum(c).alias(c) for c in ("total_risk", "weighted_risk", "asset_count")], F.max("max_risk").alias("max_risk"))


def _doubled(links: DataFrame, values: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling: after round k a unit's value covers all less than 2^k levels below, and its link leads 2^k levels up. (values, links left over)."""
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = values.join(links, "unit", "left").withColumn("unit", F.explode(F.array_compact(F.array("unit", "up"))))
        values = cut(_fold(both))
        above = links.select(F.col("unit").alias("up"), F.col("up").alias("_next"))
        links = cut(links.join(above, "up").select("unit", F.col("_next").alias("up")))
    return values, links


def _circles(links: DataFrame, on_circle: DataFrame, rounds: int) -> DataFrame:
    """(unit, circle): the least unit of the circle that each of these units lies on."""
    hop = links.join(on_circle, "unit", "left_semi")
    label = hop.select("unit", F.least("unit", "up").alias("circle"))
    for _ in range(rounds):
        ahead = hop.join(label.withColumnsRenamed({"unit": "up", "circle": "_c"}), "up").select("unit", "_c")
        label = cut(label.join(ahead, "unit").select("unit", F.least("circle", "_c").alias("circle")))
        hop = cut(hop.join(hop.select(F.col("unit").alias("up"), F.col("up").alias("_next")), "up").select("unit", F.col("_next").alias("up")))
    return label


def hierarchy_rollup(units: DataFrame, tree: DataFrame) -> DataFrame:
    """Every unit with all below it; the mean is total over count; units without assets have zeros.

    Rounds of pointer doubling: as many as the logarithm of the depth, each over one row a unit. A unit on a circle has the whole circle and all
    that hangs on it, each once. A unit that is its own parent is a top. Where units have several parents, the closure of all ancestors is built,
    so that what is reached on two ways counts once.
    """
    links = cut(tree.where("parent is not null and parent <> unit").select("unit", F.col("parent").alias("up")).distinct())
    own = tree.select("unit").where("unit is not null").distinct().join(units.withColumnRenamed("bu", "unit"), "unit", "left")
    n, most = links.groupBy("unit").count().agg(F.count(F.lit(1)), F.max("count")).first()
    if (most or 0) > 1:
        parts = hierarchy_closure(links.withColumnRenamed("up", "parent").unionByName(tree.select("unit").distinct().withColumn("parent", F.lit(None).cast(tree.schema["parent"].dataType))))
        values = _fold(parts.distinct().join(units.withColumnRenamed("bu", "unit"), "unit", "left"), "ancestor")
    else:
        own = cut(_fold(own))
        rounds = (n + 1).bit_length()
        values, left = _doubled(links, own, rounds)
        if not left.isEmpty():
            # only circles are left: cut at their units, roll up what hangs on them, then give each unit its circle's sum
            on_circle = cut(left.select(F.col("up").alias("unit")).distinct())
            circles = _circles(links, on_circle, rounds)
            values, _ = _doubled(links.join(on_circle, "unit", "left_anti"), own, rounds)
            sums = [c for c in values.columns if c != "unit"]
            whole = _fold(circles.join(values, "unit").drop("unit"), "circle").select(F.col("unit").alias("circle"), *[F.col(c).alias(f"_{c}") for c in sums])
            values = values.join(circles, "unit", "left").join(whole, "circle", "left").select("unit", *[F.when(F.col("circle").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in sums])
    return values.select(
        F.col("unit").alias("bu"),
        F.coalesce("total_risk", d(0)).alias("total_risk"),
        F.coalesce("weighted_risk", d(0)).alias("weighted_risk"),
        F.coalesce("asset_count", F.lit(0)).cast("long").alias("asset_count"),
        F.coalesce(F.col("total_risk") / F.nullif(F.col("asset_count"), F.lit(0)), d(0)).alias("mean_risk"),
        F.coalesce("max_risk", d(0)).alias("max_risk"),
    )


def _levels_to(e: DataFrame, targets: DataFrame, max_hops: int | None) -> DataFrame:
    """(node, left): each node from which a target can be reached, with its least hops to one."""
    last = targets.select("node").distinct().withColumn("left", F.lit(0))
    near = last
    for n in count(1) if max_hops is None else range(1, max_hops + 1):
        step = e.join(last.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        last = cut(step.join(near.select("node"), "node", "left_anti").withColumn("left", F.lit(n)))
        if last.isEmpty():
            break
        near = near.unionByName(last)
        if n % HOPS_A_CUT == 0:
            near = cut(near)
    return cut(near)


def shortest_path_risks(edges: DataFrame, entries: DataFrame, targets: DataFrame, node_risk: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(entry, target, hops, path_risk): the risk along one shortest directed path from each entry to each other target; of several, the one of least node ids.

    A frontier row holds its path's sum and its place in the order of the entry's paths of that length, not the path: a path's order is that of its
    beginning, then that of its last node. Edges from whose end no target can be reached (in the hops that are left) are not walked. The walk ends
    when a hop reaches nothing new, or after ``max_hops`` if given. node_risk: (node, risk), one row a node; none counts 0.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    near = _levels_to(e, targets, max_hops)
    e = cut(e.join(near.withColumnRenamed("node", "dst"), "dst"))
    value = node_risk.select("node", F.col("risk").alias("_v"))
    start = entries.select("node").distinct().join(near.select("node"), "node", "left_semi").join(value, "node", "left")
    frontier = cut(start.select(F.col("node").alias("entry"), "node", F.lit(0).alias("hops"), F.lit(0).cast("long").alias("place"), F.coalesce("_v", d(0)).alias("path_risk")))
    seen = frontier.select("entry", "node", "hops", "path_risk")
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        ways = e if max_hops is None else e.where(F.col("left") <= max_hops - hop)
        step = frontier.withColumnRenamed("node", "src").join(ways, "src").groupBy("entry", F.col("dst").alias("node")).agg(F.min("place").alias("_place"), F.min_by("path_risk", "place").alias("_sum"))
        step = step.join(seen.select("entry", "node"), ["entry", "node"], "left_anti").join(value, "node", "left")
        # numbers rise along the sorted partitions: places compare like the paths
        step = step.orderBy("_place", "node").withColumn("place", F.monotonically_increasing_id())
        frontier = cut(step.select("entry", "node", F.lit(hop).alias("hops"), "place", (F.col("_sum") + F.coalesce("_v", d(0))).alias("path_risk")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.drop("place"))
        if hop % HOPS_A_CUT == 0:
            seen = cut(seen)
    return seen.where("hops > 0").join(targets.select("node").distinct(), "node", "left_semi").select("entry", F.col("node").alias("target"), "hops", "path_risk")


WORDS = 4  # longs a row: a block is 64 entries a long
PAIRS_A_ROUND = 1 << 29  # (entry, node) pairs whose hops are on disk at once, about two bits each
FEW_ROWS = 100_000  # steps back of at most so many rows are sent to where the hops lie
MANY_EDGES = 4_000_000  # above, edges are shuffled and not sent to all tasks


def _walk_sums(e: DataFrame, entries: DataFrame, value: DataFrame):
    """A function of a number of hops: (node, most): the largest sum along any walk of so many edges from any entry to the node, an upper bound of its paths' sums."""
    levels = [cut(entries.select("node").join(value, "node", "left").select("node", F.coalesce("_v", d(0)).alias("most")))]

    def at(hops: int) -> DataFrame:
        while len(levels) <= hops:
            step = levels[-1].withColumnRenamed("node", "src").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.max("most").alias("most"))
            levels.append(cut(step.join(value, "node", "left").select("node", (F.col("most") + F.coalesce("_v", d(0))).alias("most"))))
        return levels[hops]

    return at


def _hops_of(numbered: DataFrame, ways: DataFrame, max_hops: int | None, folder: str) -> list[DataFrame]:
    """For each number of hops (block, node, f0 ..), as tables in ``folder``: a bit for each entry of the block that reaches the node in so many and no fewer.

    A block's rows stay in its partition: with the edges at hand a hop moves nothing.
    """
    words, zero = range(WORDS), F.lit(0).cast("long")
    bit = [F.when(F.floor(F.col("_i") / 64) % WORDS == w, F.expr("shiftleft(1L, CAST(_i % 64 AS INT))")).otherwise(zero) for w in words]
    state = cut(numbered.select("block", "node", *[bit[w].alias(f"{k}{w}") for k in "sf" for w in words]))
    some = reduce(Column.bitwiseOR, [F.col(f"f{w}") for w in words]) != 0
    out = []
    for hop in count():
        level = state.where(some).select("block", "node", *[f"f{w}" for w in words])
        level.write.option("compression", "zstd").parquet(f"{folder}/{hop}")
        level = state.sparkSession.read.schema(level.schema).parquet(f"{folder}/{hop}")
        if level.isEmpty():
            break
        out.append(level)
        if hop == max_hops:
            break
        x = state.join(ways, "node", "left").withColumn("_next", F.explode(F.concat(F.array(F.lit(None)), F.coalesce(F.when(some, F.col("_to")), F.array()))))
        stays = F.col("_next").isNull()
        x = x.select("block", F.coalesce("_next", "node").alias("node"), *[F.when(stays == (k == "s"), F.col(f"{k}{w}")).otherwise(zero).alias(f"{k}{w}") for k in "sf" for w in words])
        x = x.groupBy("block", "node").agg(*[F.bit_or(f"{k}{w}").alias(f"{k}{w}") for k in "sf" for w in words])
        x = cut(x.select("block", "node", *[F.col(f"s{w}").bitwiseOR(F.col(f"f{w}")).alias(f"s{w}") for w in words], *[F.col(f"f{w}").bitwiseAND(F.bitwise_not(f"s{w}")).alias(f"f{w}") for w in words]))
        drop_cut(state)
        state = x
    drop_cut(state)
    return out


def _has_entry() -> Column:
    """Is the bit of entry ``_i`` set in f0 ..?"""
    word = F.element_at(F.array(*[F.col(f"f{w}") for w in range(WORDS)]), (F.floor(F.col("_i") / 64) % WORDS + 1).cast("int"))
    return F.getbit(word, (F.col("_i") % 64).cast("int")) == 1


def _sums_back(pairs: DataFrame, hops: int, levels: list[DataFrame], e: DataFrame, value: DataFrame, bounds, least: float | None) -> DataFrame:
    """(_i, target, path_risk) of pairs (block, _i, target) that are ``hops`` apart and may reach ``least``: step by step back from the target, of several next nodes the least id."""
    rows = pairs.join(value.withColumnRenamed("node", "target"), "target", "left").select("block", "_i", "target", F.col("target").alias("dst"), F.coalesce("_v", d(0)).alias("_sum"))
    for h in range(hops - 1, -1, -1):
        step = rows.join(e, "dst").select("block", "_i", "target", F.col("src").alias("node"), "dst", "_sum")
        small = step.count() <= FEW_ROWS
        held = levels[h].join(F.broadcast(step) if small else step, ["block", "node"]).where(_has_entry())
        best = held.groupBy("block", "_i", "target", "node").agg(F.min_by("_sum", "dst").alias("_sum"))
        if least is not None:  # a pair goes when none of its ways can reach it: which way is the pair's own is not known yet
            may = F.max(F.col("_sum") + F.col("most")).over(Window.partitionBy("block", "_i", "target"))
            best = best.join(bounds(h), "node").withColumn("_may", may)
        best = best.join(value, "node", "left").withColumn("_to", F.col("_sum") + F.coalesce("_v", d(0)))
        best = best if least is None else best.where(F.col("_may") >= least)
        rows = cut(best.select("block", "_i", "target", F.col("node").alias("dst"), F.col("_to").alias("_sum")))
    return rows.select("_i", "target", F.col("_sum").alias("path_risk"))


def critical_paths(assets: DataFrame, connects: DataFrame, asset_risk: DataFrame, top_n: int = 10, max_hops: int | None = None, pairs_a_round: int = PAIRS_A_ROUND) -> DataFrame:
    """The riskiest shortest paths from externally facing assets to critical or high ones: one shortest directed path a pair, of several the one of least node ids.

    Hops between all entries and nodes are found as bits, entries in rounds, so what is held does not grow with their pairs. Sums are worked
    out for the pairs only whose number of hops could reach the ``top_n`` found so far: the largest sum along any walk of that length is a bound.
    """
    from riskloom.operators.rank import global_rank

    e = cut(connects.select("src", "dst").where("src <> dst").distinct())
    value = cut(asset_risk.select(F.col("asset_id").alias("node"), F.col("direct_risk").alias("_v")))
    entries = cut(assets.where(F.lower("zone").isin(*C.ENTRY_ZONES)).select(F.col("asset_id").alias("node")).distinct())
    targets = cut(assets.where(F.lower("criticality").isin("critical", "high")).select(F.col("asset_id").alias("node")).distinct())
    n, n_edges, nodes = entries.count(), e.count(), e.select("dst").distinct().count()
    block = 64 * WORDS
    numbered = cut(global_rank(entries, [F.col("node")], "_i", n).select("node", (F.col("_i") - 1).cast("long").alias("_i")).withColumn("block", F.floor(F.col("_i") / block)))
    names = numbered.select("_i", F.col("node").alias("entry"))
    ways = e.groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("_to"))
    ways = F.broadcast(cut(ways)) if n_edges <= MANY_EDGES else cut(ways)
    bounds = _walk_sums(e, entries, value)
    most_of = {}
    order = [F.desc(F.floor(F.col("path_risk") * 1e6 + 0.5)), F.col("entry"), F.col("target")]
    top, least = None, None
    each = max(1, pairs_a_round // max(1, nodes) // block)
    blocks = -(-n // block)
    for first in range(0, blocks, each):
        mine = numbered.where(F.col("block").between(first, first + each - 1)).repartitionByRange(min(each, blocks - first), "block")
        folder = new_folder(e.sparkSession, "hops")
        levels = _hops_of(mine, ways, max_hops, folder)
        for hops in range(len(levels) - 1, 0, -1):
            if hops not in most_of:
                most_of[hops] = bounds(hops).join(targets, "node", "left_semi").agg(F.max("most")).first()[0]
            if most_of[hops] is None or least is not None and most_of[hops] < least:
                continue
            ends = levels[hops].join(targets, "node", "left_semi").join(bounds(hops), "node")
            bits = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
            held = ends.agg(F.sum(reduce(Column.__add__, [F.bit_count(f"f{w}") for w in range(WORDS)]))).first()[0] or 0
            # of many pairs, the first few by their bound say what the others must reach
            for some in (100 * top_n, None) if least is None and held > FEW_ROWS else (None,):
                may = ends if least is None else ends.where(F.col("most") >= least)
                if some:
                    may = may.orderBy(F.desc("most"), "node", "block").limit(-(-some // 8))
                pairs = may.withColumn("_bit", bits).withColumn("_i", F.col("block") * block + F.col("_bit")).where(_has_entry()).select("block", "_i", F.col("node").alias("target"))
                got = _sums_back(pairs, hops, levels, e, value, bounds, least).join(names, "_i").select("entry", "target", F.lit(hops).alias("hops"), "path_risk")
                both = got if top is None else top.unionByName(got).dropDuplicates(["entry", "target"])
                top = cut(both.orderBy(*order).limit(top_n))
                full = top.agg(F.count(F.lit(1)), F.min("path_risk")).first()
                least = full[1] - 1e-5 if full[0] == top_n else None  # sums are compared at six digits
        drop_folder(e.sparkSession, folder)
    if top is None:
        node = e.schema["src"].dataType
        return e.sparkSession.createDataFrame([], T.StructType([T.StructField("entry", node), T.StructField("target", node), T.StructField("hops", T.IntegerType()), T.StructField("path_risk", T.DoubleType())]))
    return top.orderBy(*order)


def simple_paths(edges: DataFrame, source, target, max_length: int = 5) -> DataFrame:
    """All simple directed paths of at most ``max_length`` edges between two nodes.

    A path grows only along edges from whose end the target is still within the hops that are left, by its distance against the edges.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    near = e.where(F.col("dst") == target).select(F.col("dst").alias("node"), F.lit(0).alias("left")).distinct()
    last = near
    for n in range(1, max_length):
        last = e.join(last.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        last = cut(last.join(near.select("node"), "node", "left_anti").withColumn("left", F.lit(n)))
        near = near.unionByName(last)
    e = cut(e.join(near.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "left"))
    found = None
    frontier = e.where((F.col("src") == source) & (F.col("left") < max_length)).select("dst", F.array("src", "dst").alias("path"))
    for n in range(1, max_length + 1):
        done = frontier.where(F.col("dst") == target).select(F.lit(n).alias("hops"), "path")
        found = done if found is None else found.unionByName(done)
        step = frontier.where(F.col("dst") != target).withColumnRenamed("dst", "src").join(e.where(F.col("left") < max_length - n), "src")
        frontier = step.where(~F.array_contains("path", F.col("dst"))).select("dst", F.concat("path", F.array("dst")).alias("path"))
    return found


def risk_trend(history: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """For each key its current value, mean of the last 7, slope over the last 5 (0 under 3 values) and acceleration: the mean step of the last 3 less that of the 2 before (0 under 5)."""
    back = Window.partitionBy(key).orderBy(*[F.desc(x) for x in order])
    h = history.withColumn("_n", F.row_number().over(back)).where("_n <= 7")
    x = -F.col("_n").cast("double")
    recent = F.col("_n") <= 5
    v = lambda n: F.max(F.when(F.col("_n") == n, F.col(value)))
    n = F.count(F.lit(1))
    acceleration = (v(1) - v(3)) / 2 - (v(4) - v(5))
    return h.groupBy(key).agg(
        v(1).alias("current"),
        F.avg(value).alias("mean_7"),
        F.when(n >= 3, F.regr_slope(F.when(recent, F.col(value)), F.when(recent, x))).otherwise(d(0)).alias("slope_5"),
        F.when(n >= 5, acceleration).otherwise(d(0)).alias("acceleration"),
    )


def what_if(df: DataFrame, action: str, factor: float = 0.5, horizons: tuple[int, ...] = (7, 30, 90), matrix: tuple = C.BASE_TPM) -> DataFrame:
    """Risk before and after ``patch`` (all mass to 5), ``mitigate`` (2 and 3 to 4) or ``isolate`` (2 and 3 times factor, the rest to 4), and the forecast from there.

    The matrix is the same for all rows, so a horizon's risk is one dot product of the distribution with P^h times the state risks, worked out once on the driver.
    """
    import numpy as np

    from riskloom.operators.markov import state_risk

    df = df.withColumn("risk_before", state_risk())
    s = [F.col(f"s{i}") for i in range(6)]
    f = min(1.0, max(0.0, factor))
    if action == "patch":
        new = [d(0)] * 5 + [d(1)]
    elif action == "mitigate":
        new = [s[0], s[1], d(0), d(0), s[4] + s[2] + s[3], s[5]]
    elif action == "isolate":
        new = [s[0], s[1], s[2] * f, s[3] * f, s[4] + (s[2] + s[3]) * (1 - f), s[5]]
    else:
        raise ValueError(f"unknown action {action!r}: patch, mitigate or isolate")
    total = new[0]
    for x in new[1:]:
        total = total + x
    df = df.withColumns({f"_n{i}": F.when(total > 0, x / total).otherwise(x) for i, x in enumerate(new)})
    df = df.withColumns({f"s{i}": F.col(f"_n{i}") for i in range(6)}).drop(*[f"_n{i}" for i in range(6)])
    p = np.array(matrix, float)
    p = p / p.sum(1, keepdims=True)
    later = {}
    for h in horizons:
        weights = np.linalg.matrix_power(p, h) @ np.array(C.STATE_RISK)
        later[f"risk_{h}"] = sum((F.col(f"s{i}") * float(w) for i, w in enumerate(weights)), d(0))
    return df.withColumn("risk_after", state_risk()).withColumns(later)


