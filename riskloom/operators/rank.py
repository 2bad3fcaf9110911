"""Ranking of remediation items by several criteria. Every order has an explicit tie-break: the previous rank, then the key.

Ranks are dense positions 1..n. ``global_rank`` gives them without a single-task sort: rows are range-partitioned by the order, numbered
inside each partition, and each partition's offset is the count of rows before it - one number a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions.lineage import HOPS_A_CUT, cut, saved
from riskloom.functions.scalar import d

EXACT_WINDOW_ROWS = 200_000  # up to here one sort in one task is the faster way


def global_rank(df: DataFrame, order: list[Column], name: str, rows: int | None = None) -> DataFrame:
    if rows is not None and rows <= EXACT_WINDOW_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    # read twice, and a second sampling of the ranges could deal otherwise
    dealt = saved(dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    counts = dealt.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(counts.select("_part", "_before")), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("int")).drop("_part", "_in", "_before")


def pareto_front(items: DataFrame, risk: str, cost: str) -> DataFrame:
    """Column ``dominated``: is another item at least as good on both and better on one (more risk, less cost)?

    Items are first reduced to the least cost of each distinct risk. What lies above a risk is a running minimum in two steps: inside range
    partitions of the risk, and over the partitions' own least costs, one number each.
    """
    by_risk = items.groupBy(risk).agg(F.min(cost).alias("_own"))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(by_risk.repartitionByRange(n, F.desc(risk)).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(F.desc(risk)).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.min("_own").alias("_least"))
    parts = parts.select("_part", F.min("_least").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    above = dealt.withColumn("_in", F.min("_own").over(inside)).join(F.broadcast(parts), "_part").select(risk, "_own", F.least("_in", "_base").alias("_above"))
    out = items.join(above, risk)
    return out.withColumn("dominated", F.coalesce(F.col("_above") <= F.col(cost), F.lit(False)) | (F.col("_own") < F.col(cost))).drop("_own", "_above")


def pareto_layers(items: DataFrame, risk: str, cost: str, max_layers: int | None = None) -> DataFrame:
    """R1 by definition: column ``front`` from 1, each layer's front peeled off the rest until nothing is left: a round of jobs for every layer.

    What is left after ``max_layers`` rounds, if given, gets its layers from ``pareto_chain``, numbered on from there.
    """
    rest, out, layer = items, None, 1
    while max_layers is None or layer <= max_layers:
        marked = cut(pareto_front(rest, risk, cost))
        front = marked.where("not dominated").drop("dominated").withColumn("front", F.lit(layer))
        out = front if out is None else out.unionByName(front)
        rest = marked.where("dominated").drop("dominated")
        if rest.isEmpty():
            return out
        layer += 1
        if layer % HOPS_A_CUT == 0:
            out = cut(out)
    deeper = pareto_chain(rest, risk, cost).withColumn("front", F.col("front") + (layer - 1))
    return deeper if out is None else out.unionByName(deeper)


CHAIN_POINTS = 1_000_000  # distinct points that one task sorts


def pareto_chain(items: DataFrame, risk: str, cost: str, points_each: int = CHAIN_POINTS) -> DataFrame:
    """The same layers in one pass, by a patience sort of the distinct (risk, cost) points.

    Sorted by falling risk, then cost, an item's layer is one more than the longest chain that dominates it; the layers' least costs stay sorted, so
    each point needs one binary search. The points are dealt to ranges of about ``points_each``, one after the other; a range hands
    the layers' least costs, one number a layer, to the next. With one cost for all, a layer is a distinct risk, and ranges are numbered at once.
    """
    import bisect

    import pandas as pd

    points = items.select(risk, cost).distinct()
    at = points.agg(F.count(F.lit(1)).alias("n"), F.min(cost).alias("a"), F.max(cost).alias("b")).first()
    if at.n and at.a == at.b:
        return items.join(global_rank(points, [F.desc(risk)], "front", at.n), [risk, cost])
    parts = max(1, -(-at.n // points_each))
    if parts > 1:
        points = cut(points.repartitionByRange(parts, F.desc(risk)).withColumn("_part", F.spark_partition_id()))

    def chain(before: tuple[float, ...]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([risk, cost], ascending=[False, True])
            held, fronts = list(before), []
            for x in pdf[cost]:
                k = bisect.bisect_right(held, x)
                if k == len(held):
                    held.append(x)
                else:
                    held[k] = x
                fronts.append(k + 1)
            return pdf[[risk, cost]].assign(front=fronts)

        return run

    last: list[float] = []  # least cost of each layer so far
    layers = None
    for i in range(parts):
        mine = points.where(F.col("_part") == i).drop("_part") if parts > 1 else points
        got = mine.groupBy().applyInPandas(chain(tuple(last)), f"{risk} double, {cost} double, front int")
        if parts > 1:
            got = cut(got)
            # the last point that entered a layer has its least cost
            order = F.struct((-F.col(risk)).alias("r"), F.col(cost).alias("c"))
            for r in got.groupBy("front").agg(F.max_by(cost, order).alias("c")).orderBy("front").collect():
                last[r.front - 1 : r.front] = [r.c]
        layers = got if layers is None else layers.unionByName(got)
    return items.join(layers, [risk, cost])


def cost_benefit(items: DataFrame, risk: str, cost: str) -> DataFrame:
    """R2."""
    return items.withColumn("benefit_ratio", F.col(risk) / F.greatest(F.col(cost), d(0.01)))


def urgency(items: DataFrame, risk: str, kev: str, exploit: str, velocity: str) -> DataFrame:
    """Velocity in days, negative where unknown."""
    u = F.col(risk) * F.when(F.col(kev), 1.5).otherwise(1.0) * F.when(F.col(exploit), 1.3).otherwise(1.0)
    return items.withColumn("urgency", u * F.when(F.col(velocity) >= 0, F.greatest(d(1), d(2) - F.col(velocity) / 30)).otherwise(d(1)))


def topsis_criteria(weights: dict[str, float] | None) -> dict[str, tuple[float, bool]]:
    """Name to (weight, benefit?); a name with "cost" or "time_exposure" is a cost."""
    chosen = weights or C.TOPSIS_DEFAULT
    return {k: (w, "cost" not in k and "time_exposure" not in k) for k, w in chosen.items()}


def topsis(items: DataFrame, criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Closeness to the ideal; two small aggregates (extremes; norms) meet the rows by a broadcast of one row each.

    A norm's squares are added as decimals, as shares of the largest one: the sum is the same in whatever order rows come, where doubles would move closeness across the digit it is cut at.
    """
    total = sum(w for w, _ in criteria.values()) or 1.0
    ends = items.agg(*[f(k).alias(f"_{n}_{k}") for k in criteria for f, n in ((F.max, "hi"), (F.min, "lo"))])
    ends = ends.withColumns({f"_top_{k}": F.greatest(F.abs(F.col(f"_hi_{k}")), F.abs(F.col(f"_lo_{k}"))) for k in criteria})
    share = lambda k: F.col(k) / F.nullif(F.col(f"_top_{k}"), d(0))
    sums = items.crossJoin(F.broadcast(ends)).agg(*[F.sum((share(k) * share(k)).try_cast("decimal(28,18)")).cast("double").alias(f"_norm_{k}") for k in criteria])
    norm = lambda k: F.col(f"_top_{k}") * F.sqrt(f"_norm_{k}")
    known = ends.crossJoin(F.broadcast(sums)).withColumns({f"_norm_{k}": F.when(F.col(f"_top_{k}") == 0, 1.0).otherwise(norm(k)) for k in criteria})
    scale = lambda x, k: F.col(x) / F.col(f"_norm_{k}") * (criteria[k][0] / total)
    # scaling keeps the order, so the extremes are scaled as the rows are
    known = known.withColumns({f"_{n}_{k}": scale(f"_{n}_{k}", k) for k in criteria for n in ("hi", "lo")})
    scaled = items.crossJoin(F.broadcast(known)).withColumns({f"_v_{k}": scale(k, k) for k in criteria})
    far = lambda side: F.sqrt(sum((((F.col(f"_v_{k}") - F.col(f"_{'hi' if good == side else 'lo'}_{k}")) * (F.col(f"_v_{k}") - F.col(f"_{'hi' if good == side else 'lo'}_{k}"))) for k, (_, good) in criteria.items()), d(0)))
    best, worst = far(True), far(False)
    out = scaled.withColumn("closeness", worst / (best + worst + 1e-12))
    return out.drop(*[x for x in out.columns if x.startswith(("_norm_", "_v_", "_hi_", "_lo_", "_top_"))])


def ensemble(items: DataFrame, ranks: list[str], method: str = "rank_average", weights: list[float] | None = None, n: int | None = None) -> DataFrame:
    """One score from several ranks, lower is better; a missing rank counts as n."""
    n = n if n is not None else items.count()
    r = [F.coalesce(F.col(x), F.lit(n)).cast("double") for x in ranks]
    if method == "rank_average":
        score = sum(r[1:], r[0]) / len(r)
    elif method == "rank_min":
        score = F.least(*r)
    elif method == "weighted":
        w = weights or [1 / len(r)] * len(r)
        score = sum((x * y for x, y in zip(r[1:], w[1:])), r[0] * w[0])
    else:
        raise ValueError(f"unknown method {method!r}: rank_average, rank_min or weighted")
    return items.withColumn("ensemble_score", score)


def pipeline(items: DataFrame, key: str = "pair_key", risk: str = "composite_risk", cost: str = "remediation_cost", weights: dict[str, float] | None = None, method: str = "rank_average", keep: list[str] | None = None) -> DataFrame:
    """Pareto, cost-benefit, time, TOPSIS, ensemble; each rank breaks the next one's ties.

    All criteria come first, at nine digits, and are written once; the ranks are numbered from there. ``keep``: the columns of the items that come back,
    without it all and the criteria; what is not kept is dropped as soon as the rank that needs it has its numbers.
    """
    i = topsis(urgency(cost_benefit(items, risk, cost), risk, "is_in_kev", "has_public_exploit", "exploit_velocity_days"), topsis_criteria(weights))
    i = i.withColumns({f"_{c}": F.floor(F.col(c) * 1e9 + 0.5) for c in ("benefit_ratio", "urgency", "closeness")})
    if keep is not None:
        i = i.select(*dict.fromkeys([*keep, key, risk, cost, "_benefit_ratio", "_urgency", "_closeness"]))
    i = saved(i)
    n = i.count()
    i = pareto_chain(i, risk, cost)
    passing = set() if keep is None else {key, risk, cost, "front"} - set(keep)
    i = i.drop(*passing & {cost})
    i = global_rank(i, [F.col("front"), F.desc(risk), F.col(key)], "pareto_rank", n).drop(*passing)
    i = global_rank(i, [F.desc("_benefit_ratio"), F.col("pareto_rank")], "cost_benefit_rank", n).drop("_benefit_ratio")
    i = global_rank(i, [F.desc("_urgency"), F.col("cost_benefit_rank")], "time_rank", n).drop("_urgency")
    i = global_rank(i, [F.desc("_closeness"), F.col("time_rank")], "topsis_rank", n).drop("_closeness")
    i = ensemble(i, ["pareto_rank", "cost_benefit_rank", "time_rank", "topsis_rank"], method, n=n)
    return global_rank(i, [F.col("ensemble_score"), F.col("topsis_rank")], "final_rank", n)
