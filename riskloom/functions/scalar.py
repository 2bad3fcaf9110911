"""Scalar functions of the risk model as Column expressions; all run inside the JVM's generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import constants as C

c = lambda x: F.col(x) if isinstance(x, str) else x
d = lambda x: F.lit(float(x))


def q6(x: Column) -> Column:
    """Six digits without the ties on which rounding modes differ."""
    return F.floor((x + 1e-9) * 1e6) / 1e6


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(d(low), F.least(d(high), x))


# ---------------------------------------------------------------- strings


def cpe_canonical(cpe: Column) -> Column:
    """``vendor:product:version`` of a CPE 2.3 or 2.2 name (version * where 2.2 has none), else the lower-cased input."""
    new, old = r"^cpe:2\.3:[aoh]:([^:]+):([^:]+):([^:]+)", r"^cpe:/[aoh]:([^:]+):([^:]+)(?::([^:]+))?"
    low = F.lower(F.trim(cpe))
    part = lambda rx, i: F.regexp_extract(low, rx, i)
    version = F.when(part(old, 3) == "", F.lit("*")).otherwise(part(old, 3))
    return F.when(low.rlike(new), F.concat_ws(":", part(new, 1), part(new, 2), part(new, 3))).when(low.rlike(old), F.concat_ws(":", part(old, 1), part(old, 2), version)).otherwise(low)


def split_list(x: Column, sep: str, prefix: str = "") -> Column:
    """Trimmed, non-empty members of a separated list, with a given prefix if any."""
    parts = F.transform(F.split(x, sep), lambda v: F.trim(v))
    return F.filter(parts, lambda v: (v != "") & v.startswith(prefix))


def pair_key(vuln: Column, asset: Column) -> Column:
    return F.concat(vuln.cast("string"), F.lit("::"), asset.cast("string"))


def split_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "::", 2)
    return parts[0], F.get(parts, F.lit(1))


def joined_text(parts: list[Column], fallback: Column) -> Column:
    text = F.trim(F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]))
    return F.when(text == "", fallback.cast("string")).otherwise(text)


# ---------------------------------------------------------------- dates


def parse_ts(x: Column) -> Column:
    return x.cast("string").try_cast("timestamp") if hasattr(Column, "try_cast") else F.try_to_timestamp(x)


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, not below 0; null where either is."""
    days = F.timestamp_diff("MICROSECOND", a, b) / 86400e6
    return F.when(days >= 0, days).when(days < 0, d(0))  # greatest() would turn null into 0


# ---------------------------------------------------------------- numbers


def safe_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), d(default))


def blend(base: Column | float, x: Column, weight: float) -> Column:
    """Convex blend, held to 0..1."""
    base = d(base) if isinstance(base, float) else base
    return clamp(base * (1 - weight) + x * weight)


def confidence(raw: Column, freshness: Column, age_days: Column, half_life: float = C.CONFIDENCE_HALF_LIFE) -> Column:
    """Confidence after the data's staleness and the model's age; 0.05 to 1."""
    decay = F.greatest(d(0.05), F.exp(d(-math.log(2) / half_life) * age_days))
    return clamp(raw * clamp(freshness, 0.05, 1.0) * decay, 0.05, 1.0)


def residual_risk(state: Column, days: Column) -> Column:
    """What is left of the risk so many days after mitigation (state 4) or remediation (5); null for other states."""
    out = F.lit(None).cast("double")
    for s, (base, half) in C.RESIDUAL.items():
        out = F.when(state == s, d(base) * F.exp(d(-math.log(2) / half) * days)).otherwise(out)
    return out


def time_to_negligible(state: Column, threshold: float) -> Column:
    out = F.lit(None).cast("double")
    for s, (base, half) in C.RESIDUAL.items():
        days = 0.0 if base <= threshold else -math.log(threshold / base) / (math.log(2) / half)
        out = F.when(state == s, d(days)).otherwise(out)
    return out


def epss_estimate(cvss: Column, exploit: Column, kev: Column) -> Column:
    return clamp(F.coalesce(cvss, d(5.0)) / 10 * 0.5 + F.when(exploit, 0.25).otherwise(0.0) + F.when(kev, 0.30).otherwise(0.0))


def maturity_score(x: Column) -> Column:
    out = d(0.0)
    for name, v in reversed(C.MATURITY.items()):
        out = F.when(F.lower(x) == name, v).otherwise(out)
    return out


def tier_of_cvss(cvss: Column) -> Column:
    """0 to 3: low, medium, high, critical; a border belongs to the upper band."""
    return F.when(cvss >= 9, 3).when(cvss >= 7, 2).when(cvss >= 4, 1).otherwise(0)


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 0.8, "critical").when(risk >= 0.6, "high").when(risk >= 0.3, "medium").otherwise("low")


def tier_number(tier: Column, table: dict[str, float], missing: float, unknown: float) -> Column:
    out = d(unknown)
    for name, v in reversed(table.items()):
        out = F.when(F.lower(tier) == name, v).otherwise(out)
    return F.when(tier.isNull(), d(missing)).otherwise(out)


def geometric_mean(*xs: Column) -> Column:
    product = xs[0]
    for x in xs[1:]:
        product = product * x
    return F.pow(product, d(1 / len(xs)))


def freshness_score(age: Column, threshold: Column) -> Column:
    """Falls to one half at the threshold, then exponentially; 0 if never imported."""
    score = F.when(age <= threshold, 1.0 - age / threshold * 0.5).otherwise(F.exp(-(age - threshold) / threshold) * 0.5)
    return F.when(age.isNull(), d(0)).otherwise(clamp(score))


def ab_bucket(key: Column, buckets: int = 10000) -> Column:
    """SHA-256 of the key as a number, modulo ``buckets``, folded over its hexadecimal digits."""
    digits = F.split(F.sha2(key.cast("string"), 256), "")
    value = F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: (acc * 16 + F.instr(F.lit("0123456789abcdef"), x) - 1) % buckets)
    return value


# ---------------------------------------------------------------- state distributions (arrays of six)


def renormalised(dist: Column) -> Column:
    """Clipped to 0..1 and summing to 1; unchanged where the sum is 0."""
    clipped = F.transform(dist, lambda x: clamp(x))
    total = F.aggregate(clipped, d(0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(clipped, lambda x: x / total)).otherwise(clipped)


def padded(dist: Column, n: int = 6) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(dist, i), d(0)))


def entropy(dist: Column) -> Column:
    """Shannon entropy in nats; shares up to 1e-12 count as 0."""
    return -F.aggregate(dist, d(0), lambda a, p: a + F.when(p > 1e-12, p * F.ln(p)).otherwise(0.0))


def argmax(dist: Column) -> Column:
    """Index of the first largest component, from 0."""
    return (F.array_position(dist, F.array_max(dist)) - 1).cast("int")


def dot(dist: Column, weights: tuple[float, ...] = C.STATE_RISK) -> Column:
    return F.aggregate(F.zip_with(dist, F.array(*[d(w) for w in weights]), lambda a, b: a * b), d(0), lambda a, x: a + x)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), d(0), lambda s, x: s + x)
