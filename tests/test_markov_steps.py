"""Ten steps of every row's chain are products with its vector, not powers of its matrix as columns."""

from pyspark.sql import functions as F

from riskloom.operators import markov as M
from riskloom.plans import registry


def test_steps_equal_powers_and_the_query_has_no_powers(spark, monkeypatch):
    rows = spark.range(40).select("id", (F.col("id") / 40).alias("e"), (F.col("id") % 11).cast("double").alias("m"), (F.col("id") % 4 / 4).alias("c"))
    df = M.modulated(M.start(rows, 1), "e", "m", "c")
    want = {r.id: [r[s] for s in M.PI] for r in M.evolved(M.with_powers(df, 10), 10).collect()}
    got = {r.id: [r[s] for s in M.PI] for r in M.walked(df, 10).collect()}
    assert want.keys() == got.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(want[k], got[k]))

    def powers(*args):
        raise AssertionError("powers as columns")

    monkeypatch.setattr(M, "with_powers", powers)
    registry.queries()["evolve_k"](spark, "/root/testdata/sf0.001")
