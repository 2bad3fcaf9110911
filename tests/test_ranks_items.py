"""The items of the ensemble are worked out once, and read from there for norms, extremes and ranks."""

from riskloom.plans import q_rank


def test_items_are_written_before_the_ranks(spark, monkeypatch):
    scans = []

    def topsis(items, criteria, real=q_rank.K.topsis):
        scans.append(items._jdf.queryExecution().optimizedPlan().toString())
        return real(items, criteria)

    monkeypatch.setattr(q_rank.K, "topsis", topsis)
    q_rank._ranks(spark, "/root/testdata/sf0.001")
    assert len(scans) == 1 and "Aggregate" not in scans[0] and "Join" not in scans[0]
