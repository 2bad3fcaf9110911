"""The registered queries call their operators with the reference's sizes."""

import os

import pytest

from riskloom.operators import graph, ml, text
from riskloom.plans import registry

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("query, module, name, sizes", [("betweenness", graph, "betweenness", {"radius": 3}), ("svd_embed", text, "svd_embedding", {"dim": 128}), ("elp_gbt", ml, "GBTClassifier", {"maxIter": 300, "maxDepth": 6}), ("isa_gbt", ml, "GBTRegressor", {"maxIter": 300, "maxDepth": 5}), ("acc_rf", ml, "RandomForestClassifier", {"numTrees": 200, "maxDepth": 8})])
def test_query_has_the_reference_sizes(spark, monkeypatch, query, module, name, sizes):
    import inspect

    shape = inspect.signature(getattr(module, name))
    got = {}

    def record(*args, **kwargs):
        bound = shape.bind(*args, **kwargs)
        bound.apply_defaults()
        got.update(bound.arguments.get("kwargs", {}), **{k: v for k, v in bound.arguments.items() if k != "kwargs"})
        raise Called

    monkeypatch.setattr(module, name, record)
    with pytest.raises(Called):
        registry.queries()[query](spark, SF)
    assert {k: got[k] for k in sizes} == sizes
