"""Term weights: texts move once, by key; rows of (key, term) are not shuffled."""

import math
import re

import pytest

from riskloom.operators import text


def test_terms_of_a_document_are_counted_where_its_texts_lie(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (1, "cc aa"), (3, None)], "k int, t string")
    out = text.tfidf(docs, "k", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(k#\d+, term#", plan) and not re.search(r"hashpartitioning\(term#\d+, k#", plan)
    idf = {"aa": math.log(4 / 2) + 1, "bb": math.log(4 / 3) + 1, "cc": math.log(4 / 3) + 1}
    raw = {1: {"aa": (1 + math.log(3)) * idf["aa"], "bb": idf["bb"], "cc": idf["cc"]}, 2: {"bb": idf["bb"], "cc": idf["cc"]}}
    got = {(r.k, r.term): r.weight for r in out.collect()}
    want = {(k, t): w / math.sqrt(sum(x * x for x in ws.values())) for k, ws in raw.items() for t, w in ws.items()}
    assert got == pytest.approx(want)
