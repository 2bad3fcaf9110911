"""op10: a worse match is found on either side of a better one."""

import pytest

pytest.importorskip("riskloom.llm")

from riskloom.llm import license_scan


def test_worse_match_before_a_better_one():
    s = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES)
    assert s.fuzzy(" the apache licence apache license ") == [("apache~", 5, 19, 1), ("apache~", 20, 34, 0)]
    assert s.fuzzy(" apache license apache licence ") == [("apache~", 1, 15, 0), ("apache~", 16, 30, 1)]
    assert [x[1:] for x in s.fuzzy(" mit licence mit license mit licens x ")] == [(1, 12, 1), (13, 24, 0), (25, 35, 1)]


def test_label_of_the_worse_match_is_kept(spark):
    r = license_scan.scan(spark.createDataFrame([(1, "the Apache Licence, Apache License")], "doc_id long, text string")).first()
    assert r.labels == "apache,apache~" and [(x.word, x.edits) for x in r.spans] == [(1, 1)]
