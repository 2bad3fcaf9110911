"""Records cut by byte ranges equal those of the sequential cutter, wherever a range ends."""

import json
import random
from collections import Counter

import pytest

from riskloom.sources import json_ranges, readers


def document(rng: random.Random, wrapper: str) -> str:
    odd = ['"', "\\", "}", "{", "[", "]", ",", "é", "漢", "😀", "\n", "a", " ", wrapper, '\\"', "}}", ":", " "]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 9)))

    def value(depth: int):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return rng.choice([text(), text(), 1, -2.5e3, True, None, [], {}])
        if kind < 0.7:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {text(): value(depth + 1) for _ in range(rng.randint(0, 3))} | ({wrapper: [1, {"no": 2}]} if rng.random() < 0.3 else {})

    records = [value(0) for _ in range(rng.randint(0, 6))]
    style = {"ensure_ascii": rng.random() < 0.5, "indent": rng.choice([None, None, 1]), "separators": rng.choice([(",", ":"), (" , ", " : ")])}
    if rng.random() < 0.3:
        return json.dumps(records, **style)
    head = {text() + "x": value(1) for _ in range(rng.randint(0, 3))}
    body = head | ({wrapper: records} if rng.random() < 0.85 else {}) | {"later": [1, 2], "z": value(1)}
    return rng.choice(["", "﻿", " \n"]) + json.dumps(body, **style).replace('"wrap"', rng.choice(['"wrap"', '"wr\\u0061p"']), 1 if "wrap" not in json.dumps(head) else 0) + rng.choice(["", "\n", "  "])


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_records_equal_the_sequential_cutter(spark, tmp_path, size):
    rng, want, folder = random.Random(size), Counter(), tmp_path / "feeds"
    folder.mkdir()
    for i in range({1: 4, 7: 8}.get(size, 40)):
        doc = document(rng, "wrap")[: 100_000]
        if size == 1:
            doc = doc if len(doc) < 400 else "[1]"
        (folder / f"{i}.json").write_bytes(doc.encode())
        want.update(json.dumps(json.loads(t)) for t in readers.record_texts(doc.removeprefix("﻿"), "wrap"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size > 1 else "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = Counter(json.dumps(json.loads(r.value)) for r in json_ranges.records(spark, str(folder), "wrap").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == want


@pytest.mark.parametrize("doc", ['"text"', "12", '{"wrap": [1, 2', '{"wrap": ["a]}'])
def test_what_is_no_whole_document_is_an_error(spark, tmp_path, doc):
    (tmp_path / "x.json").write_text(doc)
    with pytest.raises(Exception, match="not a whole JSON"):
        json_ranges.records(spark, str(tmp_path / "x.json"), "wrap").collect()


def test_no_task_holds_a_feed_of_megabytes(spark, tmp_path):
    """A file's bytes and text in Python grow with the file, in every task at once; ranges do not."""
    for i in range(2):
        rows = [{"alert_id": f"al{i}-{j}", "rule_name": "é" * 40} for j in range(40_000)]
        (tmp_path / f"{i}.json").write_text(json.dumps({"alerts": rows}, ensure_ascii=False), encoding="utf-8")
    out = readers.documents(spark, str(tmp_path), "alerts")
    assert "binaryFile" not in out._jdf.queryExecution().executedPlan().toString()
    ids = out.select(readers.get("$.alert_id").alias("id"), readers.get("$.rule_name").alias("name")).where(f"name = '{'é' * 40}'")
    assert ids.distinct().count() == 80_000
