"""Commits and imports under crashes, repeats, conflicts and any order."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import commits, importing
from riskloom.sources import readers

NOW = "2024-03-01 00:00:00"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string")


def seen(spark, folder, **at):
    got = {t: commits.read(spark, folder, t, **at) for t in ("snapshot", "history")}
    return {t: sorted(map(tuple, x.collect())) if x is not None else None for t, x in got.items()}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["first table", "second table", "manifest written", "manifest named", "none"])
def test_a_crash_leaves_the_old_or_the_new_version_whole(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    assert commits.manifest(spark, folder) is None and commits.read(spark, folder, "snapshot") is None
    commits.commit(spark, folder, "one", replace={"snapshot": frame(spark, (1, "a"))}, append={"history": frame(spark, (1, "a"))})
    old = seen(spark, folder)
    second = frame(spark, (1, "b"), (2, "c"))
    writes = []
    if step in ("first table", "second table"):
        write = type(second.write).parquet
        monkeypatch.setattr(type(second.write), "parquet", lambda self, path, *a: (writes.append(path), write(self, path, *a), (_ for _ in ()).throw(Crash()) if len(writes) == (1 if step == "first table" else 2) else None)[0])
    elif step == "manifest written":  # the draft is there, its name is not
        monkeypatch.setattr(commits, "_publish", lambda s, f, v, text: ((tmp_path / "commits" / ".draft").write_text(text[:10]), (_ for _ in ()).throw(Crash())))
    elif step == "manifest named":
        publish = commits._publish
        monkeypatch.setattr(commits, "_publish", lambda *a: (publish(*a), (_ for _ in ()).throw(Crash())))
    crashed = False
    try:
        commits.commit(spark, folder, "two", replace={"snapshot": second}, append={"history": second})
    except Crash:
        crashed = True
    monkeypatch.undo()
    new = {"snapshot": [(1, "b"), (2, "c")], "history": [(1, "a"), (1, "b"), (2, "c")]}
    assert crashed == (step != "none") and seen(spark, folder) == (new if step in ("none", "manifest named") else old)
    if step not in ("none", "manifest named"):
        commits.commit(spark, folder, "two", replace={"snapshot": second}, append={"history": second})
    assert seen(spark, folder) == new and seen(spark, folder, cycle="one") == old and seen(spark, folder, version=1) == old
    commits.compact(spark, folder, "history")
    assert seen(spark, folder) == new and len(commits.manifest(spark, folder)["tables"]["history"]["parts"]) == 1
    commits.vacuum(spark, folder, keep=1)
    assert seen(spark, folder) == new and commits.versions(spark, folder) == [3]
    assert sorted(p.name for t in (tmp_path / "data").iterdir() for p in t.iterdir()) == sorted(p.rpartition("/")[2] for t in commits.manifest(spark, folder)["tables"].values() for p in t["parts"])


def test_of_two_writers_on_a_version_one_fails(spark, tmp_path):
    folder = str(tmp_path)
    commits.commit(spark, folder, "a", replace={"snapshot": frame(spark, (1, "a"))})
    commits.commit(spark, folder, "b", append={"history": frame(spark, (1, "b"))}, base=1)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, folder, "c", append={"history": frame(spark, (9, "lost"))}, base=1)
    assert seen(spark, folder) == {"snapshot": [(1, "a")], "history": [(1, "b")]}
    with pytest.raises(KeyError):
        commits.read(spark, folder, "snapshot", version=7)
    with pytest.raises(KeyError):
        commits.read(spark, folder, "snapshot", cycle="none")
    assert commits.history(spark, folder).count() == 3


@pytest.fixture
def feeds(tmp_path):
    """Files that refer to one another, named so that references come before what they refer to."""
    cve = lambda i, **x: {"cve": {"id": f"CVE-{i}", "published": "2024-01-01", "descriptions": [{"lang": "en", "value": f"flaw {i}"}], **x}}
    files = {
        "a_exploitdb.csv": "id,description,date_published,codes\n7,boom,2024-02-01,CVE-2;CVE-9\n8,late,2024-02-01,CVE-5\n",
        "b_cmdb.csv": "asset_id,hostname,connects_to\nh1,web,h2\n",
        "c_cmdb.csv": "asset_id,hostname,os\nh2,db,\nh1,www,linux\n",
        "d_nvd.json": json.dumps({"vulnerabilities": [cve(1), cve(2)]}),
        "e_nvd.json": json.dumps([cve(5)]),
        "f_kev.json": "not json",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return {n: str(tmp_path / n) for n in files}


def graph(spark, folder):
    n = {r.node_id: (r.node_type, dict(r.attrs or {})) for r in importing.stored(spark, folder, "nodes").collect()}
    return n, {tuple(r) for r in importing.stored(spark, folder, "edges").collect()}


def test_imports_add_up_to_the_import_of_all_files(spark, tmp_path, feeds):
    good = [p for n, p in feeds.items() if not n.startswith("f_")]
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    importing.import_new(spark, one, good, NOW)
    steps = [importing.import_new(spark, many, [p], NOW).first() for p in good]
    assert graph(spark, many) == graph(spark, one) and all(s.success and s.error is None for s in steps)
    nodes, edges = graph(spark, one)
    assert nodes["h1"][1]["hostname"] == "www" and nodes["CVE-2"][1]["has_public_exploit"] == "true" and "CVE-9" not in nodes
    assert {e for e in edges if e[2] == "REFERENCES"} == {("CVE-2", "EDB-7", "REFERENCES"), ("CVE-5", "EDB-8", "REFERENCES")}
    files, edges_ = readers.import_files(spark, good)
    assert {r.node_id for r in files.collect()} == set(nodes) and {tuple(r) for r in edges_.collect()} == edges
    again = importing.import_new(spark, many, good, NOW).collect()
    assert {r.error for r in again} == {"already imported"} and len(commits.versions(spark, many)) == len(good) and graph(spark, many) == (nodes, edges)
    assert importing.stored(spark, many, "import_log").count() == len(good)


def test_files_that_fail_are_missing_or_repeat(spark, tmp_path, feeds):
    (tmp_path / "z_cmdb.csv").write_text((tmp_path / "b_cmdb.csv").read_text())
    asked = [*feeds.values(), f"{tmp_path}/z_cmdb.csv", f"{tmp_path}/gone_nvd.json", f"{tmp_path}/notes.txt"]
    got = {r.file.rpartition("/")[2]: r for r in importing.import_new(spark, f"{tmp_path}/s", asked, NOW).collect()}
    assert [n for n, r in sorted(got.items()) if not r.success] == ["f_kev.json", "gone_nvd.json", "notes.txt"]
    assert "not found" in got["gone_nvd.json"].error and got["z_cmdb.csv"].error == "already imported" and got["b_cmdb.csv"].nodes_added == 1
    log = importing.stored(spark, f"{tmp_path}/s", "import_log")
    assert log.count() == 5 and log.where("sha256 is null or length(sha256) <> 64").count() == 0


def test_an_import_that_dies_before_its_commit_is_done_again(spark, tmp_path, feeds, monkeypatch):
    folder, path = f"{tmp_path}/s", feeds["b_cmdb.csv"]
    publish = commits._publish
    monkeypatch.setattr(commits, "_publish", lambda *a: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        importing.import_new(spark, folder, [path], NOW)
    assert importing.stored(spark, folder, "nodes").count() == importing.stored(spark, folder, "import_log").count() == 0
    calls = []

    def late(*a):  # another import comes first, once
        if not calls:
            calls.append(1)
            commits_ = commits._publish
            monkeypatch.setattr(commits, "_publish", publish)
            importing.import_new(spark, folder, [feeds["d_nvd.json"]], NOW)
            monkeypatch.setattr(commits, "_publish", commits_)
        publish(*a)

    monkeypatch.setattr(commits, "_publish", late)
    assert importing.import_new(spark, folder, [path], NOW).first().success
    assert set(graph(spark, folder)[0]) == {"h1", "CVE-1", "CVE-2"} and importing.stored(spark, folder, "import_log").count() == 2


def test_an_inbox_is_read_once(spark, tmp_path, feeds):
    inbox, folder = tmp_path / "inbox", f"{tmp_path}/s"
    inbox.mkdir()
    for name in ("b_cmdb.csv", "d_nvd.json"):
        (inbox / name).write_text((tmp_path / name).read_text())
        importing.watch(spark, folder, str(inbox), NOW)
    importing.watch(spark, folder, str(inbox), NOW)
    assert set(graph(spark, folder)[0]) == {"h1", "CVE-1", "CVE-2"} and importing.stored(spark, folder, "import_log").count() == 2


def test_large_feeds_give_the_same_records(spark, tmp_path, monkeypatch):
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": [{"cve": {"id": f"CVE-{i}", "descriptions": [{"lang": "en", "value": 'a "quoted" } brace'}]}} for i in range(50)]}))
    path = str(tmp_path / "nvd.json")
    small = sorted(map(str, readers.nvd(spark, path)[0].collect()))
    monkeypatch.setattr(readers, "RANGE_BYTES", 100)
    monkeypatch.setattr(importing, "WHOLE_BYTES", 100)
    assert sorted(map(str, readers.nvd(spark, path)[0].collect())) == small
    assert importing.checksums(spark, [path])[path].startswith("sum:")
    assert importing.import_new(spark, f"{tmp_path}/s", [path], NOW).first().nodes_added == 50
    assert importing.import_new(spark, f"{tmp_path}/s", [path], NOW).first().error == "already imported"
