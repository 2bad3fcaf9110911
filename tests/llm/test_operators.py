"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, language_id, license_scan, mixing, packing, stream_dedup, substring_dedup, token_file, url_filter
from riskloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(20))
    out = []
    for i in range(n):
        body = [word() for _ in range(rng.choice([0, 1, 5, 12, 13, 14, 60, 200]))]
        if i % 3 == 0:
            body.insert(len(body) // 2, passage)
        out.append((i, rng.choice([" ", "  ", "\n"]).join(body), "en" if i % 2 else "de", f"s{i % 3}", "x"))
    out += [(100, None, None, None, None), (101, "", "en", "s0", ""), (102, out[5][1], "en", "s1", ""), (103, "ha " * 40, "en", "s0", ""), (104, "ha " * 55 + passage, "en", "s0", ""), (105, "! 12 ?", "en", "s0", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def test_substring_dedup_equals_brute_force(docs):
    texts = {r[0]: WORD.findall(r[1] or "") for r in rows()}
    first = {}
    for i in sorted(texts):
        for a in range(len(texts[i]) - 12):
            first.setdefault(tuple(texts[i][a : a + 13]), i)
    for r in substring_dedup.deduplicate(docs).collect():
        w = texts[r.doc_id]
        gone = {a + k for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < r.doc_id for k in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()), r.doc_id


def test_stream_dedup(docs):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    got = stream_dedup.deduplicate(docs).collect()
    assert len(got) == len(rows())
    for r, t in zip(sorted(got), sorted(rows(), key=lambda r: r[0])):
        g = groups[t[1] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
    kept = stream_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, 2, 64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    for i, text, *_ in rows():
        got = b"".join(p.ids for p in sorted(by_doc[i], key=lambda p: p.start))
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [2]
    fills = []
    for s in sorted(by_seq):
        at = 0
        for o, n in sorted(by_seq[s]):
            assert o == at
            at += n
        fills.append(at)
    assert all(f == 64 for f in fills[:-1]) and sorted(by_seq) == list(range(len(fills)))


def test_token_file_round_trip_and_random_access(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = str(tmp_path / "codes")
    token_file.write_tokens(docs, out, path, 0, shard_tokens=500)
    got = sorted(token_file.read_tokens(spark, out).collect())
    start = 0
    for r, (i, text, *_) in zip(got, sorted(rows(), key=lambda r: r[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    shard = token_file.Shard(spark.read.parquet(out).orderBy("part", "shard").first().payload)
    assert [shard.token(i) for i in range(shard.n)] == shard.all().tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library_on_odd_texts(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from riskloom.llm.common import column_bytes
    from riskloom.llm.encoder import encoded

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "B", "é", "É", "Σ", "ς", "İ", "'s", "'", "1", "½", ".", ",", "!", "…", "×", "-", "漢", "́", "🙂", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "the", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, "", " "]
    texts += [f"{x}<|endoftext|>{y}<|startoftext|>{x}" for x in parts for y in parts]
    t = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = [ids[p : q - 1].tolist() for a, b, ids, at in encoded(column_bytes(pa.array(texts)), tokenizer_path(name), 7) for p, q in zip(at[:-1], at[1:])]
    assert got == want


def test_mixture_meets_targets(docs):
    sizes, targets, draws = mixing.mixed(docs, shards=5, block_words=64)
    t = {r.source: r for r in targets.collect()}
    total = sum(r.source_size for r in t.values())
    assert abs(sum(r.target for r in t.values()) - 1.5 * total) < 1e-6 or all(r.target == 2 * r.source_size for r in t.values())
    taken, per = Counter(), Counter()
    for r in draws.collect():
        taken[r.source] += r.words
        per[r.doc_id] += r.words
        assert r.shard is not None and 0 <= r.shard < 5
    size = {r.doc_id: r.size for r in sizes.collect()}
    assert all(per[i] <= 2 * size[i] for i in size) and all(abs(taken[s] - r.target) <= 1 for s, r in t.items())


def test_language_id(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    data = [(i, make("abcd") if i % 2 else make("wxyz"), "aa" if i % 2 else "zz") for i in range(80)]
    df = spark.createDataFrame([*data, (900, None, None), (901, "12 !?", "aa"), (902, "wxyzw yzwx", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.predict(df, language_id.learn(df), ["text"]).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in data) and all(0 <= r.score <= 1 for r in out.values())
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "zz"
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0


def test_license_scan(spark):
    data = [(1, "Permission is hereby granted, free of charge, to any pers0n obtaining a copy of this softwre."), (2, "MIT License mit-license; Apache  License"), (3, "admit license"), (4, "the apache licence"), (5, None), (6, "gnu general public license " * 3)]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[1].labels == "mit-notice" and out[1].n_base == 0 and 0 < out[1].score < 1
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].base_labels) == (3, 0, 4, "apache,mit")
    assert out[3].labels == "" and out[4].labels == "apache~" and out[5].n_words == 0 and out[5].first_word is None
    assert (out[6].n_base, out[6].last_word) == (3, 8)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 10))
    v[20:60] = v[20]
    data = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (401, [0.0] * 10), (402, [float("nan")] * 10), (403, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, "vec_id", "embedding", F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 300, 10):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(300), -s))[:5].tolist()
        hits, total = hits + len(set(want) & set(got[q])), total + 5
    assert hits / total >= 0.9 and got[30][:3] == [20, 21, 22] and not set(got) & {400, 401, 402, 403}


def test_url_filter_is_as_of(spark):
    ev = [("domain", "bad.com", "x", "add", "2024-01-10"), ("domain", "bad.com", "x", "drop", "2024-02-10"), ("prefix", "ok.com/p/", "y", "add", "2024-01-01"), ("host", None, "z", "add", "2024-01-01")]
    events = spark.createDataFrame(ev, "kind string, pattern string, category string, action string, effective string").withColumn("effective", F.to_timestamp("effective"))
    caps = [(1, "http://a.BAD.com/q", "2024-01-09"), (2, "http://a.bad.com/q", "2024-01-10"), (3, "http://u@bad.com:80", "2024-02-10"), (4, "https://ok.com/p/1?x", "2024-03-01"), (5, "https://ok.com/px", "2024-03-01"), (6, None, "2024-03-01"), (7, "notbad.com", None)]
    df = spark.createDataFrame(caps, "id int, url string, at string").withColumn("at", F.to_timestamp("at"))
    out = {r.id: (r.blocked, r.categories) for r in url_filter.filter_urls(df, events, "id", "url", "at").collect()}
    assert out == {1: (False, ""), 2: (True, "x"), 3: (False, ""), 4: (True, "y"), 5: (False, ""), 6: (False, ""), 7: (False, "")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert substring_dedup.deduplicate(empty).count() == 0
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json"), 2).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert stream_dedup.deduplicate(empty).count() == 0
    assert mixing.mixed(empty)[2].count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") % 10 == 0).count() == 0
