"""Operators and pipeline stages at the edges: hash collisions of old, nulls, repeats, ties, clashing columns, empty tables and very long texts, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("riskloom.llm")

import corpus_pipeline
from riskloom.llm import ann, language_id, license_scan, mixing, ngram_join, packing, stream_dedup, substring_dedup, token_file, url_filter
from riskloom.llm.common import lane
from riskloom.llm.queries import OP9_SQL, tokenizer_path

CLASH = "doc_id long, text string, lang string, source string, score double, lang_pred string, held_out boolean, kept boolean, component_id string, size string, shard int, key string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n: int = 1024) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def library(name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def long_text(n: int = 60_000, seed: int = 4) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n))


def rows(seed: int = 9) -> list[tuple]:
    """Null and repeated ids, equal texts, near copies, empty and very long texts, a hot source."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out, base = [], [[word() for _ in range(rng.choice([5, 8, 40, 90]))] for _ in range(9)]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        out.append((i if i % 9 else None, " ".join(w), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", None])))
    out += [(7, out[3][1], "en", "hot"), (7, out[7][1], "en", "hot"), (7, out[7][1], "en", "hot"), (200, None, None, None), (201, "", "en", "s1"), (202, "12 !? --", "en", "s1"), (205, "end <|endoftext|>  start<|startoftext|> of.<|ENDOFTEXT|>", "en", "s1"), (203, long_text(), "de", "s1"), (204, long_text(), "de", "s1"), (None, None, None, None)]
    return [(*r, 0.5, "x", True, False, "c", "big", 3, "k", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), CLASH)


def same(df, want) -> None:
    assert Counter(map(tuple, df.collect())) == Counter(map(tuple, want))


# ---------------------------------------------------------------- names


def test_names_tell_thue_morse_words_apart():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse())
    for seed in (11, 12, 31, 32, 41):
        for n in (8, 64, 128, 255, 1024):
            ends = np.array([n])
            assert lane(seed).words(a[:n], np.zeros(1, np.int64), ends) != lane(seed).words(b[:n], np.zeros(1, np.int64), ends)
    s = np.array([3, 5], np.uint64)
    bits = np.array([bin(i).count("1") & 1 for i in range(64)])
    assert lane(22).runs(s[bits], np.zeros(1, np.int64), 64) != lane(22).runs(s[1 - bits], np.zeros(1, np.int64), 64)


def test_thue_morse_texts(spark, tmp_path):
    a, b = thue_morse()
    data = [(1, a), (2, b), (3, f"{a} {b}"), (4, " ".join([a] * 13)), (5, " ".join([b] * 13))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    ids = library("word_bpe_49k.json")
    for p in packing.pack(df, tokenizer_path("word_bpe_49k.json"), 2, 100_000).collect():
        assert np.frombuffer(p.ids, "<u4").tolist() == ids(dict(data)[p.doc_id]) + [2]
    ids = library("byte_bpe_50k.json")
    token_file.write_tokens(df, f"{tmp_path}/codes", tokenizer_path("byte_bpe_50k.json"), 0)
    for r in token_file.read_tokens(spark, f"{tmp_path}/codes").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids(dict(data)[r.doc_id]) + [0]
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == {i: i for i, _ in data}
    assert all(r.n_removed == 0 for r in substring_dedup.deduplicate(df).collect())


# ---------------------------------------------------------------- op1


def test_url_filter_paths_keep_case_and_rows_repeat(spark):
    ev = [("prefix", "OK.com/P/", "y", "add", "2024-01-01"), ("prefix", "OK.com/P/", "y", "add", "2024-01-01"), ("domain", "Bad.com", "x", "add", "2024-01-01"), ("domain", "bad.com", "x", "drop", "2024-01-01")]
    events = spark.createDataFrame(ev, "kind string, pattern string, category string, action string, effective string").withColumn("effective", F.to_timestamp("effective"))
    deep = "http://ok.com/P/" + "d/" * 3000
    caps = spark.createDataFrame([(1, "http://OK.com/P/1", "h", 0), (2, "http://ok.com/p/1", "h", 0), (2, "http://ok.com/p/1", "h", 0), (3, deep, "h", 0), (4, "http://bad.com/", "h", 0)], "id int, url string, host string, blocked int").withColumn("at", F.to_timestamp(F.lit("2024-02-01")))
    out = Counter((r.id, r.blocked, r.n_hits) for r in url_filter.filter_urls(caps, events, "id", "url", "at").collect())
    assert out == Counter({(1, True, 1): 1, (2, False, 0): 2, (3, True, 1): 1, (4, False, 0): 1})
    assert url_filter.filter_urls(caps.where("false"), events, "id", "url", "at").count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(caps, events.where("false"), "id", "url", "at").collect())


# ---------------------------------------------------------------- op2


def exact_nearest(ids, v, queries, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[q]
        s[q] = -9
        out[int(ids[q])] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def test_recall_on_many_distinct_vectors_with_a_cluster(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6000, 24))
    v[1000:1700] = v[1000] + 0.02 * rng.normal(size=(700, 24))  # more near copies than are reranked
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    want = exact_nearest(np.arange(6000), v, range(0, 6000, 50))

    def recall(keep, sample):
        got = defaultdict(list)
        for r in ann.nearest(df, "vec_id", "embedding", F.col("id") % 50 == 0, keep=keep, sample=sample).collect():
            got[r.query_id].append(r.vec_id)
        return np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want])

    assert recall(320, 2048) == 1.0 and recall(None, 2048) == 1.0


def test_nearest_with_huge_tiny_repeated_and_uneven_vectors(spark):
    v = [(0, [1e200, 0.0]), (50, [1.0, 1e-3]), (1, [1e-300, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0]), (50, [1.0, 1e-3]), (None, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({"id": F.lit("clash"), "score": F.lit(1), "v": F.lit(2)})
    got = defaultdict(list)
    for r in ann.nearest(df, "vec_id", "embedding", F.col("id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 6)))
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 4, 1.0), (3, None, 1.0), (4, 50, 1.0), (5, 50, 1.0)] or sorted(x[1] for x in got[0] if x[1]) == [1, 4, 50, 50]
    assert sorted(x[:2] for x in got[100]) == [(1, 3)]
    assert len(got[50]) == 10 and sum(x[1] == 50 for x in got[50]) == 2  # each of the two rows has the other as a candidate


@pytest.mark.parametrize("noise", [0.02, 0.1])
def test_neighbours_in_dense_clusters(spark, noise):
    """Far more near copies of a vector than a query keeps by estimate: recall of every cluster's queries, and most vectors never scored."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 32))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 400, 0) + rng.normal(size=(4800, 32)) * noise
    ids = np.arange(len(v))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, "vec_id", "embedding", F.col("id") % 50 == 0, keep=40, sample=1024).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    want = exact_nearest(ids, v, range(0, len(v), 50))
    hits = defaultdict(list)
    for q, w in want.items():
        hits[q // 400].append(len(set(w) & {x for _, x in got[q]}) / 5)
    assert min(np.mean(h) for h in hits.values()) >= 0.99
    assert all(scored < 0.4 * everything for scored, everything in ann.SCORED)


# ---------------------------------------------------------------- op3, op4, op7, op9 on the odd table


def test_packing_of_odd_rows(docs):
    ids = library("word_bpe_49k.json")
    got = Counter((p.doc_id, p.doc_tokens, p.ids_crc32) for p in packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2, 1 << 30).collect())
    want = Counter()
    for r in rows():
        x = np.array(ids(r[1]) + [2], "<u4")
        want[r[0], len(x), zlib.crc32(x.tobytes())] += 1
    assert got == want


def test_token_file_of_odd_rows(spark, docs, tmp_path):
    ids = library("byte_bpe_50k.json")
    token_file.write_tokens(docs, f"{tmp_path}/codes", tokenizer_path("byte_bpe_50k.json"), 0)
    out = token_file.read_tokens(spark, f"{tmp_path}/codes").collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in out) == Counter((r[0], zlib.crc32(np.array(ids(r[1]) + [0], "<u4").tobytes())) for r in rows())
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert known == sorted(known, key=lambda x: (x is not None, x))
    token_file.write_tokens(docs.where("false"), f"{tmp_path}/none", tokenizer_path("byte_bpe_50k.json"), 0)
    assert token_file.read_tokens(spark, f"{tmp_path}/none").count() == 0
    shard = token_file.Shard(spark.read.parquet(f"{tmp_path}/codes").orderBy("part", "shard").first().payload)
    whole = shard.all().tolist()
    rng = random.Random(1)
    for _ in range(200):
        a = rng.randrange(shard.n)
        b = min(shard.n, a + rng.choice([0, 1, 7, 511, 512, 2000]))
        assert shard.span(a, b).tolist() == whole[a:b] and shard.token(a) == whole[a]


def test_hypergeometric_is_exact(spark):
    n, k, m = 9, 4, 5
    u = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    got = Counter(r.x for r in u.select(mixing.hypergeometric(*[F.lit(x).cast("long") for x in (n, k, m)], F.col("u")).alias("x")).collect())
    from math import comb

    for x in range(5):
        assert abs(got[x] / 20000 - comb(k, x) * comb(n - k, m - x) / comb(n, m)) < 2e-4


def test_leaves_hold_every_block_once(docs):
    sizes, targets, parts = mixing.mixed(docs, shards=5, block_words=500)
    p = parts.collect()
    held = defaultdict(set)
    for r in p:
        held[r.source_ix, r.block].add(r.shard)
    assert all(len(s) == 1 for s in held.values()) and {s for x in held.values() for s in x} == set(range(5))
    taken = Counter()
    for r in p:
        taken[r.source] += r.words
    assert all(abs(taken[t.source] - t.target) <= 1 for t in targets.collect())


def test_op9_of_odd_rows(docs):
    # rows of one id never remove each other's words, rows without an id take no part
    first = {}
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows()]
    for i, w in texts:
        for a in range(len(w) - 12):
            if i is not None:
                g = tuple(w[a : a + 13])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, w in texts:
        gone = {a + k for a in range(len(w) - 12) if i is not None and first[tuple(w[a : a + 13])] < i for k in range(13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    same(substring_dedup.deduplicate(docs, with_text=False).drop("kept"), want)
    assert OP9_SQL


# ---------------------------------------------------------------- op5


def brute(texts, k=5):
    """Components of (index, text) by all pairs: the class of each."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("edits", [2, 5])
def test_groups_above_one_block(spark, monkeypatch, edits):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for i in range(150):  # unrelated texts around a common passage
        texts.append(" ".join([word() for _ in range(60)] + base[:40] + [word() for _ in range(60)]))
    sets, label = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}


def test_bands_can_always_be_solid():
    for band in ngram_join.BANDS.all[:40]:
        assert band.n1 * (band.k2 + 1) > band.k and band.n2 > band.k2


def test_small_sets_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for n in range(1, 40):
        base = [f"w{rng.randint(0, 400)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(2):
            w = list(base)
            if rng.random() < 0.7:
                w.append("x")
            if n > 8 and rng.random() < 0.5:
                w[0] = "y"
            texts.append(" ".join(w))
    sets, label = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}


# ---------------------------------------------------------------- op8, op10


def test_language_scores_are_cosines_of_whole_bundles(spark):
    rng = random.Random(2)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    data = [(i, make("abcdé" if i % 2 else "wxyzα", 8), "aa" if i % 2 else "zz") for i in range(40)] + [(90, None, "aa"), (91, "?", "zz"), (92, make("abwx", 20000), None), (None, "abc", "aa"), (3, "abc abd", "zz")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    space = language_id.space()

    def bundle(t):
        code, _ = language_id.trigrams([t or ""])
        return sum((space.bound(np.array([c]))[0].astype(float) for c in code), np.zeros(language_id.DIM))

    total = {"aa": 0, "zz": 0}
    for i, t, lang in data:
        if lang and i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            total[lang] = total[lang] + bundle(t)
    unit = np.array([total[x] / np.linalg.norm(total[x]) for x in ("aa", "zz")])
    unit = unit - unit.mean(0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in language_id.predict(df, language_id.learn(df), ["score"], "_in_").collect():
        got[r.doc_id].append((r.lang_pred, r.score, r._in_score))
    for i, t, _ in data:
        b = bundle(t)
        cos = unit @ b / max(np.linalg.norm(b), 1e-12)
        want = ("und", 0.0) if not b.any() else (("aa", "zz")[int(cos.argmax())], float(np.clip(cos.max(), 0, 1)))
        assert any(p == want[0] and abs(s - want[1]) < 1e-4 and c == "clash" for p, s, c in got[i]), (i, want, got[i])


def test_license_base_places_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = "gnu general public license apache cc by mit foo bär 2".split()
    data = [(i, rng.choice([" ", "-", " ; "]).join(rng.choice([w, w.upper()]) for w in rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(60)]
    data += [(100, None), (101, ""), (102, "cc by " * 20000), (3, "MIT licence mit license"), (3, "MIT licence mit license")]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    want = Counter()
    for i, t in data:
        w = word.findall((t or "").encode().translate(lower))
        at, labels = [], set()
        for p, label in license_scan.BASE.items():
            p = p.encode().split()
            hit = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("labels", F.lit(1))
    out = license_scan.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in out)


def test_license_notices_survive_neighbours_and_edits(spark):
    s = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES)
    rng = random.Random(3)
    for notice, (label, k) in license_scan.NOTICES.items():
        t = list(notice)
        for _ in range(min(k, 3)):
            x = rng.randrange(1, len(t) - 1)
            t[x] = "z" if t[x] != " " else " "
        t = "".join(t)
        text = f" foo {notice} {t} {notice} bar "
        spans = [x for x in s.fuzzy(text) if x[0] == label]
        assert len(spans) >= 3 and any(p == 5 and e == 0 for _, p, _, e in spans), label


# ---------------------------------------------------------------- the pipeline's stages


def in_rows(df) -> Counter:
    return Counter(map(tuple, df.collect()))


def test_stage_language(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    told = [r for r in rows() if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r[:2] for r in told)
    assert all(r.lang is not None and r.lang_pred == "x" for r in out.collect())


def test_stage_exact_dedup(spark, docs):
    out = corpus_pipeline.exact_dedup(spark, docs, "")
    assert out.columns == docs.columns
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        want[max(known) if known else None, t] = 1
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


def test_stage_near_dedup(spark, docs):
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    data = [r[:2] for r in rows()]
    sets, label = brute([t for _, t in data])
    want, groups = Counter(), defaultdict(list)
    for i, (d, t) in enumerate(data):
        if sets[i]:
            groups[label[i]].append((d is None, d or 0, hashlib.md5(t.encode()).digest(), d, t))
        else:
            want[d, t] += 1
    for g in groups.values():
        want[min(g)[3:]] += 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_stage_packing_and_empty_input(spark, docs):
    out = corpus_pipeline.pack(spark, docs, "")
    assert out.agg(F.sum("length")).first()[0] == sum(len(library("word_bpe_49k.json")(r[1])) + 1 for r in rows())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name


def test_stage_mixture_keeps_columns(spark, docs):
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == docs.columns
    have = Counter((r[0], r[1]) for r in rows())
    assert all(n <= 2 * have[k] for k, n in Counter((r.doc_id, r.text) for r in out.collect()).items())


def test_run_applies_the_stages_in_turn(spark, tmp_path):
    spark.createDataFrame([r[:4] for r in rows()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = defaultdict(int)
    for p in pieces:
        by[p.sequence_id] += p.length
    assert pieces and all(by[s] == 4096 for s in sorted(by)[:-1])


def test_stream_dedup_of_odd_rows(docs):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    for r in stream_dedup.deduplicate(docs, ["text", "kept"]).collect():
        g = groups[r._in_text or ""]
        known = [i for i in g if i is not None]
        assert r.keep_id == (max(known) if known else None) and r._in_kept is False
        assert r.group_size == len(g) and r.kept == (not known or r.doc_id == max(known))
