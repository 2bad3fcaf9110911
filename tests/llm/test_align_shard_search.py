"""Token alignment, sharding and lexical search against brute force, with nulls, repeats, ties, clashing columns, empty tables and very long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("riskloom.llm")

from riskloom.llm import lexical, sharding, token_align
from riskloom.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "<s>", "<|endoftext|>", ".", ",", "'s", "1", "Word", "x y", "　", "\r", "é", "\x00", "<0x41>", "the ", "\x85"]
CLASH = "doc_id long, text string, shard int, slot string, size string, rank int, score double, n_a string, chunk int, block string, term string, law int"


def odd_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def rows() -> list[tuple]:
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma9", "naïve", "x", "the", "THE", "漢字", "delta", "1"]
    out = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    out += [(3, "the the alpha"), (3, "the the alpha"), (None, None), (None, None), (400, None), (401, ""), (402, "!? --"), (403, "same text"), (404, "same text"), (405, "same text")]
    out += [(406, " ".join(rng.choice(words) for _ in range(90_000))), (407, "y" * 300_000)]
    return [(*r, 1, "s", "b", 2, 0.5, "n", 3, "k", "t", 4) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), CLASH).repartition(5)


def same(df, want) -> None:
    assert Counter(map(tuple, df.collect())) == Counter(map(tuple, want))


# ---------------------------------------------------------------- op11


def tokens(text):
    """Both sides' ids and token ends on space+text by plain calls of the libraries; None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a = Tokenizer.from_file(tokenizer_path(A))
        tokens.a.encode_special_tokens = True
        tokens.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        tokens.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    if not text:
        return None
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    left = [bytes(tokens.byte[c] for c in tokens.a.id_to_token(i)) for i in a]
    right = [bytes([int(p[3:5], 16)]) if tokens.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tokens.b.id_to_piece(i)]]
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return None
    return a, b, np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()


def aligned(text):
    """(groups, links) of a text, pair by pair."""
    t = tokens(text)
    if t is None:
        return [], []
    a, b, ea, eb = t
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(ea) & set(eb)):
        x, y = ea.index(c, i) + 1, eb.index(c, j) + 1
        groups.append((a[i:x], b[j:y], c))
        i, j = x, y
    starts_a, starts_b = [0, *ea], [0, *eb]
    i = j = 0
    while i < len(a) and j < len(b):
        if max(starts_a[i], starts_b[j]) < min(ea[i], eb[j]):
            links.append((a[i], b[j]))
        if ea[i] < eb[j]:
            i += 1
        elif eb[j] < ea[i]:
            j += 1
        else:
            i, j = i + 1, j + 1
    return groups, links


def alignment_rows(data):
    found = [(d, *aligned(t), tokens(t)) for d, t in data]
    count = Counter(x for f in found for x in f[2])
    best_b, best_a = defaultdict(int), defaultdict(int)
    for (a, b), n in count.items():
        best_a[a], best_b[b] = max(best_a[a], n), max(best_b[b], n)
    for d, groups, links, t in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        yield (d, len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(links), sum(count[x] == best_b[x[1]] for x in links), sum(count[x] == best_a[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if t else "")


def test_alignment_equals_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(token_align, "CHUNK_BYTES", 3000)
    data = list(enumerate(odd_texts(500))) + [(None, "null id"), (7, None), (7, "repeated"), (7, "repeated"), (900, " ".join(odd_texts(60, 5)).replace("▁", "")), (901, "<|endoftext|> plain"), (902, " "), (903, "x ")]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in data], "doc_id long, text string, chunk string, a int, n_links int").repartition(3)
    same(token_align.alignments(df, tokenizer_path(A), tokenizer_path(B)), alignment_rows(data))
    assert token_align.alignments(df.where("false"), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_alignment_of_clashing_columns_and_long_texts(docs):
    d = docs.where("doc_id is null or doc_id < 407")
    same(token_align.alignments(d, tokenizer_path(A), tokenizer_path(B)), alignment_rows([r[:2] for r in rows() if r[0] is None or r[0] < 407]))


def test_groups_of_one_text():
    aligner = token_align.Aligner(tokenizer_path(A), tokenizer_path(B))
    for t in ["naïve café 漢字 the", "", "▁", "one"]:
        assert aligner.groups(t) == aligned(t)[0]


# ---------------------------------------------------------------- op12


def shard_of(key: str, weights) -> int:
    draw = lambda i: (int(hashlib.md5(f"{key}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min(range(len(weights)), key=lambda i: (-math.log(draw(i)) / weights[i], i))


def shard_rows(data, weights, more):
    out = []
    for d, t in data:
        raw = (t or "").encode()
        key = f"#{d}" if d is not None else "?" + hashlib.md5(raw).hexdigest()
        out.append((d, len(raw) + 8, zlib.crc32(raw), "key", shard_of(key, weights), shard_of(key, [*weights, *more])))
    place = Counter()
    for d, size, crc, law, s, g in sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        yield d, size, crc, law, s, place[s], g
        place[s] += 1


@pytest.mark.parametrize(("weights", "more"), [([1.0] * 24, [1.0]), ([3.0, 1.0, 0.5], [2.0, 1.0]), ([1.0], [1.0])])
def test_shards_equal_the_law(docs, weights, more):
    same(sharding.shard_table(docs, weights, more), shard_rows([r[:2] for r in rows()], weights, more))
    assert sharding.shard_table(docs.where("false"), weights, more).count() == 0


def test_further_shards_take_rows_only_into_themselves(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.sharded(d, [2.0, 1.0, 1.0], [1.0])
    assert out.where("shard <> grown_shard and grown_shard <> 3").count() == 0
    n = {r[0]: r[1] for r in out.groupBy("grown_shard").count().collect()}
    assert all(abs(n[s] - 20_000 * w / 5) < 400 for s, w in enumerate([2, 1, 1, 1]))
    with pytest.raises(ValueError):
        sharding.assign(F.col("doc_id"), [1.0, 0.0])


def test_places_are_gapless_where_one_row_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    d = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    slots = [r.slot for r in sharding.shard_table(d, [1.0] * 24).collect()]
    assert sorted(slots) == list(range(3000))


def test_written_shards_hold_all_columns(docs, tmp_path):
    name = sharding.write_shards(docs, f"{tmp_path}/s", [1.0, 2.0])
    back = docs.sparkSession.read.parquet(f"{tmp_path}/s")
    assert name == "shard_" and Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(rows())
    assert all(r.shard_ == shard_of(f"#{r.doc_id}", [1.0, 2.0]) for r in back.where("doc_id is not null").select("doc_id", "shard_").collect())


# ---------------------------------------------------------------- op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(lexical.UPPER, lexical.LOWERED)


def search_rows(data, items, k=10):
    cut = [(d, TERM.findall((t or "").translate(LOW))) for d, t in data]
    cut = [(d, t, Counter(t)) for d, t in cut if t]
    n_docs, n_terms = len(cut), sum(len(t) for _, t, _ in cut)
    df = Counter(x for _, _, c in cut for x in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOW)))
    for i, terms in asked.items():
        found = []
        for d, t, c in cut:
            m = 10 + 90 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in terms if x in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        for r, (s, none, d) in enumerate(sorted(found)[:k], 1):
            yield i, r, None if none else d, -s


ITEMS = [(1, "alpha THE beta"), (2, "漢字 1"), (3, None), (4, ""), (5, "absent words"), (None, "gamma9 naïve"), (6, "x"), (6, "delta"), (7, "same text"), (8, " ".join(["the"] * 50)), (9, "yyy " + "y" * 300_000)]


@pytest.mark.parametrize("batch", [200_000, 4])
def test_search_equals_brute_force(spark, docs, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(lexical, "BATCH_TERMS", batch)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    items = spark.createDataFrame([(*i, 1, "t") for i in ITEMS], "item_id long, text string, item int, term string")
    blocks = lexical.index(docs, f"{tmp_path}/blocks")
    same(lexical.search(blocks, items), search_rows([r[:2] for r in rows()], ITEMS))
    same(lexical.search(blocks, items, 2), search_rows([r[:2] for r in rows()], ITEMS, 2))
    assert lexical.search(blocks, items.where("false")).count() == 0
    empty = lexical.index(docs.where("false"), f"{tmp_path}/none")
    assert lexical.search(empty, items).count() == 0


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """Of blocks of one kind of documents each, an item reads only those of its kind; what is left out changes no result."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 5)
    data = [(i, f"kind{i // 50} filler{i % 3} word{i}") for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    rows_ = [r.asDict() for r in lexical.index(df, f"{spark.conf.get('spark.checkpoint.dir')}/pruned").collect()]
    items = lexical.Items([(1, "kind3"), (1, "filler1"), (2, "word77")])
    held = Counter()
    for r in rows_:
        here, there = items.match(bytes(r["terms"]), lexical.unpacked(bytes(r["sizes"]), r["n_distinct"]))
        for t, n in zip(there.tolist(), lexical.unpacked(bytes(r["holders"]), r["n_distinct"])[here].tolist()):
            held[t] += n
    items.weigh(held, 1000, 3000)
    best = lexical.Best(2, 3, None)
    pairs = lexical._score_segment(items, best, rows_)
    assert pairs < 20 < len(rows_) * 2
    want = defaultdict(list)
    for i, r, d, s in search_rows(data, [(1, "kind3 filler1"), (2, "word77")], 3):
        want[i].append((-s, False, d))
    assert [sorted(f) for f in best.found] == [want[1], want[2]]
