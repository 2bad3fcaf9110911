"""op7 and the pipeline's mixture where doc_id is null or repeated, against the drawn line worked out in Python."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("riskloom.llm")

import corpus_pipeline
from riskloom.llm import queries

DOCS = [(1, "a b c"), (1, "d e f g h"), (2, "i j"), (2, "k l"), (3, "m n o p"), (None, "q r s"), (None, "t u v w x"), (None, "y"), (4, "z")]


def drawn():
    """(doc_id, text, size, taken) of one source: all words once, then the line's start up to half of them."""
    rows = sorted(DOCS, key=lambda x: ("g" if x[0] is None else hashlib.md5(f"mix:{x[0]}".encode()).hexdigest(), len(x[1].split())))
    rest, out = int(sum(len(t.split()) for _, t in DOCS) * 0.5 + 0.5), []
    for i, t in rows:
        n = len(t.split())
        part = max(0, min(n, rest))
        rest -= n
        out.append((i, t, n, n + part))
    return out


def frame(spark):
    return spark.createDataFrame([(i, t, "en", "web") for i, t in DOCS], "doc_id long, text string, lang string, source string")


def test_op7_draws_every_row(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r["size"], r.taken) for r in queries.op7_mixture(spark, str(tmp_path)).collect())
    assert got == Counter((i, n, k) for i, _, n, k in drawn())


def test_mixture_keeps_every_row_apart(spark):
    got = Counter((r.doc_id, r["size"]) for r in corpus_pipeline.mixture(spark, frame(spark).selectExpr("*", "size(split(text, ' ')) n_words"), "").selectExpr("doc_id", "n_words size").collect())
    want = Counter()
    for i, _, n, k in drawn():
        want[i, n] += 1 + (k > n and 2 * (k - n) >= n)
    assert got == want
    out = corpus_pipeline.mixture(spark, frame(spark), "")
    assert out.columns == ["doc_id", "text", "lang", "source"] and {r.text for r in out.collect()} == {t for _, t in DOCS}
