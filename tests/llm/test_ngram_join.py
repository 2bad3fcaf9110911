"""op5 against brute force over all pairs."""

import random

import pytest

from riskloom.llm import ngram_join


def brute(rows, k=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    rows, i = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "a b c d"), (5, "A b  c\nd"), (6, "a b c d e")], 7
    for base in range(14):
        words = [word() for _ in range(rng.choice([6, 9, 30, 80, 400, 700]))]
        if base % 3 == 0:
            words = words[:10] + passage + words[10:]
        for _ in range(rng.randint(1, 7)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("all_pairs", [12, 2])
def test_components_equal_brute_force(spark, all_pairs):
    rows = corpus(all_pairs)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, all_pairs).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(50)))
    got = ngram_join.join(spark.createDataFrame([(3, text), (3, text), (None, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 46, "3"), ("3", 46, "3"), ("None", 0, "None"), ("None", 46, "3")]


def test_class_names_of_eight_bytes_are_told_apart(spark):
    """Digests that agree in their first bytes are named by later ones."""
    same = [bytes(8) + bytes([i]) * 8 for i in range(3)]
    frame = lambda nodes: spark.createDataFrame([(bytearray(n),) for n in nodes], "node binary")
    at = ngram_join.short_names(frame(same))
    assert at == 1 and ngram_join.short_names(frame([bytes([i]) * 16 for i in range(3)])) == 0
    got = frame(same).select("node", ngram_join.short_of(at).alias("s")).collect()
    assert all(r.s == ngram_join.short(bytes(r.node), at) for r in got) and len({r.s for r in got}) == 3
