"""Text features: TF-IDF on the corpus and its truncated SVD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.lineage import cut, spread_by
from riskloom.functions.scalar import d, joined_text, split_list


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters or digits of any script, or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def tfidf(docs: DataFrame, key: str, text: str, max_terms: int = 5000, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document to length 1; the ``max_terms`` most frequent terms, ties by term."""
    # texts move once, by key: counts and norms are worked out where they lie, and no (key, term) row is shuffled
    tf = spread_by(docs.select(key, text), key).select(key, F.explode(tokens(F.col(text))).alias("term"))
    if stop:
        tf = tf.where(~F.col("term").isin(*stop))
    tf = tf.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(max_terms)
    n = docs.agg(F.countDistinct(key).alias("n"))
    vocabulary = vocabulary.crossJoin(F.broadcast(n)).select("term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    w = tf.join(F.broadcast(vocabulary), "term").withColumn("w", (F.ln(F.col("tf")) + 1) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def stop_words() -> tuple[str, ...]:
    """Spark's own list of English stop words."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w)


def svd_embedding(weights: DataFrame, key: str, dim: int = 128, rounds: int = 7, seed: int = 42) -> DataFrame:
    """(key, embedding): rows projected on the top right singular vectors; shorter spectra are padded with zeros. Signs are arbitrary.

    Subspace iteration on A'A from a seeded random start: each round is one pass in which a task adds up A'(A X) for its rows; these sums
    are terms x (dim + 10) numbers, bounded by the vocabulary.
    """
    import numpy as np
    import pyarrow as pa

    spark = weights.sparkSession
    terms = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]  # the vocabulary, of bounded size
    size = len(terms)
    if not size:
        return weights.select(key, F.array().cast("array<double>").alias("embedding"))
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "i int, term string"))
    rows = cut(weights.join(numbers, "term").groupBy(key).agg(F.collect_list("i").alias("i"), F.collect_list("weight").alias("w")))
    slices = 16

    def of(batch):
        i, w = batch.column(1), batch.column(2)
        n = np.diff(i.offsets.to_numpy())
        return np.repeat(np.arange(len(batch)), n), i.flatten().to_numpy(), w.flatten().to_numpy(), len(batch)

    def projected(row, i, w, n, x):
        out = np.zeros((n, x.shape[1]))
        np.add.at(out, row, x[i] * w[:, None])
        return out

    def gram(x):
        def partial(batches):
            total = np.zeros_like(x)
            for batch in batches:
                row, i, w, n = of(batch)
                np.add.at(total, i, projected(row, i, w, n, x)[row] * w[:, None])
            parts = np.array_split(total, slices)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts])], ["s", "m"])

        def add(batches):
            total = {}
            for batch in batches:
                for s, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                    m = np.frombuffer(m.as_buffer())
                    total[s] = total[s] + m if s in total else m
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["s", "m"])

        schema = "s int, m binary"
        got = rows.mapInArrow(partial, schema).repartition(slices, "s").mapInArrow(add, schema).collect()
        return np.concatenate([np.frombuffer(r.m).reshape(-1, x.shape[1]) for r in sorted(got)])

    k = min(dim, size)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + 10))))[0]
    for _ in range(rounds):
        x = np.linalg.qr(gram(x))[0]
    values, vectors = np.linalg.eigh(x.T @ gram(x))
    right = x @ vectors[:, np.argsort(-values)[:k]]
    right = np.pad(right, ((0, 0), (0, dim - k)))

    def embed(batches):
        for batch in batches:
            out = projected(*of(batch), right)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], [key, "embedding"])

    return rows.mapInArrow(embed, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def vulnerability_text(description: Column, title: Column, cwe_ids: Column, fallback: Column) -> Column:
    """Description, title and weaknesses (separated by semicolons) in one text, or the fallback."""
    return joined_text([description, title, F.array_join(split_list(cwe_ids, ";"), " ")], fallback)


def tfidf_backend(docs: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """Fits itself on the texts and embeds them."""
    return svd_embedding(tfidf(docs, key, text, stop=stop_words()), key, dim)


def table_backend(docs: DataFrame, key: str, table: DataFrame, table_key: str, vector: str) -> DataFrame:
    """Embeddings that another model has made, by key; none for keys that the table lacks."""
    return docs.select(key).join(table.select(F.col(table_key).alias(key), F.col(vector).cast("array<double>").alias("embedding")), key, "left")


BACKENDS = {"tfidf": tfidf_backend, "table": table_backend}


def backend(name: str):
    """The embedding function of that name."""
    if name not in BACKENDS:
        raise ValueError(f"unknown embedding backend {name!r}: {', '.join(BACKENDS)}")
    return BACKENDS[name]


def expanded(df: DataFrame, vector: str, dim: int, prefix: str = "embed_") -> DataFrame:
    """A column for each component, 0 where there is none; for export, as the array is the better form to compute with."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[F.coalesce(F.get(vector, F.lit(i)).cast("double"), d(0)).alias(f"{prefix}{i}") for i in range(dim)])


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), d(0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
