"""The queries op1_ to op13_ and pipeline, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- op1

#: Dated list entries: kind, pattern, category, action, effective date.
URL_EVENTS = [
    ("domain", "adult-x.example.net", "adult", "add", "2024-01-01"),
    ("domain", "casino-win.example.net", "gambling", "add", "2024-02-15"),
    ("domain", "casino-win.example.net", "gambling", "drop", "2024-09-01"),
    ("domain", "cheap-pills.example.com", "pharma", "add", "2024-01-10"),
    ("domain", "cheap-pills.example.com", "pharma", "drop", "2024-05-01"),
    ("domain", "cheap-pills.example.com", "pharma", "add", "2024-07-01"),
    ("domain", "cheap-pills.example.com", "spam", "add", "2024-03-01"),
    ("domain", "example.org", "trial", "add", "2024-06-01"),
    ("domain", "example.org", "trial", "drop", "2024-06-08"),
    ("host", "blog.tionsh.example.net", "spam", "add", "2024-04-01"),
    ("host", "blog.tionsh.example.net", "spam", "drop", "2024-10-01"),
    ("host", "m.ththth.example.net", "mirror", "add", "2024-08-01"),
    ("prefix", "tionsh.example.net/en/", "mirror", "add", "2024-05-15"),
    ("prefix", "www.therer.example.com/fr/", "mirror", "add", "2024-03-15"),
    ("prefix", "www.therer.example.com/fr/", "mirror", "drop", "2024-11-15"),
]


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each fetched once in 2024: on day page_id mod 366, at second page_id mod 86,400."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((F.col("page_id") % 366).cast("int"), F.lit(0), F.lit(0), (F.col("page_id") % 86400).cast("decimal(18,6)"))).alias("fetched_at"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.url_filter import filter_urls

    events = spark.createDataFrame(URL_EVENTS, "kind string, pattern string, category string, action string, effective string").withColumn("effective", F.to_timestamp("effective"))
    return filter_urls(_captures(spark, sf_dir), events, "page_id", "url", "fetched_at")


OP1_SQL = f"""
WITH ev(kind, pattern, category, action, effective) AS (VALUES {", ".join(str(e) for e in URL_EVENTS)}),
iv AS (
  SELECT kind, pattern, category, action, CAST(effective AS TIMESTAMP) AS valid_from,
         lead(CAST(effective AS TIMESTAMP)) OVER (PARTITION BY kind, pattern, category ORDER BY effective) AS valid_to
  FROM ev),
cap AS (
  SELECT page_id, url,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) + to_seconds(page_id % 86400) AS t,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hit AS (
  SELECT c.page_id, iv.category
  FROM cap c JOIN iv ON iv.action = 'add' AND iv.valid_from <= c.t AND (iv.valid_to IS NULL OR c.t < iv.valid_to) AND c.host <> ''
   AND CASE iv.kind WHEN 'host' THEN c.host = iv.pattern
        WHEN 'domain' THEN c.host = iv.pattern OR ends_with(c.host, '.' || iv.pattern)
        ELSE starts_with(c.host || c.path, iv.pattern) END),
agg AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS cats FROM hit GROUP BY page_id)
SELECT c.page_id, coalesce(c.host, '') AS host, a.n IS NOT NULL AS blocked, coalesce(a.n, 0) AS n_hits, coalesce(a.cats, '') AS categories
FROM cap c LEFT JOIN agg a USING (page_id)
"""

# ---------------------------------------------------------------- op2


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("id") % 50 == 0)


# ---------------------------------------------------------------- op3, op4


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer's file is; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096, with_ids=False).drop("ids")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.common import shared_dir
    from riskloom.llm.token_file import read_tokens, write_tokens

    path = f"{shared_dir(spark)}/codes"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path, with_ids=False).drop("ids")


# ---------------------------------------------------------------- op5


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.ngram_join import join

    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "label")


# ---------------------------------------------------------------- op6


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.stream_dedup import deduplicate

    path = f"{sf_dir}/documents.parquet"
    return deduplicate(spark.read.parquet(path), path=path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

# ---------------------------------------------------------------- op7


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.mixing import ROW, join_rows, mixed

    sizes, targets, draws = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = draws.groupBy(*ROW).agg(F.sum("words").alias("taken"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return (
        join_rows(sizes, taken, "left")
        .join(F.broadcast(t) if t.limit(1001).count() <= 1000 else t, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || doc_id) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ix FROM s0),
s2 AS (SELECT *, CASE ix % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap,
              CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(w) OVER (ORDER BY cap / w, ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
              row_number() OVER (ORDER BY cap / w, ix) AS rn FROM s2),
s4 AS (SELECT *, (total * 1.5::DOUBLE - before) / ws AS lvl FROM s3),
s5 AS (SELECT lvl AS level FROM s4 WHERE lvl * w <= cap ORDER BY rn LIMIT 1),
s6 AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM s5), 0) * w) AS target FROM s4),
o AS (
  SELECT d.doc_id, d.size, s.source_size, s.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts,
         CASE WHEN s.source_size > 0 THEN CAST(floor(s.target / s.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN s6 s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - starts)) AS BIGINT) AS taken
FROM o
"""

# ---------------------------------------------------------------- op8


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.language_id import learn, predict

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs))

# ---------------------------------------------------------------- op9


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.substring_dedup import deduplicate

    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


OP9_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS g FROM pos),
gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM gone),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, count(*) AS n
         FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

# ---------------------------------------------------------------- op10


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.license_scan import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


# ---------------------------------------------------------------- op11


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.token_align import alignments

    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


# ---------------------------------------------------------------- op12


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.sharding import shard_table

    return shard_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 24, more=[1.0])


def _smallest_draw(shards: int) -> str:
    return f"list_min(list_transform(range({shards}), lambda i: {{'cost': -ln((CAST('0x' || substr(md5('#' || doc_id || '/' || i), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE), 'shard': i}})).shard"


#: The checksum's table is eight steps of its shift register from each byte; the checksum then takes the text's bytes in turn.
OP12_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS steps),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, t.steps[1 + (xor(c, x) & 255)]), 4294967295)) AS text_crc32,
             CAST({_smallest_draw(24)} AS INTEGER) AS shard, CAST({_smallest_draw(25)} AS INTEGER) AS grown_shard
      FROM b, t)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM d
"""

# ---------------------------------------------------------------- op13


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.common import shared_dir
    from riskloom.llm.lexical import index, search

    blocks = index(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/blocks")
    return search(blocks, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
post AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM post WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT doc_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
         FROM tf JOIN df USING (term), totals),
found AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY ALL HAVING score > 0),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM found)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""


def queries() -> dict:
    made = (op1_url_filter, op2_ann, op3_packing, op4_token_file, op5_ngram_join, op6_stream_dedup, op7_mixture, op8_language_id, op9_substring_dedup, op10_license_scan, op11_token_alignment, op12_sharding, op13_lexical_search)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op6_stream_dedup": OP6_SQL, "op7_mixture": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op12_sharding": OP12_SQL, "op13_lexical_search": OP13_SQL}
