"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. ``source_targets``: each source's share of ``factor`` times all words by its weight,
   at most ``most`` times its own size; what lies above is shared out again by weight.
   In closed form: sorted by cap over weight, the capped sources are a prefix.
2. ``draws``: a source's documents lie on a line in a fixed random order (MD5 of seed and
   doc_id). Its target is so many whole passes over the line and the start of one
   more, cut into blocks of ``block_words`` words. Prefix sums are two-pass: totals of (source, hash range)
   first, then sums inside each range, so that no task holds a whole source.
3. ``shard_blocks``: the root of the tree has each source's exact number of blocks; a node deals its counts to two halves of
   its shards, source after source by a hypergeometric draw given what is left: the inverse of the distribution function at a
   hashed uniform number, summed over all values within ten standard deviations and ten more (what lies beyond is below 1e-20).
   A leaf is a shard's quota for each source; quotas become disjoint ranges of the source's permuted blocks.
4. ``mixed``: what the mix takes is what lies in the leaves' blocks: a document's words are dealt to blocks, blocks to shards, and
   each piece has its shard and the key by which the shard is shuffled. ``mixed_documents`` deals whole documents to
   shards and shuffles each shard by that key.

Only DataFrame functions; everything is a function of seed, doc_id, source and sizes, so reruns agree. A node of the tree holds an array of
one number a source: sources may number thousands, not millions.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own,
last in order; rows that repeat a doc_id are each drawn, those that agree in all columns of ROW in any order; with no words at all every target is
0; an empty table takes nothing. Null doc_ids stand last on the line. ROW tells rows apart where doc_id does not. A very long document
spans many blocks, and so may several shards. Extra columns are not read; ``mixed_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import narrow, partitions_for, shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"

#: Together the key of a row: nth counts the rows that agree on the others.
ROW = ("doc_id", "source", "size", "nth")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, nth): size in words."""
    return numbered(docs.select("doc_id", "source", words(docs["text"]).alias("size")), [F.lit(0)])


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, which have doc_id, source and size, with nth from 1 in ``order``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*ROW[:-1]).orderBy(*order)))


def join_rows(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """A join on ROW in which nulls are equal; ``other``'s key columns go."""
    o = other.withColumnsRenamed({c: f"_o_{c}" for c in ROW})
    same = [rows[c].eqNullSafe(o[f"_o_{c}"]) for c in ROW]
    return rows.join(o, same, how).drop(*[f"_o_{c}" for c in ROW])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_ix, source_size, n_docs, weight, target): one row for each source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("source_ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_ix") % len(weights)).cast("int") + 1))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "_all": F.sum("source_size").over(Window.partitionBy())})
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_ix")
    s = s.withColumns({"_before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_weights": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("_level", (F.col("_all") * F.lit(float(factor)) - F.col("_before")) / F.col("_weights"))
    # the level of the first source that it leaves below its cap
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_cap).alias("i"), F.col("_level").alias("x")))).over(Window.partitionBy())["x"])
    return s.select("source", "source_ix", "source_size", "n_docs", "weight", F.least(F.col("cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def line(sizes: DataFrame, targets: DataFrame, seed: str, digits: int) -> DataFrame:
    """Each document with its source's target and where it begins on the source's permuted line of words."""
    d = sizes.withColumn("_h", F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.lit("g")))
    d = d.withColumn("_range", F.substring("_h", 1, digits))
    ranges = d.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ranges = ranges.withColumn("_base", F.sum("_words").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce("_base", F.lit(0)).alias("_base"), "source_ix", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return d.select(*ROW, "source_ix", "source_size", "target", (F.col("_base") + F.col("_inside")).alias("starts"))


def draws(on_line: DataFrame) -> DataFrame:
    """One row for each copy of which the mix takes a piece: copy (0, 1), words, and its place on the source's drawn line."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long")
    d = on_line.withColumn("_whole", whole).withColumn("_rest", rest)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("starts"))).cast("long")
    pieces = F.transform(F.sequence(F.lit(0), F.col("_whole")), lambda i: F.struct(i.cast("long").alias("copy"), F.when(i < F.col("_whole"), F.col("size")).otherwise(part).alias("words"), (i * F.col("source_size") + F.col("starts")).alias("place")))
    return d.select(*ROW, "source_ix", "source_size", "target", F.explode(F.filter(pieces, lambda p: p["words"] > 0)).alias("p")).select(*ROW, "source_ix", "source_size", "target", "p.*")


def in_blocks(pieces: DataFrame, block_words: int) -> DataFrame:
    """Pieces cut at the borders of blocks: block, place and words of each part."""
    b = F.lit(block_words).cast("long")
    end = F.col("place") + F.col("words")
    cut = pieces.withColumn("_end", end).withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / b), F.floor((end - 1) / b))))
    cut = cut.withColumn("_from", F.greatest(F.col("place"), F.col("block") * b))
    return cut.withColumns({"words": F.least(F.col("_end"), (F.col("block") + 1) * b) - F.col("_from"), "place": F.col("_from")}).drop("_end", "_from")


def _uniform(*key: Column) -> Column:
    return (F.xxhash64(*key).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))


def hypergeometric(left: Column, k: Column, n: Column, u: Column) -> Column:
    """How many of n things drawn out of ``left``, of which k are of a kind, are of it: the smallest x at which the distribution function reaches u."""
    of = lambda x: x.cast("double")
    mean = of(n) * of(k) / F.greatest(of(left), F.lit(1.0))
    sd = F.sqrt(mean * (1 - of(k) / F.greatest(of(left), F.lit(1.0))) * of(left - n) / F.greatest(of(left) - 1, F.lit(1.0)))
    least, most = F.greatest(F.lit(0).cast("long"), n - (left - k)), F.least(n, k)
    lo = F.greatest(least, F.floor(mean - 10 * sd - 10)).cast("long")
    hi = F.least(most, F.ceil(mean + 10 * sd + 10)).cast("long")
    # weights relative to that of lo, each from the one before
    ratio = lambda x: of(k - x + 1) * of(n - x + 1) / (of(x) * of(left - k - n + x))
    weight = lambda acc, x: F.when(x == acc["lo"], F.lit(1.0)).otherwise(acc["w"] * ratio(x))

    def grow(acc: Column, x: Column) -> Column:
        w = weight(acc, x)
        return F.struct(acc["lo"].alias("lo"), w.alias("w"), (acc["sum"] + w).alias("sum"))

    def seek(acc: Column, x: Column) -> Column:
        w = weight(acc, x)
        return F.struct(acc["lo"].alias("lo"), w.alias("w"), (acc["sum"] + w).alias("sum"), acc["goal"].alias("goal"), F.when((acc["at"] < 0) & (acc["sum"] + w >= acc["goal"]), x).otherwise(acc["at"]).alias("at"))

    span = F.sequence(lo, F.greatest(lo, hi))
    zero = F.lit(0.0)
    total = F.aggregate(span, F.struct(lo.alias("lo"), zero.alias("w"), zero.alias("sum")), grow)["sum"]
    found = F.aggregate(span, F.struct(lo.alias("lo"), zero.alias("w"), zero.alias("sum"), (total * u).alias("goal"), F.lit(-1).cast("long").alias("at")), seek)["at"]
    return F.when(found < 0, hi).otherwise(found)


def shard_blocks(targets: DataFrame, shards: int, block_words: int, seed: int = 7) -> DataFrame:
    """(source_ix, block, shard): which shard each permuted block of each source belongs to."""
    blocks = F.ceil(F.floor(F.col("target") + 0.5) / F.lit(float(block_words))).cast("long")
    nodes = targets.agg(F.transform(F.array_sort(F.collect_list(F.struct("source_ix", blocks.alias("n")))), lambda x: x["n"]).alias("counts")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")

    def deal(acc: Column, i: Column, counts: Column, lo: Column, hi: Column) -> Column:
        k = F.element_at(counts, i)
        left, n = acc["left"], acc["n"]  # blocks not yet dealt, of which n go to the lower half
        x = hypergeometric(left, k, n, _uniform(F.lit(seed), lo, hi, i))
        return F.struct((left - k).alias("left"), (n - x).alias("n"), F.concat(acc["took"], F.array(x)).alias("took"))

    for _ in range(max(1, math.ceil(math.log2(max(shards, 2))))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        n = F.when(F.col("hi") - F.col("lo") > 1, F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(total).cast("long")
        start = F.struct(total.alias("left"), n.alias("n"), F.array().cast("array<bigint>").alias("took"))
        took = F.aggregate(F.sequence(F.lit(1), F.size("counts")), start, lambda a, i: deal(a, i, F.col("counts"), F.col("lo"), F.col("hi")))["took"]
        nodes = nodes.withColumn("took", F.when((F.size("counts") > 0) & (F.col("hi") - F.col("lo") > 1), took).otherwise(F.col("counts")))
        rest = F.zip_with("counts", "took", lambda a, b: a - b)
        halves = F.when(F.col("hi") - F.col("lo") > 1, F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.col("took").alias("counts")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"), rest.alias("counts")))).otherwise(F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("counts").alias("counts"))))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.*")
    quota = nodes.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("source_ix", "n"))
    quota = quota.withColumn("to", F.sum("n").over(Window.partitionBy("source_ix").orderBy("shard"))).where("n > 0")
    return quota.select("source_ix", "shard", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("block"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, shards: int | None = None, block_words: int = 65536, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, draws): draws has a row for each part of a document in a leaf's block, with words, block, place, shard and shuffle key.

    ``shards``: one for every 256 MB of input where not given, and no fewer than the session's shuffle partitions.
    """
    folder = shared_dir(docs.sparkSession)
    shards = shards or partitions_for(narrow(docs, "doc_id", "source", "text"), 256 << 20)
    sizes = written(sizes_of(docs), f"{folder}/sizes")
    targets = written(source_targets(sizes, weights, factor, most), f"{folder}/targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 1
    digits = min(6, max(2, math.ceil(math.log(max(1, largest / 2000), 16))))
    leaves = written(shard_blocks(targets, shards, block_words), f"{folder}/leaves")
    taken = in_blocks(draws(line(sizes, targets, seed, digits)), block_words).join(leaves, ["source_ix", "block"])
    return sizes, targets, taken.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "doc_id", "copy"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Whole documents of the mix, all their columns: a copy is in if at least half of its words are taken; it goes to the shard of its
    first block. Shards are partitions, shuffled by the key."""
    _, _, parts = mixed(docs, **how)
    copies = parts.groupBy(*ROW, "copy", "shuffle_key").agg(F.sum("words").alias("words"), F.min_by("shard", "place").alias("_shard")).where("2 * words >= size")
    # a key without nulls, so that the join and the numbering inside it share one shuffle of the documents
    key = ["_id", "_no_id", "_source", "_no_source", "_size"]
    keys = lambda doc_id, source, size: [F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_no_id"), F.coalesce(source, F.lit("")).alias("_source"), source.isNull().alias("_no_source"), size.alias("_size")]
    copies = copies.select(*keys(F.col("doc_id"), F.col("source"), F.col("size")), F.struct("nth", "_shard", F.col("shuffle_key").alias("_shuffle")).alias("_c"))
    copies = copies.groupBy(*key).agg(F.collect_list("_c").alias("_copies"))
    # the row's own columns travel as one struct, so that no name of theirs can clash
    rows = docs.select(*keys(docs["doc_id"].cast("long"), docs["source"].cast("string"), words(docs["text"])), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    out = rows.join(copies, key).withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row"))))
    out = out.select("_row", F.explode(F.filter("_copies", lambda c: c["nth"] == F.col("_nth"))).alias("_c"))
    return out.repartition("_c._shard").sortWithinPartitions("_c._shard", "_c._shuffle").select("_row.*")
