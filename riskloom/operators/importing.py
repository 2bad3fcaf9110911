"""Imports that add to a stored graph, each file once.

An import looks whether its files exist, takes their checksums in one job, leaves out what the log has under the same checksum, reads the rest in a plan
for many files at a time, and merges it into the stored graph: attributes by node, the newest file last; links that must have both ends wait in the store until an end is
imported. Graph, waiting rows and log become visible in one commit, so a run that ends early leaves the graph and the log as they were, and a run that
begins again does what is left. Two imports one after the other leave the same graph as one of all files in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import commits
from riskloom.sources import readers

GRAPH = {"nodes": readers.NODE, "edges": readers.EDGE, "waiting_nodes": readers.NODE, "waiting_edges": readers.EDGE}
LOG = "batch_id string, source string, file string, import_ts timestamp, records long, sha256 string"
WHOLE_BYTES = 1 << 30  # larger files do not fit the binary source's one value
FILES_A_TRIGGER = 256


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the stored graph or its log as of the last commit, empty if there is none."""
    df = commits.read(spark, folder, table)
    return df if df is not None else spark.createDataFrame([], GRAPH.get(table, LOG))


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """SHA-256 of each file in hex, or None if there is no such file; a folder's is that of its files' checksums in order of their names.

    A file of more than ``WHOLE_BYTES`` is read in ranges by all tasks; its checksum, marked ``sum:``, is its size, its lines and the sum of its lines' hashes.
    """
    sizes: dict[str, dict[str, int]] = {}
    for path in paths:
        p, fs = commits._path(spark, path)
        sizes[path] = {}
        if fs.exists(p):
            found = fs.listFiles(p, True)
            while found.hasNext():
                f = found.next()
                if f.getPath().getName()[0] not in "._":  # not data to Spark's readers
                    sizes[path][f.getPath().toString()] = f.getLen()
    all_ = {f: n for files in sizes.values() for f, n in files.items()}
    small, large = [f for f, n in all_.items() if n <= WHOLE_BYTES], [f for f, n in all_.items() if n > WHOLE_BYTES]
    sums: dict[str, str] = {}
    if small:
        sums |= {r.path: r.sha256 for r in spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("sha256")).collect()}
    for f in large:
        t = spark.read.text(f).agg(F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        sums[f] = f"sum:{all_[f]}:{t.n}:{t.s}"
    import hashlib

    def of(files: dict[str, int]) -> str | None:
        told = [sums[f] for f in sorted(files)]
        return None if not told else told[0] if len(told) == 1 else hashlib.sha256("".join(told).encode()).hexdigest()

    return {path: of(files) for path, files in sizes.items()}


def import_new(spark: SparkSession, folder: str, paths: list[str], now: str, tries: int = 3) -> DataFrame:
    """Import what is new among the files; a row for each: (file, source, nodes_added, edges_added, success, error). A file that was imported before, or comes twice, adds nothing."""
    for last in range(tries):
        try:
            return _import_new(spark, folder, sorted(set(paths)), now)
        except commits.Conflict:  # another import was faster: begin again on its graph
            if last == tries - 1:
                raise
    raise ValueError("tries must be positive")


def _import_new(spark: SparkSession, folder: str, paths: list[str], now: str) -> DataFrame:
    m = commits.manifest(spark, folder)
    base = m["version"] if m else 0
    sums = checksums(spark, [p for p in paths if readers.route(p)])
    asked = spark.createDataFrame([(s,) for s in sums.values() if s], "sha256 string")
    before = {r[0] for r in stored(spark, folder, "import_log").join(F.broadcast(asked), "sha256", "left_semi").select("sha256").collect()}  # at most a row a file asked for
    rows, new = [], []
    for path in paths:
        source = readers.route(path)
        if source is None:
            rows.append((path, "unknown", 0, 0, False, f"No reader matched for file: {path.rpartition('/')[2]}"))
        elif sums[path] is None:
            rows.append((path, source, 0, 0, False, f"File not found: {path}"))
        elif sums[path] in before:
            rows.append((path, source, 0, 0, True, "already imported"))
        else:
            before.add(sums[path])
            new.append(path)
    nodes, edges, failed = readers.loaded(spark, new)
    rows += [(p, readers.route(p), 0, 0, False, x) for p, x in failed.items()]
    done = [(i, p) for i, p in enumerate(new) if p not in failed]
    if done:
        old = {t: stored(spark, folder, t) for t in GRAPH}
        first = F.lit(-1).alias("_seq")
        nodes = old["nodes"].unionByName(old["waiting_nodes"]).select("*", first).unionByName(nodes)
        edges = old["edges"].unionByName(old["waiting_edges"]).select("*", first).unionByName(edges)
        added_nodes, added_edges = readers.added(nodes, edges)
        # an edge that waited counts with the file that brought it
        rows += [(p, readers.route(p), added_nodes.get(i, 0), added_edges.get(i, 0), True, None) for i, p in done]
        graph = dict(zip(GRAPH, readers.graph_of(nodes, edges)))
        log = spark.createDataFrame([(f"{base + 1}-{i}", readers.route(p), p, None, added_nodes.get(i, 0) + added_edges.get(i, 0), sums[p]) for i, p in done], LOG)
        commits.commit(spark, folder, f"import {now}", replace=graph, append={"import_log": log.withColumn("import_ts", F.lit(now).cast("timestamp"))}, base=base)
    return spark.createDataFrame(sorted(rows), "file string, source string, nodes_added long, edges_added long, success boolean, error string")


def watch(spark: SparkSession, folder: str, inbox: str, now: str) -> None:
    """Import all files of an inbox that have come since the last call: a stream of file names, whose checkpoint is in the store. A trigger that is run again finds its files in the log."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", FILES_A_TRIGGER).load(inbox).select("path")

    def take(batch: DataFrame, n: int) -> None:
        import_new(batch.sparkSession, folder, [r.path for r in batch.collect()], now)  # at most FILES_A_TRIGGER names

    files.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/inbox").foreachBatch(take).start().awaitTermination()


