"""One large JSON document cut into its records by all cores.

The text source reads a file in byte ranges and takes ``}`` as the end of a line, so a range holds whole stretches between closing braces, in order, and no escape
or character lies across two ranges. What a range cannot know is whether it begins inside a string, how deep, and which record it is in:

1. ``_summaries``: the parity of its quotes, and its change of depth for either case. Sums over the ranges before give each range its
   state: one row a range.
2. ``_cuts``: with the state known, the places at the records' depth where a record can begin or end, and the opening of the wrapper's list. Sums
   over the ranges before number these cuts through the file; records lie between the cut that opens the list and the one that closes it.
3. ``_pieces``: the text between two cuts. What lies inside a range is a record; the first and last piece of a range are put together by cut number.

A task holds one batch of a range and the record it is in. Ranges of all files are one row each in what is broadcast: 60 bytes for 128 MB.

Defined results: the same records as ``readers.record_texts``, in any order. A document that is not a JSON object or list, or ends inside a string or a bracket,
is an error when it is read, as a record that is not JSON is when it is parsed; an object without the wrapper's list, and an empty list, have no records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.lineage import cut

CLOSE = 0x7D
DEPTH = np.zeros(256, np.int64)
DEPTH[[ord("{"), ord("[")]] = 1
DEPTH[[ord("}"), ord("]")]] = -1
MARK = DEPTH != 0
MARK[ord(",")] = True


class Text:
    """A batch of a range: its bytes, its real quotes, and its brackets and commas."""

    def __init__(self, values: pa.Array):
        self.raw = b"".join(v.as_buffer().to_pybytes() + b"}" for v in values)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        quotes = np.flatnonzero(self.bytes == 0x22)
        slash = self.bytes == 0x5C
        if slash.any():  # a quote after an odd number of backslashes is part of a string
            last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(slash))))
            before = np.where(quotes > 0, last[quotes - 1], -1)
            quotes = quotes[(np.maximum(quotes - 1, -1) - before) % 2 == 0]
        self.quotes = quotes
        self.marks = np.flatnonzero(MARK[self.bytes])
        self.parity = np.searchsorted(quotes, self.marks) % 2

    def outside(self, in_string: int) -> np.ndarray:
        """Places of brackets and commas that are not in a string."""
        return self.marks[self.parity == in_string]

    def key_before(self, at: int) -> str | None:
        """The key whose value begins at a place, if key and value are in one stretch."""
        head = self.raw[:at].rstrip(b" \t\r\n")
        head = head[:-1].rstrip(b" \t\r\n") if head.endswith(b":") else b""
        end = len(head) - 1
        i = int(np.searchsorted(self.quotes, end))
        if end < 0 or i == 0 or i >= len(self.quotes) or self.quotes[i] != end:
            return None
        return json.loads(self.raw[self.quotes[i - 1] : end + 1])


def _ranges(batches, extra: int) -> Iterator[tuple[tuple, Iterator[Text]]]:
    """(key and further columns, batches' texts) of each range in turn; a task may hold several ranges."""

    def runs():
        for batch in batches:
            file, start = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), *[i + 1 for i in range(len(file) - 1) if file[i] != file[i + 1]], len(file)]
            edges = sorted(set(edges))
            for a, b in zip(edges[:-1], edges[1:]):
                yield (file[a], int(start[a]), *[batch.column(3 + i)[a].as_py() for i in range(extra)]), batch.column(0).cast(pa.binary()).slice(a, b - a)

    stream, held = runs(), []

    def texts(key) -> Iterator[Text]:
        while held and held[0][0] == key:
            yield Text(held.pop()[1])
            held.extend([x] if (x := next(stream, None)) else [])

    held.extend([x] if (x := next(stream, None)) else [])
    while held:
        key = held[0][0]
        yield key, texts(key)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


SUMMARY = "file string, start long, quotes long, outside long, inside long, root string"


def _summaries(batches):
    for (file, start), texts in _ranges(batches, 0):
        quotes, depth, root = 0, [0, 0], None
        for t in texts:
            if root is None and start == 0:
                body = t.raw.removeprefix(b"\xef\xbb\xbf").lstrip()
                root = chr(body[0]) if body else None
            for case in (0, 1):
                depth[case] += int(DEPTH[t.bytes[t.outside((case + quotes) % 2)]].sum())
            quotes += len(t.quotes)
        yield _table([(file, start, quotes, *depth, root)], SUMMARY)


def _scan(t: Text, in_string: int, depth: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of cuts, whether each opens, whether each closes, depth at the end): commas at ``level`` and brackets that reach or leave it."""
    at = t.outside(in_string)
    step = DEPTH[t.bytes[at]]
    after = depth + np.cumsum(step)
    opens, closes = (step > 0) & (after == level), (step < 0) & (after == level - 1)
    is_cut = opens | closes | ((step == 0) & (after == level))
    return at[is_cut], opens[is_cut], closes[is_cut], int(after[-1]) if len(after) else depth


CUTS = "file string, start long, cuts long, opening long, closing long, first_closing long"


def _cuts(wrapper: str):
    def run(batches):
        for (file, start, in_string, depth, level), texts in _ranges(batches, 3):
            n, opening, closing, first = 0, None, None, None
            for t in texts:
                at, opens, closes, depth = _scan(t, in_string, depth, level)
                if opening is None:
                    for i in np.flatnonzero(opens).tolist():
                        if t.raw[at[i]] == 0x5B and (level == 1 or t.key_before(int(at[i])) == wrapper):
                            opening = n + i
                            break
                ends = n + np.flatnonzero(closes)
                if len(ends) and first is None:
                    first = int(ends[0])
                if opening is not None and closing is None and (ends > opening).any():
                    closing = int(ends[ends > opening][0])
                n += len(at)
                in_string = (in_string + len(t.quotes)) % 2
            yield _table([(file, start, n, opening, closing, first)], CUTS)

    return run


PIECES = "file string, start long, number long, whole boolean, value string"


def _pieces(batches):
    for (file, start, in_string, depth, level, base, opening, closing), texts in _ranges(batches, 6):
        number, held, first = base - 1, [], True  # the piece that the range begins in follows the last cut before it
        wanted = lambda i: opening is not None and opening <= i < closing
        for t in texts:
            at, _, _, depth = _scan(t, in_string, depth, level)
            in_string = (in_string + len(t.quotes)) % 2
            edges, out = [0, *(at + 1).tolist()], []
            for a, b in zip(edges[:-1], at.tolist()):
                if wanted(number):
                    out.append((file, start, number, not first, b"".join([*held, t.raw[a:b]]).decode()))
                held, first, number = [], False, number + 1
            if wanted(number):
                held.append(t.raw[edges[-1] :])
            yield _table(out, PIECES)
        if held:
            yield _table([(file, start, number, False, b"".join(held).decode())], PIECES)


def records(spark: SparkSession, path: str, wrapper: str) -> DataFrame:
    """(value): the JSON text of every record of every document at ``path``."""
    if "}" in wrapper:
        raise ValueError("a wrapper's name has no closing brace")
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")

    s = cut(text.mapInArrow(_summaries, SUMMARY))
    s = s.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    s = s.withColumn("_step", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    s = s.withColumns({"depth": F.coalesce(F.sum("_step").over(before), F.lit(0)), "_end": F.sum("_step").over(whole), "_quotes": F.sum("quotes").over(whole), "root": F.max("root").over(whole)})
    # a last stretch that does not end in a brace got one; so a document ends at depth 0, or one below
    fine = F.coalesce(F.col("root").isin("[", "{"), F.lit(False)) & (F.col("_quotes") % 2 == 0) & F.col("_end").isin(0, -1)
    s = s.select("file", "start", "in_string", "depth", F.when(fine, F.when(F.col("root") == "[", 1).otherwise(2)).otherwise(F.raise_error(F.concat(F.lit("not a whole JSON object or list: "), "file"))).cast("long").alias("level"))

    known = text.join(F.broadcast(s), ["file", "start"]).select("value", "file", "start", "in_string", "depth", "level")
    c = cut(known.mapInArrow(_cuts(wrapper), CUTS).join(s, ["file", "start"]))
    c = c.withColumn("base", F.coalesce(F.sum("cuts").over(before), F.lit(0))).withColumn("_open", F.min(F.col("base") + F.col("opening")).over(whole))
    closing = F.when(F.col("base") > F.col("_open"), F.col("base") + F.col("first_closing")).when(F.col("base") + F.col("opening") == F.col("_open"), F.col("base") + F.col("closing"))
    c = c.withColumn("_close", F.min(closing).over(whole)).select("file", "start", "in_string", "depth", "level", "base", F.col("_open").alias("opening"), F.col("_close").alias("closing"))

    pieces = text.join(F.broadcast(c), ["file", "start"]).select("value", "file", "start", "in_string", "depth", "level", "base", "opening", "closing").mapInArrow(_pieces, PIECES)
    pieces = cut(pieces)
    split = pieces.where("not whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("_p"))  # the parts of one record
    put = split.select("file", "number", F.concat_ws("", F.transform("_p", lambda p: p["value"])).alias("value"))
    lists = c.groupBy("file").agg(F.min(F.col("closing") - F.col("opening")).alias("_n"))
    both = pieces.where("whole").select("file", "number", "value").unionByName(put)
    return both.join(F.broadcast(lists), "file").where((F.col("_n") > 1) | ~F.col("value").rlike(r"^[ \t\r\n]*$")).select("value")
