"""Language identification by hyperdimensional profiles.

Every letter class has a fixed random vector of +1 and -1 in ``DIM`` dimensions. A letter trigram
is bound by multiplying its three vectors, the first rotated by two places and the second by one, so
order counts. A text is the bundle (sum) of its trigrams' vectors with their counts; a language's prototype is
the bundle of its learning texts. Prediction takes the prototype of largest cosine.

The score is the cosine of the text's bundle, all ``DIM`` dimensions of it, with the prototype. Trigram vectors are kept in a
table of bounded size. Prototypes are centred: the mean over languages of the unit
prototypes is taken off, as all share the frequent patterns of word borders.

Learning: each task bundles the texts of each language that it reads and returns one vector a
language; the sums over tasks are what comes to the driver: languages x DIM numbers.

Letters: a-z have a class each, other letters fold by code point into further classes
(``CLASSES`` in all); runs of all else are one border. Texts are lower-cased first.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the
first language in code point order; rows with null lang teach nothing; with nothing learned all is
``und``; an empty table gives no rows. Null doc_ids predict as others and teach nothing; repeated rows teach and are told
each for itself. Whole texts are read, in slices, very long ones too; extra columns are not read unless carried.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import column_bytes, lean, narrow, slices

DIM = 2048
CLASSES = 128
SEED = 20240229
SPAN = CLASSES**3


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; 0 is no letter. Others: see ``classes``."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        if chr(cp).isalpha():
            out[cp] = 1 + cp - 97 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 11) % (CLASSES - 27)
    return out


def classes(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = class_table()[np.minimum(cps, 0xFFFF)]
    if len(cps) and cps.max() > 0xFFFF:
        high = np.flatnonzero(cps > 0xFFFF)
        alpha = np.array([chr(c).isalpha() for c in cps[high].tolist()])
        low[high] = np.where(alpha, 27 + (cps[high].astype(np.uint64) * np.uint64(2654435761) >> np.uint64(11)) % np.uint64(CLASSES - 27), 0)
    return low


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, document of each code): a trigram is a letter with its two neighbours, of which borders (runs of what is no letter) may be one or both."""
    joined = "\n" + "\n".join(t.replace("\n", " ") for t in texts).lower() + "\n"
    c = classes(joined)
    doc = np.cumsum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") == 10) - 1
    keep = (c > 0) | np.r_[True, c[:-1] > 0]
    c, doc = c[keep].astype(np.int64), doc[keep]
    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    letter = c[1:-1] > 0
    return code[letter], doc[1:-1][letter]


class Space:
    """Letter vectors, and trigram vectors bound from them."""

    def __init__(self):
        letters = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM), dtype=np.int8) * 2 - 1
        self.third, self.second, self.first = letters, np.roll(letters, 1, 1), np.roll(letters, 2, 1)

    def bound(self, code: np.ndarray) -> np.ndarray:
        return self.first[code // CLASSES**2] * self.second[code // CLASSES % CLASSES] * self.third[code % CLASSES]

    def bundle(self, code: np.ndarray) -> np.ndarray:
        count = np.bincount(code, minlength=1)
        types = np.flatnonzero(count)
        out = np.zeros(DIM)
        for a in range(0, len(types), 1024):
            out += count[types[a : a + 1024]].astype(np.float32) @ self.bound(types[a : a + 1024]).astype(np.float32)
        return out


@lru_cache(1)
def space() -> Space:
    return Space()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _decoded(col: pa.Array):
    data, offs = column_bytes(col)
    for a, b in slices(offs, 1 << 20):
        raw, at = data[offs[a] : offs[b]].tobytes(), (offs[a : b + 1] - offs[a]).tolist()
        yield a, b, [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:])]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, centred unit prototypes) from documents whose crc32(doc_id) mod 4 is not 2 and whose lang is not null."""
    known = narrow(docs, "doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, texts in _decoded(batch.column(0)):
                code, doc = trigrams(texts)
                for lang in set(langs[a:b]):
                    mine = code[(langs[a:b] == lang)[doc]]
                    total.setdefault(lang, np.zeros(DIM))
                    total[lang] += space().bundle(mine)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = known.select("text", "lang").mapInArrow(lean(run), "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    got = sorted((r.lang, np.array(r.v)) for r in rows)
    if not got:
        return [], np.zeros((0, DIM))
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for _, v in got])
    if len(got) > 1:
        unit = unit - unit.mean(0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return [k for k, _ in got], unit


class Scorer:
    """Cosines of texts' bundles with the prototypes."""

    KEEP = 8192  # trigram vectors kept: 16 MB
    STEP = 512

    def __init__(self, prototypes: np.ndarray):
        self.prototypes = np.ascontiguousarray(prototypes.T, np.float32)
        self.row = np.full(SPAN, -1, np.int32)
        self.table = np.zeros((self.KEEP, DIM), np.int8)
        self.taken, self.wide = np.empty((self.STEP, DIM), np.int8), np.empty((self.STEP, DIM), np.float32)
        self.n = 0

    def rows(self, types: np.ndarray) -> np.ndarray:
        """Places of trigrams, at most ``KEEP`` at once, in the table."""
        fresh = types[self.row[types] < 0]
        if self.n + len(fresh) > self.KEEP:
            self.row[:], self.n = -1, 0
            fresh = types
        for a in range(0, len(fresh), 1024):
            self.table[self.n + a : self.n + a + len(fresh[a : a + 1024])] = space().bound(fresh[a : a + 1024])
        self.row[fresh] = np.arange(self.n, self.n + len(fresh))
        self.n += len(fresh)
        return self.row[types]

    def scores(self, code: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, trigrams) of n documents."""
        out = np.zeros((n, self.prototypes.shape[1]))
        key = doc.astype(np.int64) * SPAN + code
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(key)]).astype(np.float32)
        types, of = key[first] % SPAN, key[first] // SPAN
        at = np.searchsorted(of, np.arange(n + 1)).tolist()
        for d in range(n):
            bundle = np.zeros(DIM, np.float32)
            for a in range(at[d], at[d + 1], self.STEP):
                b = min(a + self.STEP, at[d + 1])
                taken, wide = self.taken[: b - a], self.wide[: b - a]
                np.take(self.table, self.rows(types[a:b]), 0, taken, "clip")
                np.copyto(wide, taken)
                bundle += count[a:b] @ wide
            size = float(np.linalg.norm(bundle))
            if size > 0:
                out[d] = bundle @ self.prototypes / size
        return out, np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, int)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str] = (), prefix: str = "") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 where negative), and the carried columns with ``prefix`` before their names."""
    names, prototypes = model
    labels = np.array(names or ["und"], object)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *[docs[c].alias(f"_c_{c}") for c in carry])
    told_schema = "doc_id long, held_out boolean, lang_pred string, score double"
    out_schema = T.StructType([*T._parse_datatype_string(told_schema).fields, *[T.StructField(f"{prefix}{c}", docs.schema[c].dataType) for c in carry]])
    out_names = out_schema.fieldNames()

    def run(batches):
        scorer = Scorer(prototypes)
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in _decoded(batch.column(1)):
                code, doc = trigrams(texts)
                cos, n = scorer.scores(code, doc, b - a) if names else (np.zeros((b - a, 1)), np.zeros(b - a, int))
                best = cos.argmax(1)
                told = (n > 0) & bool(names)
                mine = ids.slice(a, b - a)
                cols = [
                    mine,
                    pa.array([held_out(d) for d in mine.to_pylist()]),
                    pa.array(np.where(told, labels[best], "und"), pa.string()),
                    pa.array(np.where(told, np.clip(cos[np.arange(b - a), best], 0, 1), 0.0)),
                ]
                cols += [batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, out_names)

    return plain.mapInArrow(lean(run), out_schema)
