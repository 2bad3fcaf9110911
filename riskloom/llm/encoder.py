"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A byte-pair tokenizer first cuts a text by a pattern and then encodes each part for itself.
``Encoder`` makes cuts only where the pattern certainly cuts - around ASCII white space, and
before trailing punctuation that follows a letter or digit - and keeps the library's ids of every
piece between cuts under two independent 64-bit names of the piece's bytes; a hit must agree on both
(128 bits: for 10**13 look-ups against a table of 1.3 million pieces, the chance of one wrong hit is below 1e-19). A text with white space
beyond ASCII's, where the byte-level pattern looks across pieces, goes to the library as a whole, and so does one that holds the
string of a special token: the ids are always those of a plain call of the library on the whole text. ``plain=True`` takes such
strings as ordinary text (the library's ``encode_special_tokens``).

``Subwords`` does the same for a sentencepiece model: no piece of its vocabulary has a space after another character, so cuts lie before each run of spaces.
"""

from __future__ import annotations

import numpy as np

from riskloom.llm.common import LOWER, SPACE, U64, lane, slices, word_spans

PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in ".,;:!?"]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
TABLE_BITS = 21
PROBES = 8


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.specials = [] if plain else [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces are kept here
        self.keeps_space = self.library.normalizer is None  # byte-level with a leading space, or words only
        self.lane, self.second = lane(11), lane(12)
        self.chars = _byte_chars()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((1 << TABLE_BITS) + PROBES, U64)
        self.check = np.zeros((1 << TABLE_BITS) + PROBES, U64)
        self.slot_value = np.zeros((1 << TABLE_BITS) + PROBES, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    # ------------------------------------------------------------ the table of pieces

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Value number of each piece, known by two names, or -1."""
        at = (h >> U64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for p in range(PROBES):
            k = self.keys[at[todo] + p]
            hit = (k == h[todo]) & (self.check[at[todo] + p] == g[todo])
            out[todo[hit]] = self.slot_value[at[todo[hit]] + p]
            todo = todo[~hit & (k != 0)]
            if not len(todo):
                break
        return out

    def add(self, h: np.ndarray, g: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Keep the ids of new, distinct pieces; their value numbers."""
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        while self.n + len(h) > len(self.begin):
            self.begin, self.count = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.count, np.zeros_like(self.count)]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        values = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.begin[values] = self.used + np.r_[0, np.cumsum(counts)[:-1]] if len(h) else 0
        self.count[values] = counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(h), self.used + len(flat)
        at, todo = (h >> U64(64 - TABLE_BITS)).astype(np.int64), np.arange(len(h))
        for p in range(PROBES):  # what finds no free slot is encoded again when it comes again
            slot = at[todo] + p
            free = self.keys[slot] == 0
            owner = np.full(len(slot), -1)
            taken, last = np.unique(slot[free][::-1], return_index=True)  # of several that want one slot, one gets it
            owner[np.flatnonzero(free)[::-1][last]] = 1
            won = owner > 0
            self.keys[slot[won]], self.check[slot[won]], self.slot_value[slot[won]] = h[todo[won]], g[todo[won]], values[todo[won]]
            todo = todo[~won]
            if not len(todo):
                break
        return values

    # ------------------------------------------------------------ pieces

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of pieces in order; white space that yields no ids is left out."""
        starts, ends, _ = word_spans(data, offs)
        mark = np.zeros(len(data) + 1, bool)
        mark[offs] = True
        if len(starts):
            q = ends.copy()
            for _ in range(4):
                q -= PUNCT[data[q - 1]] & (q - 1 > starts)
            last, before = data[q - 1], data[np.maximum(q - 2, 0)]
            letter = ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (q - 2 >= starts))
            mark[q[letter & (q < ends)]] = True
            mark[ends] = True
            if self.keeps_space:
                inner = starts[~np.isin(starts, offs)] if len(offs) < 64 else starts[~mark_of(offs, len(data))[starts]]
                mark[inner - 1] = True  # a space goes with the word, another white space stands alone
                mark[inner[data[inner - 1] != 0x20]] = True
                mark[starts[mark_of(offs, len(data))[starts]]] = True
            else:
                mark[starts] = True
        ps = np.flatnonzero(mark[: len(data)])
        pe = np.r_[ps[1:], len(data)]
        if not self.keeps_space:
            keep = ~SPACE[data[ps]]
            ps, pe = ps[keep], pe[keep]
        return ps, pe

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            word = t[1:] if self.keeps_space and t[:1] == " " else t
            if word.isascii() and word.isalpha():
                out[i] = [x.id for x in self.model.tokenize("Ġ" + word if word is not t else t)]
            elif self.keeps_space and word.isalpha():
                out[i] = [x.id for x in self.model.tokenize("".join(map(self.chars.__getitem__, t.encode())))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    # ------------------------------------------------------------ texts

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each document) for a slice of documents."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        whole = self.whole_texts(data, offs)
        shown = data if self.keeps_space else LOWER[data]
        ps, pe = self.pieces(data, offs)
        h, g = self.lane.words(shown, ps, pe), self.second.words(shown, ps, pe)
        h[h == 0] = 1
        value = self.find(h, g)
        miss = np.flatnonzero(value < 0)
        if len(miss):
            order = miss[np.lexsort((g[miss], h[miss]))]
            first = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])]
            at = order[first]
            if self.n and self.n + len(at) > 0.6 * (1 << TABLE_BITS):
                self.clear()
                return self.encode(data, offs)
            texts = [shown[a:b].tobytes().decode() for a, b in zip(ps[at].tolist(), pe[at].tolist())]
            value[order] = self.add(h[at], g[at], self.encode_pieces(texts))[np.cumsum(first) - 1]
        begin, count = self.begin[value], self.count[value].astype(np.int64)
        total = np.r_[0, np.cumsum(count)]
        ids = self.pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        each = np.diff(total[np.searchsorted(ps, offs)])
        if len(whole):
            parts, raw = np.split(ids, np.cumsum(each)[:-1]), data.tobytes()
            for i, e in zip(whole.tolist(), self.library.encode_batch([raw[offs[i] : offs[i + 1]].decode() for i in whole], add_special_tokens=False)):
                parts[i], each[i] = np.array(e.ids, np.uint32), len(e.ids)
            ids = np.concatenate(parts)
        return ids, each

    def whole_texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that the library encodes as a whole."""
        found = odd_space(data, offs) if self.keeps_space else np.zeros(0, np.int64)
        if self.specials:
            text, at = LOWER[data].tobytes(), []
            for s in self.specials:
                i = text.find(s)
                while i >= 0:
                    at.append(i)
                    i = text.find(s, i + 1)
            if at:  # a string that lies across two documents only costs time
                found = np.union1d(found, np.searchsorted(offs, at, "right") - 1)
        return found


class Subwords(Encoder):
    """A sentencepiece model over texts that begin with the space the model would add."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        if any("\u2581" in self.library.id_to_piece(i).lstrip("\u2581") for i in range(self.library.get_piece_size())):
            raise ValueError("the model has pieces with a space after another character")
        self.keeps_space = True
        self.lane, self.second = lane(11), lane(12)
        self.clear()

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 0x20
        mark = space.copy()
        mark[1:] &= ~space[:-1]
        mark[offs[:-1][offs[:-1] < offs[1:]]] = True
        ps = np.flatnonzero(mark)
        return ps, np.r_[ps[1:], len(data)]

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        alone = [self.library.piece_to_id("\u2581")]  # a last space; to the library it would be an empty text
        return [alone if t == " " else ids for t, ids in zip(texts, self.library.encode([t[1:] for t in texts], num_threads=1))]

    def whole_texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.int64)


def mark_of(offs: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros(n + 1, bool)
    m[offs] = True
    return m


def odd_space(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents with white space beyond ASCII's: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(lead):
        return lead
    d = np.r_[data, np.zeros(2, np.uint8)]
    a, b, c = d[lead], d[lead + 1], d[lead + 2]
    odd = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return np.unique(np.searchsorted(offs, lead[odd], "right") - 1)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each worker process, until ``forget``; files that end in .model are sentencepiece's."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Subwords(path) if path.endswith(".model") else Encoder(path, plain)
    return _ENCODERS[path, plain]


def forget() -> None:
    """Let go of tokenizers and tables when a task is done; loading one again takes a tenth of a second."""
    _ENCODERS.clear()


def encoded(texts: tuple[np.ndarray, np.ndarray], path: str, end_id: int):
    """(first document, one past the last, ids with ends, offsets) for slices of a batch's documents; ids are uint32."""
    data, offs = texts
    enc = encoder(path)
    for a, b in slices(offs):
        ids, each = enc.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        at = np.r_[0, np.cumsum(each + 1)]
        out = np.full(at[-1], end_id, np.uint32)
        body = np.ones(at[-1], bool)
        body[at[1:] - 1] = False
        out[body] = ids
        yield a, b, out, at
