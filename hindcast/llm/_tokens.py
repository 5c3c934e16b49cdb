"""Token ids of whole texts by the tokenizers library, each distinct word of a batch encoded once.

Both vocabularies split a text before they merge inside the pieces, so the ids of a text are those of its pieces in order.
The pieces are found by numpy, over code points where a space belongs to a piece, else over bytes; the library encodes the
distinct ones; the rest is gathering.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from hindcast.llm._words import Words, slices, texts

OTHER, LETTER, NUMBER, BLANK, UNASSIGNED = range(5)
#: Words that the library gets at once, and as one text.
TOGETHER, JOINED = 500, 2000
#: No byte of a code point below U+0280 reaches this one: which of those are letters or numbers is the same in all tables.
SETTLED = 0xCA
#: Code points of Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe that starts a piece (fixed values of the split pattern).
AFTER_APOSTROPHE = ("s", "t", "re", "ve", "m", "ll", "d")

_made: dict = {}


def kinds() -> np.ndarray:
    """Letter, number, white space or other, of each code point; UNASSIGNED is added where Python's tables don't know it."""
    if "kinds" not in _made:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((UNASSIGNED if x == "Cn" else kind.get(x[0], OTHER) for x in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
        table[WHITE_SPACE] = BLANK
        _made["kinds"] = table
    return _made["kinds"]


def points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the code points of two bytes or more begin, and which they are."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    point = first & np.where(first < 0xE0, 0x1F, np.where(first < 0xF0, 0x0F, 0x07)).astype(np.uint32)
    for k, least in enumerate((0xC0, 0xE0, 0xF0), 1):
        more = np.flatnonzero(first >= least)
        point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
    return lead, point


def unknown(data: np.ndarray, at: np.ndarray) -> list[int]:
    """The texts that hold a code point which Python's Unicode tables have not assigned."""
    lead, point = points(data)
    odd = lead[kinds()[point] == UNASSIGNED]
    return np.unique(np.searchsorted(at, odd, "right") - 1).tolist()


def _library(path: str):
    if path not in _made:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _made[path] = Tokenizer.from_file(path)
        _made[path].encode_special_tokens = True
    return _made[path]


def _bare(path: str):
    """The library's model behind white space alone: settled pieces in the normal form need none of its other steps."""
    if ("bare", path) not in _made:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        _made["bare", path] = Tokenizer(_library(path).model)
        _made["bare", path].pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    return _made["bare", path]


class Pieces(Words):
    """Pieces of texts as the split pattern cuts them, with a leading space."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(point)
        kind = kinds()[point]
        fresh = np.zeros(n + 1, bool)
        fresh[np.searchsorted(lead, at)] = True
        fresh[n] = True
        before = np.zeros(n + 1, bool)  # a run of one kind begins here
        before[0] = before[n] = True
        before[1:n] = (kind[1:] != kind[:-1]) | fresh[1:n]
        start = before[:n].copy()
        blank = kind == BLANK
        ends_blank = np.zeros(n, bool)  # the last of a run of white space that something follows
        ends_blank[:-1] = blank[:-1] & before[1:n] & ~fresh[1:n]
        start |= ends_blank
        joined = np.zeros(n, bool)  # begins behind a space, which the piece takes
        joined[1:] = ends_blank[:-1] & (point[:-1] == 0x20)
        start &= ~joined
        for i in np.flatnonzero((point == 0x27) & before[:n] & before[1:] & ~fresh[1:] & ~joined).tolist():
            rest = point[i + 1 : i + 3].astype(np.uint32).tobytes().decode("utf-32-le")
            found = next((x for x in AFTER_APOSTROPHE if rest.startswith(x) and not fresh[i + 1 : i + 1 + len(x)].any()), None)
            if found:
                start[i + 1] = False
                over = i + 1 + len(found)
                if over < n and not before[over]:
                    start[over] = True
        begin = np.flatnonzero(start)
        edge = np.r_[lead, len(data)]
        self.start, self.end = edge[begin], edge[np.r_[begin[1:], n]] if len(begin) else edge[begin]
        self.first = np.searchsorted(self.start, at)


def solid(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of lower-cased texts as the split pattern that drops white space cuts them, by their bytes; and of each text, its
    first piece's number, and one past the last."""
    n, (lead, point) = len(data), points(data)
    kind, wide = np.frombuffer(bytearray(data).translate(kinds()[:256].tobytes()), np.uint8), kinds()[point]
    first = data[lead]
    for k, least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
        kind[lead[first >= least] + k] = wide[first >= least]
    start, fresh = np.ones(n, bool), np.zeros(n + 2, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    fresh[at] = True
    start[at[:-1][at[:-1] < n]] = True
    # An apostrophe by itself takes these letters, whose run is cut behind them.
    alone = np.flatnonzero(data[:-1] == 0x27)
    alone = alone[start[alone] & start[alone + 1] & ~fresh[alone + 1]]
    padded = np.r_[data, 0, 0]
    one, two = padded[alone + 1], np.where(fresh[alone + 2], 0, padded[alone + 2])
    length = np.zeros(len(alone), np.int64)
    for x in map(str.encode, AFTER_APOSTROPHE):
        length[(one == x[0]) & (two == x[1] if len(x) > 1 else True)] = len(x)
    alone, over = alone[length > 0], (alone + 1 + length)[length > 0]
    start[over[over < n]] = True
    start[alone + 1] = False
    numbers = kind == NUMBER
    if len(lead):
        numbers &= (data & 0xC0) != 0x80
    start |= numbers
    inside = kind != BLANK
    begin = np.flatnonzero(start[inside]).astype(np.int32)
    kept = data[inside]
    number = np.searchsorted(np.flatnonzero(start & inside), at)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, np.int32(len(kept)))), pa.py_buffer(kept)]), number


def spread(lengths: np.ndarray, which: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[w], starts[w]+1, ... (lengths[w] of them) for each w of which, in a row."""
    n = lengths[which]
    to = np.cumsum(n)
    return np.repeat(starts[which] - (to - n), n) + np.arange(to[-1] if len(to) else 0)


def _last(library) -> np.ndarray | None:
    """Of each id, whether it ends a word; None if the vocabulary doesn't tell."""
    suffix = library.model.end_of_word_suffix
    if not suffix:
        return None
    known = library.get_vocab()
    out = np.zeros(max(known.values()) + 1, bool)
    out[[i for x, i in known.items() if x.endswith(suffix)]] = True
    return out


def _encoded(library, last: np.ndarray | None, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of words, and how many each has. last: words may be encoded in one text, for the vocabulary drops white space, and these ids end them."""
    parts = [words[low : low + (TOGETHER if last is None else JOINED)] for low in range(0, len(words), TOGETHER if last is None else JOINED)]
    for part in parts:
        if last is not None:
            ids = np.array(library.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(last[ids])
            if len(ends) == len(part) and ends[-1] == len(ids) - 1:  # else the library splits a word that stands alone otherwise
                yield ids, np.diff(ends, prepend=-1)
                continue
        found = [x.ids for low in range(0, len(part), TOGETHER) for x in library.encode_batch_fast([w.decode() for w in part[low : low + TOGETHER]], add_special_tokens=False)]
        yield np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


class _Memo:
    """Ids of words met before by this worker, by their bytes; forgotten as a whole beyond `most` words, so memory is bounded."""

    def __init__(self, most: int):
        self.most = most
        self.place: dict[bytes, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # of word i: ids[ends[i] : ends[i + 1]]

    def places(self, path: str, words: pa.Array, last: np.ndarray | None) -> np.ndarray:
        """The number of each distinct word, once those not met before are encoded and added."""
        if len(self.place) + len(words) > self.most:
            self.__init__(self.most)
        _, edge, data = words.buffers()
        known = words.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.place.get, known, repeat(-1)), np.int64, len(known))
        unmet = np.flatnonzero(at < 0)
        if len(unmet):
            # A word has a byte at least.
            settled = np.maximum.reduceat(np.frombuffer(data, np.uint8), np.frombuffer(edge, np.int32)[: len(known)])[unmet] < SETTLED if last is not None else np.zeros(len(unmet), bool)
            ids, counts, unmet = [self.ids], [], np.r_[unmet[settled], unmet[~settled]]
            new = [known[i] for i in unmet.tolist()]
            many = int(settled.sum())
            for library, some in ((_bare, new[:many]), (_library, new[many:])):
                for part, n in _encoded(library(path), last, some):
                    ids.append(part), counts.append(n)
            at[unmet] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(new))
            self.place.update(zip(new, at[unmet].tolist(), strict=True))
            self.ends, self.ids = np.r_[self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))], np.concatenate(ids)
        return at


def encode_pieces(path: str, words: pa.Array, first: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each text begins and ends in them. joined: the vocabulary drops white space."""
    memo = _made.setdefault(("memo", path), _Memo(1_000_000 if joined else 500_000))
    if joined and ("last", path) not in _made:
        _made["last", path] = _last(_library(path))
    found = words.dictionary_encode()
    place = memo.places(path, found.dictionary, _made["last", path] if joined else None)
    begin, n = memo.ends[place], memo.ends[place + 1] - memo.ends[place]
    which = found.indices.to_numpy()
    lengths = np.r_[0, np.cumsum(n[which])]
    # The distinct words' ids lie closer together than the memo's.
    near = memo.ids[spread(n, np.arange(len(n)), begin)]
    return near[spread(n, which, np.cumsum(n) - n)], lengths[first]


def lowered(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word vocabulary's normal form: NFC, then lower case code point by code point."""
    raw, size, out, done = data.tobytes(), np.diff(at), [], 0
    plain = raw.lower()  # of ASCII letters
    for i in np.unique(np.searchsorted(at, np.flatnonzero(data >= 0x80), "right") - 1).tolist():
        a, b = int(at[i]), int(at[i + 1])
        out += plain[done:a], unicodedata.normalize("NFC", raw[a:b].decode()).replace("Σ", "σ").lower().encode()
        size[i], done = len(out[-1]), b
    out.append(plain[done:])
    return np.frombuffer(b"".join(out), np.uint8), np.r_[0, np.cumsum(size)]


def encode(path: str, column: pa.Array, spaced: bool, end: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each text as unsigned 32-bit integers, with the end id behind them.

    Texts with a character that Python's tables don't know are left to the library as a whole: its tables may be newer.
    """
    data, at = texts(column)
    for low, high in slices(at, 4 << 20 if spaced else 8 << 20):
        part, cut = data[at[low] : at[high]], at[low : high + 1] - at[low]
        apart = {i: part[cut[i] : cut[i + 1]].tobytes().decode() for i in unknown(part, cut)}
        if spaced:
            pieces = Pieces(part, cut)
            words, first = pieces.strings(np.arange(len(pieces))), pieces.first
        else:
            words, first = solid(*lowered(part, cut))
        ids, bounds = encode_pieces(path, words, first, not spaced)
        last = [] if end is None else [end]
        if last:
            ids, bounds = np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield np.array(_library(path).encode(apart[i], add_special_tokens=False).ids + last, np.uint32) if i in apart else ids[a:b]
