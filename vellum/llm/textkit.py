"""Whole batches of texts as arrays: words, their hashes, their tokens."""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; what a worker holds follows from it, or from one text that is longer.
CHUNK = 1_000_000


def released(*, tokenizers: bool = True) -> None:
    """Gives memory that this worker has freed, and tables that are soon made again, back to the machine; workers live on after their tasks, beside others.

    With tokenizers, also the tokenizers that earlier tasks of other operators have left, and all they remember.
    """
    _powers.clear()
    if tokenizers:
        WordTokenizer._own.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_column(column: pa.Array) -> pa.Array:
    """Strings without nulls (null: empty), with 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    at = np.frombuffer(texts.buffers()[1], dtype="i8")[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end of the last."""
    at = np.frombuffer(texts.buffers()[1], dtype="i8")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype="u1"), at - at[0]
    return np.frombuffer(data, dtype="u1")[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run without ASCII white space; runs end with their text. Third: of each text, its first run."""
    if not len(data):
        none = np.zeros(0, dtype="i8")
        return none, none, np.zeros(len(at), dtype="i8")
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j, modulo 2**64, for j below n."""
    if n > CHUNK + 1 or base not in _powers:
        size, inverse = max(n, CHUNK + 1), pow(base, -1, 1 << 64)
        made = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, b, dtype="u8")))) for b in (base, inverse))
        if n > CHUNK + 1:  # for one word that is longer; not kept
            return made
        _powers[base] = made
    return _powers[base]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, from two polynomials over prefix sums and the length.

    Where a word stands doesn't matter, so a long text is hashed a stretch of words at a time.
    """
    out = np.empty(len(begin), dtype="u8")
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK, "right")))
        lo, hi = int(begin[i]), int(end[j - 1])
        out[i:j] = _stretch_hashes(data[lo:hi], begin[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def _stretch_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = mixed((end - begin).astype("u8"))
    total = np.zeros(len(data) + 1, dtype="u8")
    for base in _BASES:
        up, down = _power(base, len(data) + 1)
        np.multiply(up[: len(data)], data, out=total[1:], casting="unsafe")
        total[1:] += up[: len(data)]
        np.cumsum(total[1:], out=total[1:])
        out = mixed(out ^ ((total[end] - total[begin]) * down[begin]))
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; bytes of other characters are never in that range."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


#: A part that is one run of lower-case Latin-1 letters and then one of marks: two words to the tokenizer.
_PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:;=?-@\[-`{|}~]*)")
_SAFE = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level alphabets write bytes that don't print as characters from U+0100 on.
_WRITTEN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SAFE)}


class WordTokenizer:
    """A tokenizer whose ids of a text are those of its white-space separated parts, one after the other.

    Each different part is encoded once and remembered; a batch then is a gather over arrays. Parts of letters and
    marks go to the model directly, all others through the whole tokenizer.
    """

    MOST = 1_500_000
    _own: dict[int, WordTokenizer] = {}

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.model = self.tokenizer.model
        self._clear()

    @classmethod
    def of(cls, model: bytes) -> WordTokenizer:
        """One for a worker process and model."""
        if (key := hash(model)) not in cls._own:
            cls._own[key] = cls(model)
        return cls._own[key]

    def _clear(self) -> None:
        # parts by their 64-bit hashes: ascending, with begin and length of their ids; new ones are merged in now and then
        self.known = [(np.zeros(0, dtype="u8"), np.zeros(0, dtype="u4"), np.zeros(0, dtype="u4"))] * 2
        self.flat, self.used = np.zeros(1 << 16, dtype="u4"), 0
        self.runs: dict[str, bytes] = {"": b""}

    def _ids(self, part: bytes) -> bytes:
        text, runs = part.decode(), self.runs
        if not (m := _PLAIN.fullmatch(text.lower())):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        a, b = m.groups()
        for x in (a, b):
            if x not in runs:
                runs[x] = array("I", [t.id for t in self.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(_WRITTEN))]).tobytes()
        return runs[a] + runs[b]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """hashes: ascending, none of them known."""
        if len(self.runs) > self.MOST // 6:
            self.runs = {"": b""}
        got = [self._ids(x) for x in parts]
        length = np.fromiter(map(len, got), dtype="u4", count=len(got)) // 4
        new = np.frombuffer(b"".join(got), dtype="u4")
        while self.used + len(new) >= len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(new)] = new
        begin = (self.used + np.cumsum(length) - length).astype("u4")
        self.used += len(new)
        fresh = _merged(self.known[1], (hashes, begin, length))
        if 8 * len(fresh[0]) > len(self.known[0][0]):
            self.known = [_merged(self.known[0], fresh), tuple(x[:0] for x in fresh)]
        else:
            self.known = [self.known[0], fresh]

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is known, and begin and length of its ids."""
        ok, begin, length = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype="i8"), np.zeros(len(hashes), dtype="i8")
        for h, b, n in self.known:
            if len(h):
                at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                hit = h[at] == hashes
                ok |= hit
                begin[hit], length[hit] = b[at[hit]], n[at[hit]]
        return ok, begin, length

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and where each text ends."""
        data, at = raw(texts)
        begin, end, first = words(data, at)
        hashes, where, inverse = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.known[0][0]) + len(self.known[1][0]) > self.MOST:
            self._clear()
        ok, _, _ = self._found(hashes)
        if not ok.all():
            whole, new = data.tobytes(), where[~ok]
            self._learn(hashes[~ok], [whole[i:j] for i, j in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
        _, start, length = self._found(hashes)
        # the end id is one more part after the parts of each text
        many = np.insert(length[inverse], first[1:], 1)
        source = np.insert(start[inverse], first[1:], self.used)
        done = np.cumsum(many)
        index = np.repeat(source - (done - many), many) + np.arange(done[-1] if len(done) else 0)
        self.flat[self.used] = end_id
        return self.flat[index], done[first[1:] + np.arange(len(texts))]


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables, each ascending by its first column, as one."""
    at = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))
