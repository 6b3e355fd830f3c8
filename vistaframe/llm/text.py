"""Vectorised word access to Arrow text columns.

A word is a longest run of ASCII letters and digits and of non-ASCII characters;
letters of all scripts are folded to lower case. Everything works on the raw
UTF-8 buffer of a whole Arrow chunk at once: one prefix sum of byte values times
powers of an odd constant gives the 64-bit hash of every word (multiplied by the
inverse power of its start), so no Python code runs per document or word.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_REGEX = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULT = np.uint64(_BASE)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
_ONE = np.uint64(1)
CHUNK_BYTES = 1 << 20

_is_word = np.zeros(256, bool)
_is_word[48:58] = _is_word[65:91] = _is_word[97:123] = _is_word[128:] = True
_no_space = np.ones(256, bool)
_no_space[[9, 10, 11, 12, 13, 32]] = False
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + (1 << 16))
        _tables["up"], _tables["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _tables["up"], _tables["down"]


def release() -> None:
    """Gives freed memory back to the system; workers live on, and what they hold counts for the executor."""
    if len(_tables.get("up", ())) > 4 * CHUNK_BYTES:  # grown for one long text
        _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x *= _FINAL
    x ^= x >> np.uint64(29)
    x *= _MULT
    x ^= x >> np.uint64(32)
    return x


def hash_str(s: str) -> int:
    """A 64-bit hash of a string that is the same in every process."""
    h = 1469598103934665603
    for b in s.encode():
        h = (h ^ b) * 1099511628211 & (1 << 64) - 1
    return h


def _lower(column: pa.Array) -> pa.Array:
    """Lower case where letters beyond ASCII and Latin-1 (lead bytes from 0xC4 on) occur; the others are folded byte by byte later."""
    held = column.buffers()[2]
    if held is None or not len(column):
        return column
    off = np.frombuffer(column.buffers()[1], np.int64)[[column.offset, column.offset + len(column)]]
    if (np.frombuffer(held, np.uint8)[off[0] : off[1]] >= 0xC4).any():
        try:
            return pc.utf8_lower(column)
        except pa.ArrowInvalid:  # not UTF-8
            pass
    return column


class Words:
    """Words of a chunk: hash, row, and byte span within ``data`` (row offsets in ``off``).

    Raw words are what white space parts, unfolded. Without ``fold`` case is kept, and byte spans are those of the
    text as it is; the words are the same in number and place, as lower case never adds or ends one.
    """

    __slots__ = ("data", "end", "hash", "off", "row", "rows", "start")

    def __init__(self, column: pa.Array, raw: bool = False, fold: bool = True) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if fold and not raw:
            column = _lower(column)
        self.rows = n_rows = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n_rows + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and n_rows else np.empty(0, np.uint8)
        self.off = off = off - off[0] if n_rows else np.zeros(1, np.int64)
        self.data, n = data, len(data)
        if not n:
            self.start = self.end = np.empty(0, np.int64)
            self.hash, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        low = data
        if fold and not raw:
            low = _fold[data]
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1
            latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
            low[latin] += 32
        inside = (_no_space if raw else _is_word)[data]
        # a boundary between rows always parts words: edges lists the changes of inside, with such boundaries added
        edge = np.empty(n + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        begin = edge[:-1] & inside
        finish = edge[1:] & inside
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] |= inside[cut]
        finish[cut - 1] |= inside[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        up, down = _power_tables(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        value = low.astype(np.uint64)
        value += _ONE
        value *= up[:n]
        np.cumsum(value, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.row = np.searchsorted(off, self.start, side="right") - 1

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch with about ``limit`` bytes of text each; a longer text stays whole."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; len(h) - n + 1 values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    g = h[:m].copy()
    for k in range(1, n):
        g *= _MULT
        g += h[k : k + m]
    return mix(g)


def row_ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and first positions of the n-grams that lie within one row."""
    g = ngram_hash(h, n)
    at = np.flatnonzero(row[: len(g)] == row[n - 1 :]) if len(g) else np.empty(0, np.int64)
    return g[at], row[at], at


def pack(x: np.ndarray, width: int) -> bytes:
    """An array of unsigned numbers below 256**width, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"\0" * 8


def unpack(b: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(b[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()
