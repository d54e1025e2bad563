"""Words of a text: as Spark columns, as numpy arrays of word hashes, and as check SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a word: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
PUNCTUATION_BYTES = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

#: Bytes hashed at a time, so that a long text needs no more working memory than a short one.
WINDOW_BYTES = 2 << 20

_BASE, _MIX1, _MIX2 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words(text: Column) -> Column:
    """Words of a text in order; none for NULL, empty and blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(key: Column, buckets: int) -> Column:
    """CRC-32 of the key as text, modulo ``buckets``; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _table(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chosen)] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordHasher:
    """64-bit hashes of the words of many texts at once, A-Z lower-cased.

    ``separators``: the bytes between words; all of them ASCII, so that multi-byte characters stay whole.
    """

    def __init__(self, separators: bytes = BLANK_BYTES):
        self.separator = _table(separators)
        self.power = np.cumprod(np.full(1024, _BASE))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, index of the first word of every text and the end of the last); NULL is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        hashes, starts = [], []
        for begin, end in self._windows(data):
            h, s = self._hash(data[begin:end], offsets[np.searchsorted(offsets, begin):np.searchsorted(offsets, end)] - begin)
            hashes.append(h)
            starts.append(s + begin)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)

    def _windows(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans that end behind a separator or at the end of the data."""
        begin = 0
        while begin < len(data):
            end = min(begin + WINDOW_BYTES, len(data))
            while end < len(data) and not self.separator[data[end - 1]]:
                step = np.flatnonzero(self.separator[data[end:end + WINDOW_BYTES]])
                end = end + int(step[0]) + 1 if len(step) else min(end + WINDOW_BYTES, len(data))
            yield begin, end
            begin = end

    def _hash(self, data: np.ndarray, texts_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.separator[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[texts_begin] |= inside[texts_begin]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, dtype=np.uint64), starts
        places = np.flatnonzero(inside)
        word = np.cumsum(first[places]) - 1
        within = places - starts[word]
        if within.max() >= len(self.power):
            self.power = np.cumprod(np.full(int(within.max()) * 2, _BASE))
        terms = (_LOWER[data[places]].astype(np.uint64) + np.uint64(1)) * self.power[within]
        return mix(np.add.reduceat(terms, np.searchsorted(places, starts))), starts


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of k words, index of each text's first run); a text with 1 to k-1 words has one run."""
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], runs) + np.repeat(first[:-1], runs)
    short = np.repeat(np.where(n >= k, k, n), runs)
    out = h[at]
    for j in range(1, k):
        more = short > j
        out = np.where(more, mix(out * _BASE + h[np.minimum(at + j, len(h) - 1)]), out) if len(h) else out
    return out, begin


def row_chunks(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least; bounds working memory, drops nothing."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


# Check SQL -----------------------------------------------------------------------------------------------------------

SQL_BLANK = r"[\x20\x09-\x0D]+"


def sql_words(text: str) -> str:
    """List of words of a text, as in ``words``."""
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{SQL_BLANK}'), lambda x: x <> '')"


def sql_lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_U = "4294967296"


def _sql_rotl(x: str, n: int) -> str:
    return f"((({x}) * {2 ** n}) % {_U} + ({x}) // {2 ** (32 - n)})"


def _sql_round(h: str, k: str) -> str:
    """One round of MurmurHash3 (32 bit) on unsigned numbers held in HUGEINT."""
    k1 = f"(({k}) * 3432918353) % {_U}"
    k2 = f"({_sql_rotl(k1, 15)} * 461845907) % {_U}"
    h1 = f"xor(({h})::BIGINT, ({k2})::BIGINT)::HUGEINT"
    return f"({_sql_rotl(h1, 13)} * 5 + 3864292196) % {_U}"


def sql_murmur(text: str, seed: str = "42::HUGEINT") -> str:
    """``hash(text)`` of Spark as a signed number: MurmurHash3 over 4-byte words, then over single signed bytes."""
    hexed = f"hex(encode({text}))"
    n = f"(length({hexed}) // 2)"
    byte = "('0x' || substr({0}, ({1}) * 2 + 1, 2))::HUGEINT"
    word = " + ".join(f"{byte.format(hexed, f'i * 4 + {j}')} * {256 ** j}" for j in range(4))
    last = byte.format(hexed, "i")
    blocks = f"list_transform(range({n} // 4), lambda i: {word})"
    tail = (f"list_transform(range({n} // 4 * 4, {n}), lambda i: CASE WHEN {last} > 127 "
            f"THEN {last} + {2 ** 32 - 256} ELSE {last} END)")
    folded = f"list_reduce([{seed}] || {blocks} || {tail}, lambda h, k: {_sql_round('h', 'k')})"
    return _sql_finish(folded, f"{n}::HUGEINT")


def sql_murmur_long(number: str, seed: str = "42::HUGEINT") -> str:
    """``hash(number)`` of Spark for a BIGINT that is not negative."""
    low, high = f"(({number})::HUGEINT % {_U})", f"(({number})::HUGEINT // {_U})"
    return _sql_finish(f"list_reduce([{seed}, {low}, {high}], lambda h, k: {_sql_round('h', 'k')})", "8::HUGEINT")


def _sql_finish(h: str, length: str) -> str:
    steps = [f"xor(h::BIGINT, ({length})::BIGINT)::HUGEINT",
             f"(xor(h::BIGINT, (h // {2 ** 16})::BIGINT)::HUGEINT * 2246822507) % {_U}",
             f"(xor(h::BIGINT, (h // {2 ** 13})::BIGINT)::HUGEINT * 3266489909) % {_U}",
             f"xor(h::BIGINT, (h // {2 ** 16})::BIGINT)::HUGEINT",
             f"CASE WHEN h >= {2 ** 31} THEN h - {_U} ELSE h END"]
    out = f"[{h}]"
    for s in steps:
        out = f"list_transform({out}, lambda h: {s})"
    return f"({out})[1]::BIGINT"


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, a number of four bits at a time."""
    hexed = f"hex(encode({text}))"
    digits = f"list_transform(range(length({hexed}) // 2 * 2), lambda i: ('0x' || substr({hexed}, i + 2 - 2 * (i % 2), 1))::BIGINT)"
    steps = "list_reduce([xor(h, k) % 16, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || {digits}, lambda h, k: xor(h // 16, {steps})), 4294967295)"
