"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.text import BLANK_BYTES, PUNCTUATION_BYTES, WordHasher, mix, row_chunks, shingle_hashes
from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle

#: Shortest tile, in tokens, and the share of a benchmark text that tiles must cover.
MIN_TILE, MIN_COVERAGE = 5, 0.7

#: Benchmark text that is sent to every task; more of it is met by joins. Both ways give the same rows.
BENCHMARK_BYTES = 16 << 20

#: Bits of the table of benchmark seeds by which documents drop theirs before a join: 16 MB, whatever the benchmark's size.
SEED_BITS, _BITS_A_ROW = 1 << 27, 1 << 15

#: What stands beside the first and last token of a document, and of an item; equal to no token and not to each other.
_DOC_EDGE, _ITEM_EDGE = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0xA0761D6478BD642F)


def tiles(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of one document and one item: (place in the document, place in the item, length).

    ``at_doc``, ``at_item``: all places where k tokens of both agree. Seeds on one diagonal that follow each other are one
    maximal match. The longest match is marked first (ties: first in the item, then in the document); of a match that
    overlaps marked tokens, the free runs of k tokens or more are put back in line.
    """
    order = np.lexsort((at_item, at_doc - at_item))
    at_doc, at_item = at_doc[order], at_item[order]
    begins = np.ones(len(at_item), dtype=bool)
    begins[1:] = (np.diff(at_item) != 1) | (np.diff(at_doc) != 1)
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, len(at_item))) + k - 1
    return mark(len(doc), len(item), at_doc[first], at_item[first], length, k)


def mark(doc_size: int, item_size: int, at_doc: np.ndarray, at_item: np.ndarray, length: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of all maximal matches, each given by its two places and its length."""
    waiting: dict[int, list[tuple[int, int]]] = {}
    for d, i, n in zip(at_doc.tolist(), at_item.tolist(), length.tolist()):
        waiting.setdefault(n, []).append((i, d))
    doc_free, item_free = np.ones(doc_size, dtype=bool), np.ones(item_size, dtype=bool)
    left = min(doc_size, item_size)
    out = []
    while waiting:
        n = max(waiting)
        for i, d in sorted(waiting.pop(n)):
            free = item_free[i:i + n] & doc_free[d:d + n]
            if free.all():
                out.append((d, i, n))
                item_free[i:i + n] = doc_free[d:d + n] = False
                left -= n
                if left < k:
                    return out
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if e - s >= k:
                    waiting.setdefault(e - s, []).append((i + s, d + s))
    return out


@dataclass
class _Windows:
    """Windows of all items of one size, sorted by hash and by the token beside them, on the left or on the right."""

    h: np.ndarray
    beside: np.ndarray
    item: np.ndarray
    at: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.beside, self.h))
        self.h, self.beside, self.item, self.at = self.h[order], self.beside[order], self.item[order], self.at[order]
        new = np.ones(len(self.h), dtype=bool)
        new[1:] = (np.diff(self.h) != 0) | (np.diff(self.beside) != 0)
        first = np.flatnonzero(new)
        pair = _pair(self.h[first], self.beside[first])
        order = np.argsort(pair, kind="stable")
        self.pair, self.first, self.last = pair[order], first[order], np.append(first[1:], len(self.h))[order]

    def differing(self, h: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place here, place in ``h``) of all equal windows with another token beside them: where matches begin or end.

        Matches are never listed seed by seed, so a text of one repeated token costs by its length, not by its square.
        """
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        hit = np.flatnonzero(hi > lo)
        lo, hi, pair = lo[hit], hi[hit], _pair(h[hit], beside[hit])
        place = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        same = (self.pair[place] == pair) & (self.h[self.first[place]] == h[hit])
        low, times = np.append(lo, np.where(same, self.last[place], hi)), np.append(np.where(same, self.first[place], hi) - lo, hi)
        times[len(lo):] -= low[len(lo):]
        before = np.cumsum(times) - times
        return np.repeat(low - before, times) + np.arange(times.sum()), np.repeat(np.append(hit, hit), times)


def _pair(h: np.ndarray, beside: np.ndarray) -> np.ndarray:
    return mix(h * _DOC_EDGE + mix(beside ^ _ITEM_EDGE))


def _beside(flat: np.ndarray, at: np.ndarray, edge: np.ndarray, what: np.uint64) -> np.ndarray:
    """Tokens at places, or ``what`` where a text ends."""
    return np.where(edge, what, flat[np.clip(at, 0, max(len(flat) - 1, 0))]) if len(flat) else np.zeros(0, dtype=np.uint64)


@dataclass
class ItemIndex:
    """Token hashes of benchmark items, and their k-token windows sorted by running hash."""

    ids: list
    tokens: list[np.ndarray]
    k: int

    def __post_init__(self):
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.flat = np.concatenate([*self.tokens, np.zeros(0, dtype=np.uint64)])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        self.sizes = sorted({min(self.k, n) for n in lengths.tolist() if n})
        self.seeds = {}
        for size in self.sizes:  # a text shorter than the shortest tile must be found whole
            mine = np.flatnonzero(np.minimum(lengths, self.k) == size)
            at = np.concatenate([np.arange(lengths[i] - size + 1) for i in mine])
            item = np.repeat(mine, lengths[mine] - size + 1)
            h, place = _windows(self.flat, begin[item] + at, size), begin[item] + at
            self.seeds[size] = (_Windows(h, _beside(self.flat, place - 1, at == 0, _ITEM_EDGE), item, at),
                                _Windows(h, _beside(self.flat, place + size, at + size == lengths[item], _ITEM_EDGE), item, at))

    def matches(self, doc: np.ndarray, windows: dict[int, np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item number, tiles) of every item that shares a seed with the document.

        On a diagonal, matches begin and end in turn; so the sorted beginnings and ends are each other's.
        """
        for size in self.sizes:
            h = windows[size]
            place, sides = np.arange(len(h)), []
            for side, beside in zip(self.seeds[size], (_beside(doc, place - 1, place == 0, _DOC_EDGE),
                                                       _beside(doc, place + size, place + size == len(doc), _DOC_EDGE))):
                here, at_doc = side.differing(h, beside)
                item, at_item = side.item[here], side.at[here]
                order = np.lexsort((at_doc, at_doc - at_item, item))
                sides.append((item[order], at_doc[order], at_item[order]))
            (item, at_doc, at_item), (_, ends, _) = sides
            length = ends - at_doc + size
            for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else []:
                i = int(item[part[0]])
                yield i, mark(len(doc), len(self.tokens[i]), at_doc[part], at_item[part], length[part], size)


def _windows(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` tokens that begin at the given places; equal to those of ``shingle_hashes``."""
    first = np.stack([at, at + size], axis=1).reshape(-1)
    gathered = flat[(at[:, None] + np.arange(size)).reshape(-1)]
    return shingle_hashes(gathered, np.arange(len(at) + 1) * size, size)[0] if len(first) else np.zeros(0, dtype=np.uint64)


def _hasher() -> WordHasher:
    return WordHasher(BLANK_BYTES + PUNCTUATION_BYTES)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE,
                      min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(``id_col``, text_key, ``item_col``, n_tokens, n_covered, n_tiles, coverage): documents that hold a benchmark text.

    Tokens are runs between white space and ASCII punctuation, with A-Z lower-cased. Tiles of ``min_tile`` tokens or more
    are marked greedily, longest first, wherever they stand in the document, so a passage whose parts were moved around
    is found too. A row is given where tiles cover ``min_coverage`` of the benchmark text.

    A benchmark of up to ``BENCHMARK_BYTES``, as common test suites are, goes to the tasks whole; documents without a shared run
    of tokens end at the seed lookup, and none is shuffled. A larger one stays distributed: seeds of documents that a bit table of
    all benchmark seeds lets through are joined with those of the items, and a document meets the items of which it holds as
    many seeds as the coverage asks for.

    NULL and empty texts on either side match nothing; a benchmark text shorter than ``min_tile`` tokens must occur whole.
    Repeated document rows each give their rows, repeated benchmark rows are one. NULL ids are kept as they are.
    ``text_key`` is ``xxhash64`` of the document's text. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).where("length(t) > 0").distinct()
    items = settle(items, "benchmark")
    mine = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    if size <= BENCHMARK_BYTES:
        part = [(r["item"], r["t"]) for r in items.collect()]
        out = _search(mine, part, items.schema["item"].dataType.simpleString(), min_tile, min_coverage)
    else:
        out = _search_joined(mine, items, min_tile, min_coverage)
    return out.withColumnsRenamed({"id": id_col, "item": item_col if item_col != id_col else f"benchmark_{item_col}"})


def _search_joined(docs: DataFrame, items: DataFrame, k: int, min_coverage: float) -> DataFrame:
    """The search with both sides distributed; the driver sees the seed sizes and the bit table, both of fixed size.

    Tiles that cover c tokens hold c / k seeds of the item or more, counted with their repeats in it, so pairs with fewer
    cannot reach the coverage and are left out before any text is moved. What is left is tiled on the texts themselves.
    """
    keyed = items.withColumn("i", F.xxhash64("item", "t"))
    seeds = settle(keyed.select("i", "t").mapInArrow(_item_seeds(k), "i bigint, size int, h bigint, times bigint, n bigint"), "seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    bit = F.pmod(F.col("h"), F.lit(SEED_BITS))
    rows = seeds.groupBy(F.floor(bit / _BITS_A_ROW).cast("int").alias("row")).agg(F.bitmap_construct_agg(bit % _BITS_A_ROW).alias("bits"))
    table = np.zeros(SEED_BITS >> 3, dtype=np.uint8)
    for r in rows.collect():
        table[r["row"] * (_BITS_A_ROW >> 3):][:_BITS_A_ROW >> 3] = np.frombuffer(r["bits"], dtype=np.uint8)
    bits = docs.sparkSession.sparkContext.broadcast(table)
    known = docs.select("text_key", "text").mapInArrow(_doc_seeds(sizes, bits), "text_key bigint, size int, h bigint").distinct()
    met = known.join(seeds, ["size", "h"]).groupBy("text_key", "i", "size", "n").agg(F.sum("times").alias("times"))
    pairs = settle(met.where(F.col("times") * F.col("size") >= F.lit(min_coverage) * F.col("n")).select("text_key", "i").distinct(), "pairs")
    both = docs.join(pairs, "text_key").join(keyed, "i").select("id", "text_key", "text", "item", "t")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return both.mapInArrow(_tiled(k, min_coverage), f"id {kinds['id']}, text_key bigint, item {kinds['item']}, {_FOUND}")


_FOUND = "n_tokens bigint, n_covered bigint, n_tiles bigint, coverage double"


def _item_seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for rows in row_chunks(batch, "t"):
                h, first = hasher(rows.column("t"))
                keys = rows.column("i").to_numpy(zero_copy_only=False)
                for row, n in enumerate(np.diff(first).tolist()):
                    if n:
                        size = min(k, n)
                        seeds, times = np.unique(_windows(h[first[row]:first[row + 1]], np.arange(n - size + 1), size), return_counts=True)
                        same = np.ones(len(seeds), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(same * keys[row]), pa.array((same * size).astype(np.int32)), pa.array(seeds.view(np.int64)),
                             pa.array(times.astype(np.int64)), pa.array(same * n)], ["i", "size", "h", "times", "n"])
    return run


def _doc_seeds(sizes: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = _hasher(), bits.value
        for batch in batches:
            for rows in row_chunks(batch, "text"):
                h, first = hasher(rows.column("text"))
                keys = rows.column("text_key").to_numpy(zero_copy_only=False)
                for size in sizes if len(h) else []:
                    runs, begin = shingle_hashes(h, first, size)
                    at = runs & np.uint64(SEED_BITS - 1)
                    hits = np.flatnonzero(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(begin, hits, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[row]), pa.array(np.full(len(hits), size, dtype=np.int32)), pa.array(runs[hits].view(np.int64))],
                        ["text_key", "size", "h"])
    return run


def _tiled(k: int, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for rows in row_chunks(batch, "text"):
                (h, first), (t, begin) = hasher(rows.column("text")), hasher(rows.column("t"))
                found = []
                for row in range(rows.num_rows):
                    index = ItemIndex([None], [t[begin[row]:begin[row + 1]]], k)
                    found += _reached(row, h[first[row]:first[row + 1]], index, min_coverage)
                at = pa.array([f[0] for f in found], pa.int32())
                yield _rows_found(rows, at, rows.column("item").take(at), found)
    return run


def _reached(row: int, doc: np.ndarray, index: ItemIndex, min_coverage: float) -> list[tuple]:
    """(row, item number, n_tokens, n_covered, n_tiles, coverage) of the items that a document covers."""
    windows = {s: _windows(doc, np.arange(max(0, len(doc) - s + 1)), s) for s in index.sizes}
    found = []
    for i, marked in index.matches(doc, windows):
        n, covered = len(index.tokens[i]), sum(m for _, _, m in marked)
        if covered >= min_coverage * n:
            found.append((row, i, n, covered, len(marked), covered / n))
    return found


def _rows_found(rows: pa.RecordBatch, at: pa.Array, items: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    kinds = {"n_tokens": pa.int64(), "n_covered": pa.int64(), "n_tiles": pa.int64(), "coverage": pa.float64()}
    return pa.RecordBatch.from_arrays(
        [rows.column("id").take(at), rows.column("text_key").take(at), items,
         *[pa.array([f[j + 2] for f in found], kind) for j, kind in enumerate(kinds.values())]], ["id", "text_key", "item", *kinds])


def _search(docs: DataFrame, part: list[tuple], item_type: str, k: int, min_coverage: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        h, first = hasher(pa.array([t for _, t in part], pa.string()))
        index = ItemIndex([i for i, _ in part], [h[a:b] for a, b in zip(first[:-1], first[1:])], k)
        for batch in batches:
            for rows in row_chunks(batch, "text"):
                h, first = hasher(rows.column("text"))
                found = []
                for row in _with_seeds(h, first, index):
                    found += _reached(row, h[first[row]:first[row + 1]], index, min_coverage)
                at = pa.array([f[0] for f in found], pa.int32())
                yield _rows_found(rows, at, pa.array([index.ids[f[1]] for f in found], item_arrow), found)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    item_arrow = to_arrow_type(_parse_datatype_string(item_type))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, text_key bigint, item {item_type}, {_FOUND}")


def _with_seeds(h: np.ndarray, first: np.ndarray, index: ItemIndex) -> list[int]:
    """Rows of a batch that share a seed with any item."""
    rows: set[int] = set()
    for size in index.sizes:
        seeds = index.seeds[size][0].h
        if not len(h):
            continue
        runs, begin = shingle_hashes(h, first, size)
        place = np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)
        hits = np.flatnonzero(seeds[place] == runs)
        rows.update(np.unique(np.searchsorted(begin, hits, side="right") - 1).tolist())
    return sorted(rows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, with all their columns."""
    found = benchmark_matches(docs, benchmark, id_col, text_col, **options)
    gone = found.select(F.col(id_col).alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text_col) == F.col("_gone_key"))
    return docs.join(broadcast_if_small(settle(gone, "gone"), max_rows=2_000_000), same, "left_anti")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
