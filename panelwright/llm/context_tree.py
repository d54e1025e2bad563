"""Log-probability of texts under a context-tree-weighting model of bytes, and under a smoothed word count.

The model. A byte is eight binary decisions; each decision node has a context tree over the ``DEPTH`` bytes before. Every
node of the tree estimates its bit by Krichevsky-Trofimov counts of the training texts, and a node weighs its own estimate
against those of its longer contexts by how well each would have coded the training texts (half and half before any data).
With the counts fixed, a bit's probability is the mixture along its contexts, so a byte's probability depends on the byte
and the ``DEPTH`` bytes before it alone: one number for each run of ``DEPTH`` + 1 bytes.

The work. Documents form blocks of bounded size. Tasks count the words and byte runs of the blocks they meet and pass them on
as sorted, compressed pieces, cut by a hash of the last ``ROOT`` context bytes. So one task has all runs of a subtree: it adds
up the blocks' counts and builds the subtree's levels in memory, from sorted arrays. Only the sums at the subtrees' roots leave the
task; from them Spark builds the few levels above. A second pass over the pieces goes down again, from what those levels say to
the value of every run, and gives each block the values of the runs and words that occur in it. No task holds the whole model,
and no level below the roots is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, lgamma, log, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelwright.llm.text import WordHasher, row_chunks
from panelwright.sources.writers import settle

#: 7 bytes a run leave room in a 64-bit key; every byte of depth multiplies the distinct runs.
DEPTH = 6
BLOCK_BYTES = 20 << 20
MAX_RANGES = 4096

#: Context bytes that name a subtree, and bytes of text for each part that subtrees and words are dealt to.
ROOT = 3
PART_BYTES = 12 << 20

#: Counted words and byte runs that a task holds before it passes them on.
HELD_ROWS = 2_000_000

#: Bytes of text whose words and runs are looked up at a time.
CHUNK_BYTES = 2 << 20

WORDS, RUNS = 0, 1
_RUN = DEPTH + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Documents to blocks, words and byte runs -----------------------------------------------------------------------------

def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 64


def _blocks(docs: DataFrame) -> Column:
    """Block of every row of (id, text): equal ranges of a numeric id, so that tasks meet few blocks, and a split by a hash
    of id and text where a range holds too many bytes, as under one outlier among the ids."""
    numeric = isinstance(docs.schema["id"].dataType, NumericType)
    whole = docs.agg(F.sum(_size()).alias("bytes"), *([F.min("id").cast("double").alias("lo"), F.max("id").cast("double").alias("hi")] if numeric else [])).first()
    n = min(MAX_RANGES, max(1, ceil((whole["bytes"] or 0) / BLOCK_BYTES)))
    place = F.lit(0)
    if numeric and whole["lo"] is not None and whole["hi"] > whole["lo"]:
        share = (F.col("id").cast("double") - whole["lo"]) / (whole["hi"] - whole["lo"])
        place = F.least(F.coalesce(F.floor(share * n), F.lit(0)), F.lit(n - 1)).cast("int")
    held = {r["r"]: r["bytes"] for r in docs.groupBy(place.alias("r")).agg(F.sum(_size()).alias("bytes")).collect()}
    splits = F.split(F.lit(",".join(str(max(1, round(held.get(r, 0) / BLOCK_BYTES))) for r in range(n))), ",").cast("array<int>")
    return place.cast("long") * (1 << 24) + F.pmod(F.xxhash64("id", "text"), splits[place])


def _parts(rows: DataFrame) -> Column | None:
    """Number of tasks that share a row's block: more than one where a block is still too large, as under one row that is
    repeated very often. Its tasks get the same values, so it does not matter which of them a row goes to. None: one for all."""
    full = rows.groupBy("block").agg(F.sum(_size()).alias("bytes")).where(F.col("bytes") > 2 * BLOCK_BYTES).collect()
    if not full:
        return None
    parts = F.create_map(*[F.lit(x) for r in full for x in (r["block"], ceil(r["bytes"] / BLOCK_BYTES))])
    return F.coalesce(parts[F.col("block")], F.lit(1))


def byte_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(runs, index of each text's first run): every byte and the text's end (0), with the ``DEPTH`` bytes before (0 before
    the text), the oldest in the highest place."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    sizes = np.diff(offsets)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    begin = np.concatenate([[0], np.cumsum(sizes + _RUN)])
    padded = np.zeros(begin[-1], dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(begin[:-1] + DEPTH - (offsets[:-1] - offsets[0]), sizes)] = _LOWER[data]
    runs = np.zeros(max(0, len(padded) - DEPTH), dtype=np.int64)
    for j in range(_RUN):
        runs <<= 8
        runs |= padded[j:len(padded) - DEPTH + j]
    real = np.ones(len(padded), dtype=bool)
    real[(begin[:-1][:, None] + np.arange(DEPTH)).reshape(-1)] = False
    return runs[real[DEPTH:]], np.concatenate([[0], np.cumsum(sizes + 1)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, names = pd.factorize(np.concatenate([k for k, _ in parts]))
    return names, np.bincount(codes, weights=np.concatenate([n for _, n in parts]), minlength=len(names))


def _count(docs: DataFrame, n_parts: int) -> DataFrame:
    """Pieces (block, kind, part, keys, n): words and byte runs that occur in a block, with their times in training texts.

    A task adds up what it meets of a block and passes it on at its end, or when it holds ``HELD_ROWS``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(), {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (b, kind), parts in held.items():
                yield _pieces(b, kind, *_merged(parts), n_parts)
            held.clear()

        rows = 0
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("block")))
            for part in row_chunks(batch, "text"):
                block, train = part.column("block").to_numpy(), part.column("train").to_numpy(zero_copy_only=False)
                for kind, (keys, first) in ((WORDS, hasher(part.column("text"))), (RUNS, byte_runs(part.column("text")))):
                    for b in np.unique(block):
                        mine = np.flatnonzero(block == b)
                        lo, hi = first[mine[0]], first[mine[-1] + 1]
                        weights = np.repeat(train[mine], np.diff(first[mine[0]:mine[-1] + 2])).astype(float)
                        held.setdefault((int(b), kind), []).append(_merged([(keys[lo:hi].view(np.int64), weights)]))
                        rows += len(held[int(b), kind][-1][0])
                if rows > HELD_ROWS:
                    for k, parts in held.items():
                        held[k] = [_merged(parts)]
                    rows = sum(len(parts[0][0]) for parts in held.values())
                    if rows > HELD_ROWS // 2:
                        yield from passed_on()
                        rows = 0
        yield from passed_on()

    return docs.select("block", "train", "text").mapInArrow(run, _PIECE)


_PIECE = "block bigint, kind tinyint, part int, keys binary, n binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: of sorted or small ones the high bytes take next to no room."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd"), dtype=np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).reshape(size)


def _near_first(keys: np.ndarray) -> np.ndarray:
    """Runs with the nearest context byte in the highest place: in that order neighbours share more, and they pack better."""
    near = np.zeros_like(keys)
    for j in range(DEPTH):
        near <<= 8
        near |= (keys >> (8 + 8 * j)) & 255
    near <<= 8
    near |= keys & 255
    return near


def _stored(values: np.ndarray) -> bytes:
    """Length and packed numbers."""
    return len(values).to_bytes(8, "little") + (_pack(values) if len(values) else b"")


def _loaded(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return _unpack(data[8:], size, kind) if size else np.zeros(0, dtype=kind)


def _root(keys: np.ndarray) -> np.ndarray:
    return (keys >> 8) & ((1 << (8 * min(ROOT, DEPTH))) - 1)


def _part(kind: int, keys: np.ndarray, n_parts: int) -> np.ndarray:
    h = ((_root(keys) if kind == RUNS else keys).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (h % np.uint64(n_parts)).astype(np.int64)


def _pieces(block: int, kind: int, keys: np.ndarray, n: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """One row for each part that the keys fall into. Runs are stored nearest byte first (``_near_first`` undoes itself)."""
    part = _part(kind, keys, n_parts)
    keys = _near_first(keys) if kind == RUNS else keys
    order = np.lexsort((keys, part))
    keys, n, part = keys[order], n[order].astype(np.int64), part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    cuts = list(zip(at, [*at[1:], len(part)]))
    columns = [pa.array([block] * len(at), pa.int64()), pa.array([kind] * len(at), pa.int8()), pa.array(part[at], pa.int32()),
               pa.array([_stored(keys[i:j]) for i, j in cuts], pa.binary()), pa.array([_stored(n[i:j]) for i, j in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "kind", "part", "keys", "n"])


def _added_up(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys in order, their counts, place of each piece's keys among them)."""
    keys = [_loaded(k.as_py(), np.int64) for k in pieces["keys"]]
    names, codes = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(codes, weights=np.concatenate([_loaded(x.as_py(), np.int64) for x in pieces["n"]]), minlength=len(names))
    return names, n.astype(np.int64), np.split(codes, np.cumsum([len(k) for k in keys])[:-1])


# The context tree -----------------------------------------------------------------------------------------------------

def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1/2: Stirling's series at x + 8."""
    y = x + 8
    below = reduce(lambda a, b: a * b, [x + i for i in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - F.log(below)


def _log_kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    value = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - log(np.pi) - _log_gamma(a + b + 1.0)
    return F.when(a + b == 0, F.lit(0.0)).otherwise(value)


_TABLED = 1 << 14
_HALF = np.array([lgamma(k + 0.5) for k in range(_TABLED)])
_WHOLE = np.array([lgamma(k + 1.0) for k in range(_TABLED)])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of sequences with a zeros and b ones."""
    half = lambda x: np.where(x < _TABLED, _HALF[np.minimum(x, _TABLED - 1)], _stirling(x + 0.5))
    n = a + b
    return half(a) + half(b) - log(np.pi) - np.where(n < _TABLED, _WHOLE[np.minimum(n, _TABLED - 1)], _stirling(n + 1.0))


class Subtrees:
    """Context trees of one of the eight decisions, from the runs' whole contexts up to their last ``ROOT`` bytes.

    Runs are put in the order of (bits known, nearest context byte, next nearest, ...), in which the runs of every node of every
    level are next to each other. ``first[d]`` is where the nodes of depth d begin among those of depth d + 1 (for the
    deepest: among the runs).
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, decision: int):
        byte, context = keys & 255, keys >> 8
        near = np.zeros_like(keys)
        for j in range(DEPTH):
            near = (near << 8) | ((context >> (8 * j)) & 255)
        place = ((1 << decision) | (byte >> (8 - decision))) << (8 * DEPTH) | near
        self.order = np.argsort(place, kind="stable")
        self.bit = ((byte >> (7 - decision)) & 1)[self.order]
        self.top = min(ROOT, DEPTH)
        ids, counted = place[self.order], n[self.order]
        n0, n1 = np.where(self.bit == 0, counted, 0), np.where(self.bit == 1, counted, 0)
        self.first, self.one, self.beta, below = {}, {}, {}, None
        for d in range(DEPTH, self.top - 1, -1):
            at = np.flatnonzero(np.diff(ids, prepend=-1))
            n0, n1 = np.add.reduceat(n0, at), np.add.reduceat(n1, at)
            own = log_kt(n0, n1)
            if below is None:
                weighted, beta = own, np.ones(len(at))
            else:
                weighted = np.logaddexp(own, np.add.reduceat(below, at)) - log(2)
                beta = np.exp(own - log(2) - weighted)
            self.first[d], self.one[d], self.beta[d] = at, (n1 + 0.5) / (n0 + n1 + 1), beta
            self.nodes, self.n0, self.n1, self.weighted = ids[at], n0, n1, weighted
            ids, below = ids[at] >> 8, weighted

    def chances(self, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Probability of the bit of every run, in the runs' own order. (p, rest): for each of ``nodes``, the mixture of the levels
        above and the weight that is left."""
        size = len(self.order)
        for d in range(self.top, DEPTH + 1):
            if d > self.top:
                spread = np.diff(np.append(self.first[d - 1], len(self.first[d])))
                p, rest = np.repeat(p, spread), np.repeat(rest, spread)
            p, rest = p + rest * self.beta[d] * self.one[d], rest * (1 - self.beta[d])
        p = np.repeat(p, np.diff(np.append(self.first[DEPTH], size)))
        out = np.empty(size)
        out[self.order] = np.where(self.bit == 1, p, 1 - p)
        return out


_ROOT = "part int, node bigint, n0 bigint, n1 bigint, weighted double, block bigint, keys binary, v binary"


def _roots(pieces: DataFrame, with_keys: bool = True) -> DataFrame:
    """(part, node, n0, n1, weighted) of the roots of all subtrees; of the words of a part one row with node -1, n0 their
    times in training and n1 how many of them are known, and a row with node -2 for each block: v holds the training counts of
    the block's words of this part, in order of ``keys``, which are left out unless ``with_keys``."""
    def up(key: tuple, table: pa.Table) -> pa.Table:
        kind, part = (x.as_py() for x in key)
        names, n, places = _added_up(table)
        if kind == RUNS:
            trees = (Subtrees(_near_first(names), n, i) for i in range(8))
            node, n0, n1, w = (np.concatenate(c) for c in zip(*((t.nodes, t.n0, t.n1, t.weighted) for t in trees)))
            none = [pa.nulls(len(node), t) for t in (pa.int64(), pa.binary(), pa.binary())]
        else:
            met: dict[int, list[np.ndarray]] = {}
            for block, at in zip(table["block"].to_pylist(), places):
                met.setdefault(block, []).append(at)
            mine = {block: np.unique(np.concatenate(at)) for block, at in met.items()}
            node, n0, n1, w = np.array([-1] + [-2] * len(mine)), np.zeros(len(mine) + 1), np.zeros(len(mine) + 1), np.zeros(len(mine) + 1)
            n0[0], n1[0] = n.sum(), (n > 0).sum()
            none = [pa.array([None, *mine], pa.int64()), pa.array([None, *(_stored(names[at]) if with_keys else None for at in mine.values())], pa.binary()),
                    pa.array([None, *(_stored(n[at]) for at in mine.values())], pa.binary())]
        columns = [pa.array(np.full(len(node), part), pa.int32()), pa.array(node, pa.int64()), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64)), pa.array(w)]
        return pa.Table.from_arrays([*columns, *none], names=["part", "node", "n0", "n1", "weighted", "block", "keys", "v"])

    return pieces.groupBy("kind", "part").applyInArrow(up, _ROOT)


def _above(roots: DataFrame) -> DataFrame:
    """(part, node, p, rest) for the roots of all subtrees: the mixture of the levels above them, built with grouped sums and
    read from the top down with joins; a level above the roots has at most 255 * 256 ** depth nodes."""
    top = min(ROOT, DEPTH)
    own, levels = roots.select("node", "n0", "n1", "weighted"), []
    for _ in range(top):
        summed = own.groupBy(F.shiftright("node", 8).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        kt = _log_kt(F.col("n0"), F.col("n1"))
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - log(2)
        own = settle(summed.withColumn("own", kt).withColumn("weighted", both).withColumn("beta", F.exp(F.col("own") - log(2) - F.col("weighted"))), "level")
        levels.insert(0, own.select("node", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("one"), "beta"))
    if not levels:
        return roots.select("part", "node", F.lit(0.0).alias("p"), F.lit(1.0).alias("rest"))
    mixed = levels[0].select("node", (F.col("beta") * F.col("one")).alias("p"), (1 - F.col("beta")).alias("rest"))
    for level in levels[1:]:
        joined = level.withColumn("up", F.shiftright("node", 8)).join(mixed.withColumnRenamed("node", "up"), "up")
        mixed = joined.select("node", (F.col("p") + F.col("rest") * F.col("beta") * F.col("one")).alias("p"), (F.col("rest") * (1 - F.col("beta"))).alias("rest"))
    joined = roots.select("part", "node", F.shiftright("node", 8).alias("up")).join(mixed.withColumnRenamed("node", "up"), "up")
    return joined.select("part", "node", "p", "rest")


def _values(pieces: DataFrame, roots: DataFrame, value: type) -> DataFrame:
    """(block, part, keys, v): the runs' pieces with values in place of counts: of a run the log10 probability of its last byte."""
    above = _above(roots.where("node >= 0"))

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "v": pa.array([], pa.binary())})
        names, n, places = _added_up(table)
        chances = _log_chances(_near_first(names), n, upper)
        kept = [_stored(chances[at].astype(value)) for at in places]
        return table.select(["block", "part", "keys"]).append_column("v", pa.array(kept, pa.binary()))

    runs = pieces.where(F.col("kind") == RUNS).select("block", "part", "keys", "n")
    return runs.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(down, "block bigint, part int, keys binary, v binary")


def _log_chances(keys: np.ndarray, n: np.ndarray, upper: pa.Table) -> np.ndarray:
    node, p, rest = (upper[c].to_numpy() for c in ("node", "p", "rest"))
    order = np.argsort(node)
    node, p, rest = node[order], p[order], rest[order]
    value = np.zeros(len(keys))
    for i in range(8):
        tree = Subtrees(keys, n, i)
        at = np.searchsorted(node, tree.nodes)
        value += np.log10(tree.chances(p[at], rest[at]))
    return value


def run_scores(runs: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the last byte of every run, given the bytes before; ``runs``: (key, n in training).

    Runs that training lacks are nodes without counts, which leave all weights as they are."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pieces(0, RUNS, *_merged([(batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(float))]), 1)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column("keys"), batch.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array(_near_first(_loaded(k.as_py(), np.int64))), pa.array(_loaded(v.as_py(), np.float64))], ["key", "value"])

    pieces = settle(runs.select("key", "n").mapInArrow(pack, _PIECE), "pieces")
    found = _values(pieces, settle(_roots(pieces), "roots"), np.float64)
    return found.select("keys", "v").mapInArrow(unpack, "key bigint, value double").distinct()


# Scores ---------------------------------------------------------------------------------------------------------------

def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learns from the rows that meet ``train`` (NULL: no), over whole texts with A-Z in lower case. score: log10 probability
    of the text and its end under the context trees, added up from bytes' values of seven digits; bits_per_byte: the same as code length. base_score: sum over words and
    one end of log10((c + 0.1) / (N + 0.1 (V + 1))), with c, N and V as counted in training; n_known: tokens with c > 0.

    A NULL or empty text is its end alone. Repeated rows are learned as often as they come and scored alike. Without
    training texts every bit has probability 1/2 and every token is unknown. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("block", _blocks(rows))
    parts = _parts(rows)
    bytes_in_all = rows.agg(F.sum(_size()).alias("n")).first()["n"] or 0
    n_parts = max(1, ceil(bytes_in_all / PART_BYTES))
    pieces = settle(_count(rows, n_parts), "pieces")
    roots = settle(_roots(pieces, parts is not None), "roots")
    seen = roots.where("node = -1").agg(F.sum("n0").alias("n"), F.sum("n1").alias("v")).first()
    ends = rows.where("train").count()
    train_tokens, distinct = (seen["n"] or 0) + ends, (seen["v"] or 0) + (ends > 0)
    every = F.lit(0) if parts is None else F.explode(F.sequence(F.lit(0), parts - 1))
    slices = _values(pieces, roots, np.float32).withColumn("kind", F.lit(RUNS)).unionByName(
        roots.where("node = -2").select("block", "part", "keys", "v", F.lit(WORDS).alias("kind")))
    slices = slices.select(F.col("block").alias("of"), every.alias("of_part"), "kind", "part", "keys", "v")
    floor = log10(train_tokens + 0.1 * (distinct + 1))
    end = log10(ends + 0.1), int(ends > 0)

    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        if not texts.num_rows:
            kinds = [texts.schema.field("id").type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
            return pa.schema(list(zip(names, kinds))).empty_table()
        hasher, out = WordHasher(), []
        chunks = [part for batch in texts.to_batches() for part in row_chunks(batch, "text", CHUNK_BYTES)]
        coded, firsts = [], []
        for part in chunks:
            words, first = hasher(part.column("text"))
            codes, found = pd.factorize(words.view(np.int64))
            coded.append((codes.astype(np.int32), found))
            firsts.append(first)
        counts = _word_counts(coded, model.filter(pc.equal(model["kind"], WORDS)), n_parts)
        value_of = _run_values(model.filter(pc.equal(model["kind"], RUNS)))
        del model
        for part, first, c in zip(chunks, firsts, counts):
            n = np.diff(first)
            base = _sums(np.log10(c + 0.1), first) + end[0] - (n + 1) * floor
            runs, at = byte_runs(part.column("text"))
            score = _sums(value_of(runs), at)
            out.append(pa.RecordBatch.from_arrays(
                [part.column("id"), pc.invert(part.column("train")), pa.array(n + 1), pa.array(_sums(c > 0, first).astype(np.int64) + end[1]),
                 pa.array(np.full(len(n), train_tokens)), pa.array(base), pa.array(score), pa.array(-score / log10(2) / np.diff(at))], names))
        return pa.Table.from_batches(out)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    rows = rows.withColumn("part", F.lit(0) if parts is None else F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    return rows.groupBy("block", "part").cogroup(slices.groupBy("of", "of_part")).applyInArrow(run, schema)


def _word_counts(coded: list[tuple[np.ndarray, np.ndarray]], model: pa.Table, n_parts: int) -> Iterator[np.ndarray]:
    """Training count of every word of a block's chunks, given as (code of every word, distinct words); chunk by chunk.

    Without keys the counts are those of all distinct words of the block, by part and key, which its texts give again.
    """
    names = np.unique(np.concatenate([found for _, found in coded]))
    model = model.sort_by("part")
    values = np.concatenate([np.zeros(0, dtype=np.int64), *[_loaded(v.as_py(), np.int64) for v in model["v"]]])
    if model.num_rows and model["keys"][0].is_valid:
        keys = np.concatenate([_loaded(k.as_py(), np.int64) for k in model["keys"]])
        order = np.argsort(keys, kind="stable")
        count = values[order][np.searchsorted(keys[order], names)]
    else:
        count = np.empty(len(names), dtype=np.int64)
        count[np.lexsort((names, _part(WORDS, names, n_parts)))] = values
    for codes, found in coded:
        yield count[np.searchsorted(names, found)][codes]


def _run_values(model: pa.Table):
    """Function from runs to values; every run that is asked for is in the table."""
    keys = np.concatenate([np.zeros(0, dtype=np.int64), *[_near_first(_loaded(k.as_py(), np.int64)) for k in model["keys"]]])
    values = np.concatenate([np.zeros(0, dtype=np.float32), *[_loaded(v.as_py(), np.float32) for v in model["v"]]])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    del order

    def find(wanted: np.ndarray) -> np.ndarray:
        codes, names = pd.factorize(wanted)
        if not len(names):
            return np.zeros(0)
        order = np.argsort(names)
        found = np.empty(len(names))
        found[order] = values[np.searchsorted(keys, names[order])]
        return found[codes]

    return find


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of segments that may be empty."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values.astype(float), first[full])
    return out
