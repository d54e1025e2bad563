"""Bootstrap counts of units by recursive splitting, without a row for each draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a block are drawn at once; a block is the smallest piece of work that a task has.
BLOCK = 1024


def _generator(seed: int, key: Sequence, low: int, high: int) -> np.random.Generator:
    """The generator of one node of the tree: a rule of seed, key and range, so every task that meets the node draws the same."""
    return np.random.default_rng([seed, zlib.crc32("/".join(map(str, key)).encode()), low, high])


def block_counts(n: int, replicates: int, seed: int, key: Sequence, block: int) -> np.ndarray:
    """(replicates, ids of the block): how often each id is hit when ``n`` draws fall on ids 1..n, for every replicate.

    A range of blocks holds some number of draws; the half that is nearer the start gets a binomial part of them, the other the
    rest. So a task walks down from all ``n`` draws to its block in log2(blocks) steps, and blocks of different
    tasks fit together although no task sees the others. Within the block the draws are multinomial.
    """
    low, high = 0, -(-n // BLOCK)
    if not 0 <= block < high:
        raise ValueError(f"block {block} of {high}")
    counts = np.full(replicates, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        ids, first = min(high * BLOCK, n) - low * BLOCK, (middle - low) * BLOCK
        left = _generator(seed, key, low, high).binomial(counts, first / ids)
        if block < middle:
            high, counts = middle, left
        else:
            low, counts = middle, counts - left
    size = min(high * BLOCK, n) - low * BLOCK
    return _generator(seed, key, low, high).multinomial(counts, np.full(size, 1.0 / size))


def redrawn_sums(values: DataFrame, columns: Sequence[str], n: str, replicates: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """(keys, replicate, columns): sums of ``columns`` over units, each as often as a replicate draws it.

    ``values``: (keys, unit_id, ``n``, columns), one row a unit at most; units without a row add nothing, and NULL adds nothing.
    The counts of all replicates stand beside a block of units as one matrix, whose product with the values is all that
    leaves a task: as many rows as replicates, whatever the number of units. Keys must not be NULL.
    """
    keys, columns = list(keys), list(columns)
    placed = values.select(*keys, "unit_id", F.col(n).cast("bigint").alias("_n"), *[F.col(c).cast("double").alias(c) for c in columns])
    placed = placed.withColumn("_block", F.expr(f"(unit_id - 1) div {BLOCK}"))
    dealt = placed.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block")
    typed = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join([*[f"`{k}` {typed[k]}" for k in keys], "replicate int", *[f"`{c}` double" for c in columns]])

    def rows_of(key: tuple, sums: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(sums, columns=columns)
        out.insert(0, "replicate", np.arange(1, replicates + 1, dtype=np.int32))
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        block, counts = None, None
        for batch in batches:
            for (*key, b), part in batch.groupby([*keys, "_block"], sort=False):
                key = tuple(key)
                if key != at:
                    if at is not None:
                        yield rows_of(at, sums)
                    at, sums = key, np.zeros((replicates, len(columns)))
                if (key, b) != block:         # the rest of a block may come with the next batch
                    block, counts = (key, b), block_counts(int(part["_n"].iloc[0]), replicates, seed, key, int(b))
                place = part["unit_id"].to_numpy() - 1 - int(b) * BLOCK
                sums += counts[:, place] @ np.nan_to_num(part[columns].to_numpy(dtype=float))
        if at is not None:
            yield rows_of(at, sums)

    parts = dealt.mapInPandas(run, schema)
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in columns])
