"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.writers import settle


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has an edge, with one node of its component as common root.

    Union-find: each task first joins its own edges into trees, of which only the tree edges go on. Then rounds hook every
    node to the neighbour of least priority and contract the edges. Priorities are the nodes' own order, which ends star
    shapes at once, and in every other round a new random order, so that long chains shrink by a fixed share too. Rounds
    go on until no edge is left. Rows with a NULL end and loops link nothing.
    """
    edges = settle(_local_trees(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    found, turn = None, 0
    while not edges.isEmpty():
        hooks = settle(_hooks(edges, turn), "hooks")
        edges = settle(_contract(edges, hooks), "edges")
        found, turn = hooks if found is None else _follow(found, hooks), turn + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else settle(found, "roots")


def join_components(found: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``found`` with more edges: only edges between different components are worked on."""
    root_of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).join(root_of("x"), "x", "left").join(root_of("y"), "y", "left")
    ends = ends.select(F.coalesce("_x", "x").alias("a"), F.coalesce("_y", "y").alias("b"))
    more = connected_components(ends, "a", "b")
    merged = _follow(found, more)
    return merged.unionByName(more.join(found.select("node"), "node", "left_anti")).distinct()


def _local_trees(edges: DataFrame) -> DataFrame:
    def union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = parent[x]
            return x

        for batch in batches:
            kept = []
            for x, y in zip(batch["a"], batch["b"]):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    kept.append((x, y))
            yield pd.DataFrame(kept, columns=["a", "b"])

    return edges.where("a <> b").mapInPandas(union_find, edges.schema)


def _priority(node: Column, turn: int) -> Column:
    order = F.lit(0).cast("long") if turn % 2 == 0 else F.xxhash64(node, F.lit(turn))
    return F.struct(order.alias("p"), node.alias("n"))


def _hooks(edges: DataFrame, turn: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy(F.col("a").alias("node")).agg(F.min(_priority(F.col("b"), turn)).alias("m"))
    return best.select("node", F.least("m", _priority(F.col("node"), turn))["n"].alias("root"))


def _contract(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = edges.join(left, "a").join(right, "b").where("ra <> rb")
    return ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _follow(found: DataFrame, hooks: DataFrame) -> DataFrame:
    step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
