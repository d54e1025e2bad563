"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components, join_components
from panelwright.llm.text import WordHasher, mix, row_chunks, shingle_hashes
from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle

#: 32 bands of 5 ranks: a pair of similarity 0.8 shares no band in 3 of a million cases, one of 0.3 in 92 of 100.
BANDS, BAND_RANKS = 32, 5
#: Buckets up to this size are compared as pairs, larger ones in blocks of so many members.
PAIRED_MEMBERS, BLOCK_MEMBERS = 12, 1024

_STEP = np.uint64(0xD1342543DE82EF95)


def _salt(i: int) -> np.uint64:
    return np.uint64(int(_STEP) * i & 0xFFFFFFFFFFFFFFFF)


def distinct_sets(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every segment, and where each segment begins."""
    hashes = hashes.copy()
    for i, j in zip(begin[:-1], begin[1:]):
        hashes[i:j].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begin[:-1][begin[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[begin]


def super_minhash(values: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """Signatures (sets x m) of many sets; an empty set has only infinite values.

    Every element draws one random permutation of the m places and meets place p at its rank of p, with the value rank +
    a uniform fraction; a place keeps its least value. As ranks are taken in order, a set is done as soon as all its
    places are taken: for sets larger than m after one or a few ranks. Permutations are drawn step by step (Fisher-Yates),
    for all sets of the call together.
    """
    sizes = np.diff(begin)
    signature = np.full((len(sizes), m), np.inf)
    flat = signature.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places: np.ndarray | None = None
    drawn = np.zeros(0, dtype=np.int64)
    for rank in range(m):
        x = mix(values + _salt(rank + 1))
        k = rank + ((x >> np.uint64(40)) % np.uint64(m - rank)).astype(np.int64)
        value = rank + (x & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40)
        if rank == 0:
            place = drawn = k
        else:
            row = np.arange(len(values))
            if places is None:
                places = np.tile(np.arange(m, dtype=np.uint16), (len(values), 1))
                places[row, drawn] = 0
            place = places[row, k].astype(np.int64)
            places[row, k] = places[:, rank]
        np.minimum.at(flat, owner * m + place, value)
        open_sets = np.isinf(signature).any(axis=1)
        go_on = open_sets[owner]
        if not go_on.any():
            break
        if not go_on.all():
            values, owner = values[go_on], owner[go_on]
            places = places[go_on] if places is not None else None
            drawn = drawn[go_on] if rank == 0 else drawn
    return signature


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per set and band, the band's number included."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _STEP + np.zeros((len(signature), 1), dtype=np.uint64)
    for j in range(bits.shape[2]):
        key = mix(key * _STEP + bits[:, :, j])
    return key.view(np.int64)


def _set_ids(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """128-bit identity of every set, from two sums that do not depend on order."""
    sums = []
    for salt in (1, 2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ _salt(salt)))])
        sums.append(mix(total[begin[1:]] - total[begin[:-1]]))
    raw = np.stack(sums, axis=1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(begin) - 1, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values.view(np.int64)))


def _sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, text_key, n, cls, bands) of every row of (id, text_key, text)."""
    m = BANDS * BAND_RANKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in row_chunks(batch, "text", 1 << 20):
                values, begin = distinct_sets(*shingle_hashes(*hasher(part.column("text")), shingle))
                keys = band_keys(super_minhash(values, begin, m), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(np.diff(begin)), _set_ids(values, begin),
                     _lists(keys.reshape(-1), np.arange(len(begin)) * BANDS)], ["id", "text_key", "n", "cls", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, text_key bigint, n bigint, cls binary, bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(cls, items) of every row of (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in row_chunks(batch, "text"):
                values, begin = distinct_sets(*shingle_hashes(*hasher(part.column("text")), shingle))
                yield pa.RecordBatch.from_arrays([_set_ids(values, begin), _lists(values, begin)], ["cls", "items"])

    return docs.select("text").mapInArrow(run, "cls binary, items array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total) of pairs of set ids, counted on the full sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("xs"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("ys"))
    met = pairs.join(left, "a").join(right, "b")
    met = met.select("a", "b", F.size(F.array_intersect("xs", "ys")).alias("inter"), F.size("xs").alias("nx"), F.size("ys").alias("ny"))
    return met.select("a", "b", "inter", (F.col("nx") + F.col("ny") - F.col("inter")).alias("total"))


def _linked(percent: int) -> Column:
    return 100 * F.col("inter") >= percent * F.col("total")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_members(members: DataFrame, roots: DataFrame, measured: DataFrame) -> DataFrame:
    """(bucket, cls, n, root, d, k, main) of the buckets whose members are not all in one component.

    d: distance to the bucket's first pivot, where measured. k: members of the bucket. main: its commonest component.
    """
    labels = roots.select(F.col("node").alias("cls"), "root")
    named = members.join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    counts = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("bucket").agg(F.sum("c").alias("k"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root"))["root"].alias("main"))
    named = named.join(mixed.where("roots > 1 and k > 2").drop("roots"), "bucket")
    to_pivot = measured.select("a", "b", (1 - F.col("inter") / F.col("total")).alias("d"))
    named = named.withColumns(dict(zip(("a", "b"), _ordered("cls", "pivot")))).join(to_pivot, ["a", "b"], "left")
    d = F.when(F.col("cls") == F.col("pivot"), 0.0).otherwise(F.col("d"))
    return named.select("bucket", "cls", "n", "root", d.alias("d"), "k", "main")


def _small_bucket_pairs(open_members: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """Pairs of buckets of at most ``PAIRED_MEMBERS`` that are in different components and not measured yet.

    A pair is left out only where a bound says that it is no link: sizes too far apart, or distances to the pivot too far
    apart (the Jaccard distance obeys the triangle inequality).
    """
    small = open_members.where(F.col("k") <= PAIRED_MEMBERS)
    x, y = (small.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("cls", "n", "root", "d")]) for side in "xy")
    may_link = ((F.col("x_cls") < F.col("y_cls")) & (F.col("x_root") != F.col("y_root"))
                & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
                & (F.coalesce(F.abs(F.col("x_d") - F.col("y_d")), F.lit(0.0)) <= 1 - percent / 100 + 1e-9))
    pairs = x.join(y, "bucket").where(may_link).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct()
    return pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti")


def _large_bucket_links(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of larger buckets between members outside the commonest component and members of any other.

    Those outside are compared with all members block by block, each block pair in one call on full sets, so no pair is
    ever a row; of the links of one member into one component, one is returned.
    """
    large = open_members.where(F.col("k") > PAIRED_MEMBERS).join(sets, "cls")
    outside = large.where("root <> main")
    few = outside.groupBy("bucket").agg(F.count(F.lit(1)).alias("f"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int")
    own = lambda c: F.pmod(F.hash("cls"), blocks(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    columns = ("bucket", "cls", "n", "root", "d", "items")
    sided = lambda side, i, j: [*[F.col(c).alias(f"{side}_{c}") for c in columns], i.alias(f"{side}_i"), j.alias(f"{side}_j")]
    left = outside.join(few, "bucket").select(*sided("x", own("f"), every("k")))
    right = large.join(few, "bucket").select(*sided("y", every("f"), own("k")))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = _block_links(x.rename_columns([c[2:] for c in x.column_names]), y.rename_columns([c[2:] for c in y.column_names]), percent)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    by = lambda side: [f"{side}_{c}" for c in ("bucket", "i", "j")]
    return left.groupBy(*by("x")).cogroup(right.groupBy(*by("y"))).applyInArrow(compare, "a binary, b binary").distinct()


def _flat(items: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = pa.concat_arrays(items.chunks) if items.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(whole.offsets.to_numpy())
    return whole.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def _block_links(x: pa.Table, y: pa.Table, percent: int) -> tuple[list, list]:
    a, b = [], []
    if not x.num_rows or not y.num_rows:
        return a, b
    xs, x_at = _flat(x["items"])
    ys, y_at = _flat(y["items"])
    names, codes = np.unique(ys, return_inverse=True)
    marked = np.zeros(len(names) + 1, dtype=np.int32)
    n_y, d_y = np.diff(y_at), y["d"].to_numpy().astype(float)
    x_cls, y_cls, x_root = x["cls"].to_pylist(), y["cls"].to_pylist(), x["root"].to_pylist()
    y_root, root_of_y = np.unique(np.array(y["root"].to_pylist(), dtype=object), return_inverse=True)
    d_x = x["d"].to_numpy().astype(float)
    for i, (lo, hi) in enumerate(zip(x_at[:-1], x_at[1:])):
        n = hi - lo
        apart = np.abs(d_y - d_x[i]) > 1 - percent / 100 + 1e-9  # a distance that is not known is NaN and excludes nothing
        may = ~apart & (100 * np.minimum(n, n_y) >= percent * np.maximum(n, n_y)) & (y_root[root_of_y] != x_root[i])
        if not may.any():
            continue
        place = np.minimum(np.searchsorted(names, xs[lo:hi]), len(names) - 1)
        here = place[names[place] == xs[lo:hi]]
        marked[here] = 1
        met = np.add.reduceat(marked[codes], y_at[:-1])
        marked[here] = 0
        for j in _first_of_each(np.flatnonzero(may & (100 * met >= percent * (n + n_y - met))), root_of_y):
            a.append(min(x_cls[i], y_cls[j]))
            b.append(max(x_cls[i], y_cls[j]))
    return a, b


def _first_of_each(places: np.ndarray, group: np.ndarray) -> np.ndarray:
    return places[np.unique(group[places], return_index=True)[1]]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                percent: int = 80) -> DataFrame:
    """(``id_col``, text_key, n_shingles, component_id, kept) of every row.

    Two texts are linked if their sets of ``shingle``-word runs have 100 * intersection >= ``percent`` * union; groups are
    the components of these links, named by their smallest id, and ``kept`` marks the row that gives the name.
    Candidates come from banded SuperMinHash signatures. Texts of one set are one class from the start, so copies are
    counted, never paired; classes of one bucket are measured against two pivots and joined; only members that are then still
    outside a bucket's main component are compared with the others, by pairs in small buckets and by blocks in large ones.

    A NULL, empty or blank text has no shingles and is alone. A text with fewer words than ``shingle`` has its whole
    sequence as one shingle. Rows that repeat an id with the same text share a result; repeated ids with different texts
    are judged text by text; a row with a NULL id counts after all others and is kept only if its group has no id at all.
    ``text_key`` is ``xxhash64`` of the text, to join results to such rows. Other columns are not read.
    """
    return _grouped(docs, id_col, text_col, shingle, percent).drop("_group")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The columns of ``near_copies`` and _group: a name of the row's group that no other group has, NULL without words."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = settle(_sketch(docs.select("id", "text_key", "text"), shingle), "sketch")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes, "classes")

    banded = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("cls").alias("pivot"), F.max("cls").alias("pivot2"), F.count(F.lit(1)).alias("k"))
    members = settle(banded.join(shared.where("k > 1").drop("k"), "bucket"), "buckets")

    involved = members.select("cls").distinct().join(classes.select("cls", "id"), "cls")
    some = broadcast_if_small(involved.select("id").distinct(), max_rows=2_000_000)
    texts = docs.join(some.withColumnRenamed("id", "some_id"), F.col("id").eqNullSafe(F.col("some_id")), "left_semi")
    sets = settle(_sets(texts, shingle).join(involved.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    stars = (members.select("cls", "n", F.explode(F.array("pivot", "pivot2")).alias("pivot")).where("cls <> pivot").distinct()
             .join(classes.select(F.col("cls").alias("pivot"), F.col("n").alias("m")), "pivot").where(near))
    measured = settle(_verified(stars.select(*_ordered("cls", "pivot")).distinct(), sets), "measured")
    links = measured.where(_linked(percent)).select("a", "b")
    roots = connected_components(links, "a", "b")
    still = settle(_open_members(members, roots, measured), "open")
    more = _verified(_small_bucket_pairs(still, measured, percent), sets).where(_linked(percent)).select("a", "b")
    more = settle(more.unionByName(_large_bucket_links(still, sets, percent)), "links")
    if not more.isEmpty():
        roots = settle(join_components(roots, more, "a", "b"), "roots")

    named = classes.select("cls", "id").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = named.withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id", F.col("root").alias("_group"))
    out = rows.select("id", "text_key", "n", "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "_group")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_row: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that ``near_copies`` keeps, with all their columns; only the rejected keys move.

    Rows that repeat a kept id and text, and the rows of a group without any id, all stay, unless ``one_row`` is set: then
    one row of each group stays, however often it is repeated. Rows without words are in no group; of those, rows that repeat
    id and text are one.
    """
    found = _grouped(docs, id_col, text_col, **options)
    if not one_row:
        return _without(docs, found.where(~F.col("kept")), id_col, text_col)
    found = settle(found, "found")
    keys = found.where("kept").groupBy(id_col, "text_key").agg(F.count(F.lit(1)).alias("times"), F.first("_group").alias("_group"))
    keys = settle(keys, "kept")
    best = keys.where("_group IS NOT NULL").groupBy("_group").agg(F.min("text_key").alias("best"))
    second = keys.join(best, "_group").where("text_key <> best")
    kept = _without(docs, found.where(~F.col("kept")).select(id_col, "text_key").unionByName(second.select(id_col, "text_key")), id_col, text_col)
    repeated = keys.where("times > 1")
    if repeated.isEmpty():
        return kept
    several = kept.withColumn("_key", F.xxhash64(text_col)).join(*_keys(repeated, id_col, F.col("_key")), "left_semi")
    return _without(kept, repeated, id_col, text_col).unionByName(several.dropDuplicates([id_col, "_key"]).drop("_key"))


def _keys(rows: DataFrame, id_col: str, text_key: Column) -> tuple[DataFrame, Column]:
    """Distinct ids and text keys of ``rows``, and the condition that a row has one of them."""
    keys = rows.select(F.col(id_col).alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_gone_id")) & (text_key == F.col("_gone_key"))
    return broadcast_if_small(settle(keys, "gone"), max_rows=2_000_000), same


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.join(*_keys(gone, id_col, F.xxhash64(text_col)), "left_anti")
