"""Spelling variants: words one edit apart, found in a trie of letter-group counts, lead to the frequent form.

One inserted code point raises one letter-group count by one, one deleted code point lowers one, one replaced code point
does both or neither. Words are therefore held in a trie whose levels are their successive counts, and a search may go off a
word's own counts by a surplus of one and a deficit of one in all. What shares a leaf within that budget is verified.

The first ``TOP`` levels are the trie's subtrees, one Spark group each: every word is resident in its own subtree and visits the
neighbouring ones (each pair of subtrees from one side only) with what is left of its budget. Large subtrees are
cut into blocks of residents and blocks of visitors, so no task holds more than ``BLOCK`` words of either.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle

#: Letter groups (levels of the trie), and how many of them name a subtree. Counts above ``CAP`` count as ``CAP``, which
#: brings no two words farther apart.
GROUPS, TOP, CAP = 16, 3, 31

#: Shortest word, least occurrences of a word, and how many times as frequent a form must be.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 7, 2, 10

#: Words of a subtree in one task, as residents and as visitors.
BLOCK = 50_000

#: Letters by frequency, dealt to the groups in turns; other code points go by their number.
_BY_FREQUENCY = "eniathorsludcgbfmzwqyxvpkj"
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
_FLUSH = 200_000


def group_of(code: int) -> int:
    place = _BY_FREQUENCY.find(chr(code))
    return (place if place >= 0 else code) % GROUPS


_GROUP = np.array([group_of(c) for c in range(256)], dtype=np.int64)


def damaged(doc_id: object, run: str) -> str:
    """The run, without one of its code points where 31 divides crc32 of ``<doc_id>:<run>``; a NULL id is empty text."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` code points that occur ``MIN_COUNT`` times or more, over whole texts.

    Runs shorter than ``MIN_LENGTH`` cannot become such words. Tasks add up their counts before the shuffle; NULL and
    empty texts have no words, repeated rows count again.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if not text:
                    continue
                for run, n in Counter(_RUN.findall(text.encode("utf-8", "ignore").lower().decode())).items():
                    sums[damaged(doc_id, run)] += n
                if len(sums) > _FLUSH:
                    yield _counts(sums)
                    sums = Counter()
        yield _counts(sums)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(count, "word string, n bigint").where(F.char_length("word") >= MIN_LENGTH)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _counts(sums: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])


def vectors(words: list[str]) -> np.ndarray:
    """Letter-group counts of every word, one row each, at most ``CAP``."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    groups = np.where(codes < 256, _GROUP[np.minimum(codes, 255)], codes % GROUPS)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    found = np.bincount(owner * GROUPS + groups, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.minimum(found, CAP)


class Trie:
    """Rows of a count matrix in order of their counts; a node is a run of rows, its children are runs within it."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        ordered = counts[self.order]
        self.keys, self.first, new = [], [], np.zeros(len(ordered), dtype=bool)
        new[:1] = True
        parent = np.zeros(len(ordered), dtype=np.int64)
        for level in range(counts.shape[1]):
            new = new.copy()
            new[1:] |= ordered[1:, level] != ordered[:-1, level]
            begin = np.flatnonzero(new)
            self.keys.append(parent[begin] * (CAP + 1) + ordered[begin, level])
            self.first.append(np.searchsorted(parent[begin], np.arange(parent[-1] + 2)))
            parent = np.cumsum(new) - 1
        self.begin = np.append(np.flatnonzero(new), len(ordered))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child, place of its parent in ``nodes``) of all children."""
        return _spread(self.first[level][nodes], self.first[level][nodes + 1])


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner], owner


def leaf_pairs(a: Trie, b: Trie, surplus: int, deficit: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves whose counts differ by at most ``surplus`` upwards and ``deficit`` downwards, by depth-first search.

    The stack holds blocks of node pairs with the budget left, so its size goes by the depth and not by the words.
    """
    depth, one = len(a.keys), np.zeros(1, dtype=np.int64)
    stack = [(0, one, one, one + surplus, one + deficit)]
    while stack:
        level, x, y, up, down = stack.pop()
        if level == depth:
            yield x, y
            continue
        child, owner = a.children(level, x)
        label, keys = a.keys[level][child] % (CAP + 1), b.keys[level]
        found = []
        for step in (0, 1, -1):
            other = label - step
            wanted = y[owner] * (CAP + 1) + other
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            ok = (keys[at] == wanted) & (other >= 0) & (other <= CAP)
            ok &= up[owner] > 0 if step > 0 else down[owner] > 0 if step < 0 else True
            found.append((child[ok], at[ok], (up[owner] - (step > 0))[ok], (down[owner] - (step < 0))[ok]))
        merged = [np.concatenate(c) for c in zip(*found)]
        stack.extend((level + 1, *[c[i:i + block] for c in merged]) for i in range(0, len(merged[0]), block))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _halves(words: list[str], less: int) -> np.ndarray:
    """Hashes of the first and the last part of a word that holds ``len(word) - less`` code points: of two words one edit
    apart, the shorter one's first half or last half is in both."""
    out = np.empty((2, len(words)), dtype=np.int64)
    for i, w in enumerate(words):
        m = len(w) - less
        out[0, i], out[1, i] = hash(w[:m // 2]), hash(w[len(w) - (m - m // 2):])
    return out


class _Side:
    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.length = np.array([len(w) for w in words])
        self.equal, self.longer = _halves(words, 0), _halves(words, 1)
        self.counts = vectors(words)[:, TOP:]


def _verified(a: _Side, b: _Side, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs, those one edit apart."""
    gap = a.length[x] - b.length[y]
    ok = np.zeros(len(x), dtype=bool)
    for half in (0, 1):
        left = np.where(gap > 0, a.longer[half][x], a.equal[half][x])
        ok |= left == np.where(gap < 0, b.longer[half][y], b.equal[half][y])
    x, y = x[ok & (np.abs(gap) <= 1)], y[ok & (np.abs(gap) <= 1)]
    ok = np.fromiter((one_edit(a.words[i], b.words[j]) for i, j in zip(x.tolist(), y.tolist())), bool, len(x))
    return x[ok], y[ok]


def _by_halves(a: _Side, b: _Side, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of two large leaves: words that share a half, each pair once. A leaf's words are of one length, but for
    words with a capped count, so the halves to compare go by the two lengths."""
    for la in np.unique(a.length[p]):
        for lb in np.unique(b.length[q]):
            if abs(la - lb) > 1:
                continue
            i, j = p[a.length[p] == la], q[b.length[q] == lb]
            left = (a.longer if la > lb else a.equal)[:, i]
            right = (b.longer if lb > la else b.equal)[:, j]
            for half in (0, 1):
                order = np.argsort(right[half], kind="stable")
                lo = np.searchsorted(right[half][order], left[half], "left")
                hi = np.searchsorted(right[half][order], left[half], "right")
                for begin, end in _cuts(hi - lo):
                    at, owner = _spread(lo[begin:end], hi[begin:end])
                    x, y = owner + begin, order[at]
                    fresh = left[0][x] != right[0][y] if half else np.ones(len(x), dtype=bool)
                    yield i[x[fresh]], j[y[fresh]]


def _cuts(sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` in all, one entry at least."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield begin, end
        begin = end


def near_pairs(a: _Side, b: _Side, surplus: int, deficit: int, large: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row of a, row of b) one edit apart, from leaves within the budget."""
    if not a.words or not b.words:
        return
    one, two = Trie(a.counts), Trie(b.counts)
    for x, y in leaf_pairs(one, two, surplus, deficit):
        nx, ny = one.begin[x + 1] - one.begin[x], two.begin[y + 1] - two.begin[y]
        for i in np.flatnonzero(nx * ny > large):
            p, q = one.order[one.begin[x[i]]:one.begin[x[i] + 1]], two.order[two.begin[y[i]]:two.begin[y[i] + 1]]
            for s, t in _by_halves(a, b, p, q):
                yield _verified(a, b, s, t)
        small = nx * ny <= large
        x, y, nx, ny = x[small], y[small], nx[small], ny[small]
        for begin, end in _cuts(nx * ny):
            s, owner = _spread(np.zeros(end - begin, dtype=np.int64), (nx * ny)[begin:end])
            at = owner + begin
            yield _verified(a, b, one.order[one.begin[x[at]] + s // ny[at]], two.order[two.begin[y[at]] + s % ny[at]])


def _steps() -> list[tuple[int, int, int]]:
    """(step of the subtree key, surplus left, deficit left) from a visitor's subtree to the one visited: its own, and of two
    neighbours the one with the larger key."""
    base = [(CAP + 1) ** (TOP - 1 - i) for i in range(TOP)]
    up, down = [(b, 0, 1) for b in base], [(-b, 1, 0) for b in base]
    both = [(x[0] + y[0], 0, 0) for x in up for y in down if x[0] != -y[0]]
    return [(0, 1, 1)] + [s for s in up + down + both if s[0] > 0]


def _subtree(word: str = "word"):
    """Key of a word's subtree: its first ``TOP`` counts as one number below (CAP + 1) ** TOP."""
    codes = [*range(97, 123), *range(0xC0, 0x100)]
    key = F.lit(0)
    for g in range(TOP):
        letters = "".join(chr(c) for c in codes if group_of(c) == g)
        count = F.char_length(word) - F.char_length(F.translate(F.col(word), letters, ""))
        key = key * (CAP + 1) + F.least(count, F.lit(CAP))
    return key


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, best) of every word of a table (word, n): how many words are one edit away, and the most frequent of
    them, ties by code point, as struct (minus, word) with minus = -n; NULL if there is none.

    Tasks add up their own finds by word, so pairs are not rows. Only the sizes of the subtrees, at most
    (CAP + 1) ** TOP numbers, reach the driver.
    """
    spark, steps = words.sparkSession, _steps()
    keyed = words.select("word", "n", _subtree().alias("k"))
    size = {r["k"]: r["count"] for r in keyed.groupBy("k").count().collect()}
    visits = {k: sum(size.get(k - s, 0) for s, _, _ in steps) for k in size}
    blocks = lambda n: max(1, -(-n // block))
    sizes = F.broadcast(spark.createDataFrame([(k, blocks(size[k]), blocks(visits[k])) for k in size], "k int, nr int, nv int"))

    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    residents = keyed.join(sizes, "k").withColumn("v", each(F.col("nv"))).withColumn("r", part(F.col("nr")))
    residents = residents.select("k", "r", "v", "word", "n", F.lit(-1).alias("step"))
    moves = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s[0]).alias("by")) for i, s in enumerate(steps)])
    visitors = keyed.select("word", "n", "k", F.explode(moves).alias("m")).select("word", "n", (F.col("k") + F.col("m.by")).alias("k"), "m.step")
    visitors = visitors.join(sizes, "k").withColumn("r", each(F.col("nr"))).withColumn("v", part(F.col("nv")))
    visitors = visitors.select("k", "r", "v", "word", "n", "step")

    def search(table: pa.Table) -> pa.Table:
        step = table["step"].to_numpy()
        of = lambda mask: _Side(table["word"].filter(pa.array(mask)).to_pylist(), table["n"].to_numpy()[mask])
        resident, found = of(step < 0), []
        for i, (_, up, down) in enumerate(steps):
            if not (step == i).any():
                continue
            visitor = of(step == i)
            for x, y in near_pairs(resident, visitor, up, down):
                if i == 0:
                    once = np.fromiter((resident.words[p] < visitor.words[q] for p, q in zip(x.tolist(), y.tolist())), bool, len(x))
                    x, y = x[once], y[once]
                found += _best(resident, visitor, x, y) + _best(visitor, resident, y, x)
        columns = list(zip(*found)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "minus", "near"])

    finds = residents.unionByName(visitors).groupBy("k", "r", "v").applyInArrow(search, "word string, n_near bigint, minus bigint, near string")
    finds = finds.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", F.struct("minus", F.col("near").alias("word")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<minus:bigint,word:string>").alias("best"))
    return alone.unionByName(finds).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _best(a: _Side, b: _Side, x: np.ndarray, y: np.ndarray) -> list[tuple[str, int, int, str]]:
    """For every word of ``a`` in the pairs: how many partners, and the best one."""
    out: dict[int, tuple[int, int, str]] = {}
    for i, j in zip(x.tolist(), y.tolist()):
        n, minus, near = out.get(i, (0, 1, ""))
        out[i] = (n + 1, *min((minus, near), (-int(b.n[j]), b.words[j])))
    return [(a.words[i], *v) for i, v in out.items()]


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): from every row of (word, form), forms are followed to the last word that has none.

    Each round doubles the steps taken; as a form is at least ``FORM_RATIO`` times as frequent as its word, chains are
    short and hold no circle.
    """
    found = settle(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = broadcast_if_small(found.select(F.col("word").alias("root"), F.col("root").alias("next")))
        longer = settle(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "forms")
        if longer.where("on").isEmpty():
            return longer.select("word", "root")
        found = longer.select("word", "root")


def group_spellings(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n) with distinct words.

    ``form``: the near word of largest n (ties: smallest in code-point order) if that is at least ``FORM_RATIO`` times the
    word's n, else NULL; ``root``: the last of the chain of forms, the word itself without one. An empty table gives no rows.
    """
    words = settle(words.select("word", "n"), "words")
    near = settle(near_words(words, block).withColumn("ok", -F.col("best.minus") >= FORM_RATIO * F.col("n")), "near")
    near = near.select("word", F.when(F.col("ok"), F.col("best.word")).alias("form"), "n", "n_near",
                       F.when(F.col("ok"), -F.col("best.minus")).alias("form_n"))
    roots = follow_forms(near.where("form IS NOT NULL"))
    out = near.join(broadcast_if_small(roots), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
