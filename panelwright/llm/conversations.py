"""Conversation repair: the cheapest edits that turn a conversation into alternating turns, found while its rows stream by.

Viterbi search over four states (nothing yet, after system, after user, after assistant). The best edits into each state
form a backpointer tree of at most four leaves. A node counts its children; one that is left with a single child is
merged with it, so the tree never has more than seven nodes, and as soon as all survivors share the root, the root's edits are
final and leave the tree. Equal costs are decided by the unresolved edits from the common ancestor on, as a whole. Each
survivor carries the hash state of its repaired text, so no text is kept.

The digest of a conversation is one running hash over its texts, so one task has to read a conversation in order. It does so
as a stream of sorted rows, however long the conversation is; what it holds is the audit and the tree. Which rows repeat an
earlier one is found before, by Spark aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle

ENDS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: the initial of the last repaired row, "" before the first. NEXT gives the states that may follow.
STATES = ("", "s", "u", "a")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FINAL = ("", "a")
ROLE = {"u": "user", "a": "assistant"}


class Node:
    """Edits of a stretch of the search, behind those of its parent."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: Node | None, edits: bytes | bytearray):
        self.parent, self.edits, self.children = parent, bytearray(edits), 0
        if parent is not None:
            parent.children += 1


class Survivor:
    """Best way into a state: its cost, its leaf of the tree and the hash state of what it repaired."""

    __slots__ = ("cost", "leaf", "digest", "empty")

    def __init__(self, cost: int, leaf: Node, digest, empty: bool):
        self.cost, self.leaf, self.digest, self.empty = cost, leaf, digest, empty


class Option:
    """A survivor with edits that are not yet in the tree, and the rows they add."""

    __slots__ = ("cost", "base", "edits", "rows")

    def __init__(self, cost: int, base: Survivor, edits: bytes, rows: tuple[bytes, ...]):
        self.cost, self.base, self.edits, self.rows = cost, base, edits, rows


def _path(leaf: Node) -> list[Node]:
    out = [leaf]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out[::-1]


def _less(a: Option, b: Option) -> bool:
    """Whether the edits of ``a`` come first in ASCII order; both go back to one root.

    Two of equal cost are never a prefix of one another, as the edits that one had more would cost something.
    """
    p, q = _path(a.base.leaf), _path(b.base.leaf)
    shared = 0
    while shared < min(len(p), len(q)) and p[shared] is q[shared]:
        shared += 1
    one = [n.edits for n in p[shared:]] + [a.edits]
    two = [n.edits for n in q[shared:]] + [b.edits]
    i = j = x = y = 0
    while i < len(one) and j < len(two):
        n = min(len(one[i]) - x, len(two[j]) - y)
        width, done = 64, 0
        while done < n:
            k = min(width, n - done)
            left, right = one[i][x + done:x + done + k], two[j][y + done:y + done + k]
            if left != right:
                return left < right
            done, width = done + k, width * 4
        x, y = x + n, y + n
        if x == len(one[i]):
            i, x = i + 1, 0
        if y == len(two[j]):
            j, y = j + 1, 0
    return i == len(one) and j < len(two)


def _better(a: Option, b: Option | None) -> bool:
    return b is None or a.cost < b.cost or (a.cost == b.cost and _less(a, b))


class Repair:
    """The search over one conversation; ``push`` its rows in order, then ``finish``."""

    def __init__(self):
        self.audit = bytearray()
        self.live = {"": Survivor(0, Node(None, b""), hashlib.sha256(), True)}

    def nodes(self) -> int:
        return len({id(n) for s in self.live.values() for n in _path(s.leaf)})

    def unresolved(self) -> int:
        """Edits held in the tree."""
        return sum(len(n.edits) for n in {id(n): n for s in self.live.values() for n in _path(s.leaf)}.values())

    def push(self, initial: str, fault: str, role: bytes, text: bytes) -> None:
        """A row: initial of its role, first fault (blank, duplicate, truncated or empty text), role and text."""
        best: dict[str, Option] = {}

        def offer(state: str, option: Option) -> None:
            if _better(option, best.get(state)):
                best[state] = option

        more = TRUNCATED if fault == "truncated" else 0
        for state, o in self._with_inserts().items():
            offer(state, Option(o.cost + DELETE, o.base, o.edits + b"D", o.rows))
            if fault in ("blank", "duplicate"):
                continue
            for to in NEXT[state]:
                if to == initial:
                    offer(to, Option(o.cost + KEEP + more, o.base, o.edits + b"K", (*o.rows, role + b":" + text)))
                elif to in ROLE:
                    offer(to, Option(o.cost + REROLE + more, o.base, o.edits + b"R", (*o.rows, ROLE[to].encode() + b":" + text)))
        self._survive(best)

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, hex digest) of the cheapest repair."""
        best: dict[str, Option] = {}
        for state, o in self._with_inserts().items():
            if state in FINAL and _better(o, best.get("")):
                best[""] = o
        self._survive(best)
        end = self.live[""]
        return end.cost, bytes(self.audit).decode(), end.digest.hexdigest()

    def _with_inserts(self) -> dict[str, Option]:
        """Best option of each state with up to two inserted rows; three would go round to a state passed before."""
        best = {state: Option(s.cost, s, b"", ()) for state, s in self.live.items()}
        front = dict(best)
        for _ in range(2):
            reached: dict[str, Option] = {}
            for state, o in front.items():
                for to in NEXT[state]:
                    if to in ROLE:
                        new = Option(o.cost + INSERT, o.base, o.edits + b"I", (*o.rows, ROLE[to].encode() + b":"))
                        if _better(new, best.get(to)):
                            best[to] = reached[to] = new
            front = reached
        return best

    def _survive(self, best: dict[str, Option]) -> None:
        """Put the winners into the tree, drop what no survivor needs, and hand out what all of them share."""
        best = _hopeful(best)
        uses: dict[int, int] = {}
        for o in best.values():
            uses[id(o.base)] = uses.get(id(o.base), 0) + 1
        old, live = list(self.live.values()), {}
        for state, o in best.items():
            alone = uses[id(o.base)] == 1
            if alone:
                leaf, digest = o.base.leaf, o.base.digest
                leaf.edits += o.edits
            else:
                leaf, digest = Node(o.base.leaf, o.edits), o.base.digest.copy()
            empty = o.base.empty
            for row in o.rows:
                digest.update(row if empty else b"\n" + row)
                empty = False
            live[state] = Survivor(o.cost, leaf, digest, empty)
        self.live = live
        for s in old:
            if id(s) not in uses:
                _drop(s.leaf)
        for s in live.values():
            _merge(s.leaf)
        self._resolve()

    def _resolve(self) -> None:
        """The edits of the root are shared by all survivors, so they are final."""
        node = next(iter(self.live.values())).leaf
        while node.parent is not None:
            node = node.parent
        self.audit += node.edits
        node.edits.clear()


def _hopeful(best: dict[str, Option]) -> dict[str, Option]:
    """Without the states that cannot win any more, ties included.

    After an assistant row everything is possible that is possible before the first row or after a system row, but for
    keeping a system row, which can be deleted at 2: a start that costs over 2 more, and a system state that costs more, end.
    """
    if "a" not in best:
        return best
    limit = {"": best["a"].cost + DELETE, "s": best["a"].cost}
    return {state: o for state, o in best.items() if o.cost <= limit.get(state, o.cost)}


def _drop(leaf: Node) -> None:
    """A survivor has ended: remove its branch up to the next fork."""
    node = leaf
    while node.parent is not None and not node.children:
        node.parent.children -= 1
        node = node.parent


def _merge(leaf: Node) -> None:
    """Join every node that has one child left with that child."""
    node = leaf
    while (up := node.parent) is not None:
        if up.children == 1:
            up.edits += node.edits
            node.edits, node.parent = up.edits, up.parent
        else:
            node = up


# Tables --------------------------------------------------------------------------------------------------------------


def _space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _damage_kind() -> Column:
    return F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows of a table with these first four columns that its damage leaves.

    NULL role and text, and NULL ids and turns in the key of the damage, count as one space; ``conv_id`` and ``turn`` stay NULL.
    All other columns are ignored. A repeated row is one row with ``copies`` 2.
    """
    kind = F.col("kind")
    out = rows.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), _damage_kind().alias("kind")).where(kind != 0)
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.when(kind == 3, 2).otherwise(1).alias("copies"))


def with_lost(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """``repaired`` and a row of zeros for every conversation of ``rows`` that its damage leaves without a row."""
    blank = [F.lit(0).cast("long").alias(c) for c in _COUNTS] + [F.lit("").alias("audit"), F.lit(_EMPTY).alias("repaired_sha256")]
    ids = rows.select("conv_id", _damage_kind().alias("kind")).groupBy("conv_id").agg(F.max("kind").alias("most")).where("most = 0")
    return repaired.unionByName(ids.select("conv_id", *blank))


def plain_rows(rows: DataFrame) -> DataFrame:
    """Rows as they are, with NULL role and text as one space, in the shape that ``mark_repeats`` takes."""
    return rows.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), F.lit(1).alias("copies"))


def mark_repeats(rows: DataFrame) -> DataFrame:
    """Rows with ``seen``: whether the conversation has the same role and text at an earlier turn (NULL turns come first).

    Rows are added up by (conversation, hash of role and text) with map-side partial results, and only pairs found at two
    turns or more are joined back; copies at one turn are next to each other in the stream.
    """
    # A marker in front keeps NULL turns apart from turns.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = F.unhex(F.sha2(F.concat_ws("\x00", F.char_length("role").cast("string"), "role", "text"), 256))
    keyed = rows.withColumn("_key", same)
    at = keyed.groupBy(F.col("conv_id").alias("_conv"), F.col("_key").alias("_same")).agg(F.min(turn).alias("_from"), F.max(turn).alias("_to"))
    again = broadcast_if_small(settle(at.where("_from <> _to").select("_conv", "_same", "_from"), "repeats"))
    joined = keyed.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_same")), "left")
    return joined.withColumn("seen", F.coalesce(F.col("_from") < turn, F.lit(False))).drop("_key", "_conv", "_same", "_from")


def _fault(seen: Column) -> Column:
    """First fault of a row, but for copies at one turn, which the stream sees."""
    bare = F.rtrim(F.translate("text", BLANKS, " "))
    return (F.when(F.trim(bare) == "", "blank").when(seen, "duplicate")
            .when(~F.right(bare, F.lit(1)).isin(list(ENDS)), "truncated").otherwise(""))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Reader:
    """What the stream knows of one conversation."""

    def __init__(self):
        self.repair, self.faults = Repair(), {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.low, self.last, self.row = 0, 0, None, None, None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if not fault == "blank" and (turn, role, text) == self.row:
            fault = "duplicate"
        if fault:
            self.faults[fault] += 1
        if self.row is not None and self.row[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.row = (turn, role, text)
        self.repair.push(role[:1], fault, role.encode("utf-8", "ignore"), text.encode("utf-8", "ignore"))

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, *self.repair.finish()


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a conversation in one task, in order; the sort spills, so the task holds a batch at a time."""
    return rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", *order, "turn", "role", "text")])


def _record(done: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows are those of ``mark_repeats``, read by turn, NULL turns first, rows of one turn by role and text. NULL ids are one
    conversation; an empty table gives no rows. Each row is shuffled once.
    """
    named = ("conv_id", "turn", "role", "text", "copies", "fault")
    stream = _sorted(rows.withColumn("turn", F.col("turn").cast("long")).withColumn("fault", _fault(F.col("seen"))).select(*named))
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, done, kinds = None, None, [], None
        for batch in batches:
            kinds = [batch.column(0).type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            for conv, turn, role, text, copies, fault in zip(*[c.to_pylist() for c in batch.columns]):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append((now, *reader.result()))
                    reader, now = _Reader(), conv
                for _ in range(copies):
                    reader.add(turn, role, text, fault)
            if len(done) > 2000:
                yield _record(done, kinds, names)
                done = []
        if reader is not None:
            yield _record([*done, (now, *reader.result())], kinds, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the conversations after the edits of ``repaired``, places from 0.

    A conversation's audit goes before its rows in one sorted stream. The number of rows that it leaves tells all roles: an
    odd number begins with a kept system row, the rest are user and assistant in turns.
    """
    head = repaired.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.col("audit").alias("text"), F.lit(1).alias("copies"))
    body = rows.select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    stream = _sorted(head.unionByName(body), "part").select("conv_id", "part", "role", "text", "copies")
    names = ["conv_id", "place", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, odd = "", 0, 0, 0
        for batch in batches:
            kinds, done = [batch.column(0).type, pa.int64(), pa.string(), pa.string()], []
            for conv, part, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if part == 0:
                    audit, at, place = text, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                for edit in _edits(audit, at, 0 if part == 0 else copies):
                    at += 1
                    if edit != "D":
                        turned = ROLE["ua"[(place - odd) % 2]]
                        done.append((conv, place, role if edit == "K" else turned, "" if edit == "I" else text))
                        place += 1
            if done:
                yield _record(done, kinds, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string")


def _edits(audit: str, at: int, n: int) -> Iterator[str]:
    """The edits of the next ``n`` rows and of the rows inserted behind them (before the first one for n = 0)."""
    while at < len(audit) and (n > 0 or audit[at] == "I"):
        n -= audit[at] != "I"
        yield audit[at]
        at += 1
