import hashlib
import itertools
import re
from zlib import crc32

import numpy as np
import pytest

from panelwright.llm.conversations import Repair, damage, mark_repeats, plain_rows, repair_conversations, repaired_turns, with_lost

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All edits of (initial, fault, role, text) rows: (cost, audit, hash) of the least legal one."""
    found = []
    choices = ["D" if f in ("blank", "duplicate") else "KRD" for _, f, _, _ in rows]
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        if sum(gaps) > 4:
            continue
        for edits in itertools.product(*choices):
            audit, out, cost = "", [], 5 * sum(gaps)
            for i, n in enumerate(gaps):
                audit += "I" * n
                out += [("?", "")] * n
                if i < len(rows):
                    (x, fault, role, text), e = rows[i], edits[i]
                    audit, cost = audit + e, cost + {"K": 0, "R": 1, "D": 2}[e] + (5 if fault == "truncated" and e != "D" else 0)
                    out += [] if e == "D" else [(role if e == "K" else "?", text)]
            odd = len(out) % 2
            roles = [r if r != "?" else ("user", "assistant")[(i - odd) % 2] for i, (r, _) in enumerate(out)]
            if (not odd or out[0][0] != "?") and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)):
                text = "\n".join(f"{r}:{t}" for r, (_, t) in zip(roles, out))
                found.append((cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return min(found)


def fault_rows(raw):
    out, seen = [], set()
    for role, text in raw:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault, role, text))
    return out


def test_search_equals_all_edits():
    rng = np.random.default_rng(5)
    roles = ["user", "assistant", "system", "tool", "", "umpire"]
    for _ in range(250):
        n = int(rng.integers(0, 6))
        raw = [(roles[rng.choice(6, p=[.35, .35, .12, .08, .05, .05])], ["a.", "b", "", "c!", "d?", " \n", f"{i}."][rng.integers(7)]) for i in range(n)]
        rows = fault_rows(raw)
        search = Repair()
        for x, fault, role, text in rows:
            search.push(x, fault, role.encode(), text.encode())
            assert search.nodes() <= 7
        assert search.finish() == brute(rows), rows


def test_memory_goes_by_what_is_unresolved():
    search = Repair()
    for i in range(3000):
        x = "ua"[i % 2]
        search.push(x, "truncated" if i % 50 == 7 else "", b"user" if x == "u" else b"assistant", b"t" * 100)
        assert search.nodes() <= 7 and search.unresolved() < 40
    assert len(search.finish()[1]) >= 3000
    alike = Repair()
    for _ in range(4000):
        alike.push("u", "", b"user", b"same?")
    cost, audit, _ = alike.finish()
    assert cost == 2000 and audit == "KR" * 2000 and alike.unresolved() == 0


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept, zero = [], hashlib.sha256(b"").hexdigest()
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if v is None else v for v in (role, text))
            key = ":".join(" " if v is None else str(v) for v in (conv, turn))
            kind = crc32(key.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = fault_rows([r[1:] for r in kept])
        turns = [r[0] for r in kept if r[0] is not None]
        count = [sum(f[1] == k for f in faults) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *count, illegal, *(brute(faults) if kept else (0, "", zero))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 40)), [None, 1, 2, 3, 4, 5, 9][rng.integers(7)], ["user", "assistant", "system", None, "Tool"][rng.integers(5)],
             ["yes.", "no", None, "", "maybe?", f"t{i}.", "ü\n! "][rng.integers(7)]) for i in range(150)]
    return rows + rows[:3] + [(None, 1, "user", "x."), (None, None, "assistant", "y."), *[(77, t, "user", "gone.") for t in range(400) if crc32(f"77:{t}".encode()) % 20 == 0]]


def test_damaged_tables_equal_brute_force(spark, table):
    small = [r for r in table if r[0] != 77 and sum(x[0] == r[0] for x in table) <= 4] + [r for r in table if r[0] == 77]
    df = spark.createDataFrame([(*r, 1, "x") for r in small], COLUMNS + ", seen int, fault string")
    out = with_lost(df, repair_conversations(mark_repeats(damage(df))))
    assert sorted(map(tuple, out.collect()), key=str) == expected(small)
    empty = df.where("false")
    assert with_lost(empty, repair_conversations(mark_repeats(damage(empty)))).count() == 0


def test_repaired_turns_give_the_hashed_text(spark, table):
    rows = mark_repeats(plain_rows(spark.createDataFrame(table, COLUMNS)))
    found = {r["conv_id"]: r for r in repair_conversations(rows).collect()}
    turns = {}
    for r in sorted(repaired_turns(rows, repair_conversations(rows)).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, r in found.items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == r["repaired_sha256"]


def test_a_conversation_with_most_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}." if i % 7 else "again.") for i in range(6000)] + [(2, 0, "user", "a.")]
    out = {r["conv_id"]: r for r in repair_conversations(mark_repeats(plain_rows(spark.createDataFrame(rows, COLUMNS)))).collect()}
    assert out[1]["duplicate"] == len(range(0, 6000, 7)) - 2 and len(out[1]["audit"]) >= 6000 and out[2]["audit"] == "D"
