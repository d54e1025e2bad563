from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from panelwright.llm import spelling
from panelwright.llm.spelling import Trie, _Side, count_words, damaged, group_spellings, leaf_pairs, near_pairs, one_edit, vectors

WORDS = "word string, n bigint"


def edits(word, alphabet):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(counts):
    alphabet, out = sorted(set("".join(counts))), {}
    for w, n in counts.items():
        near = [x for x in edits(w, alphabet) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, len(near))
    rows = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, counts[w], n_near, counts[form] if form else None))
    return sorted(rows)


def test_words_equal_brute_force_in_blocks_of_any_size(spark):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abcé"), rng.integers(7, 10))) for _ in range(1500)}
    words |= {w[:3] + "q" + w[3:] for w in sorted(words)[:200]} | {"a" * 60, "a" * 61, "a" * 40 + "b" + "a" * 20, "a" * 62 + "é"}
    counts = {w: int(10 ** rng.uniform(0.4, 4)) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), WORDS)
    for block in (spelling.BLOCK, 97):
        assert sorted(map(tuple, group_spellings(table, block).collect())) == brute(counts)
    assert group_spellings(table.where("false")).count() == 0


def test_large_leaves_are_compared_by_halves():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.permutation(list("aabbcdeef"))) for _ in range(300)} | {"".join(rng.permutation(list("aabbcdee"))) for _ in range(300)})
    words += [w[:4] + "g" + w[5:] for w in words[::5] if w[4] != "g"]
    side = _Side(words, np.ones(len(words), dtype=np.int64))
    for large in (1 << 20, 0):
        found = [(words[i], words[j]) for x, y in near_pairs(side, side, 1, 1, large) for i, j in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_search_keeps_its_budget():
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 4, (60, 5)), rng.integers(0, 4, (70, 5))
    a, b = Trie(one), Trie(two)
    for up, down in ((1, 1), (0, 1), (1, 0), (0, 0)):
        found = {(i, j) for x, y in leaf_pairs(a, b, up, down, 7) for p, q in zip(x, y)
                 for i in a.order[a.begin[p]:a.begin[p + 1]] for j in b.order[b.begin[q]:b.begin[q + 1]]}
        gap = one[:, None, :] - two[None, :, :]
        wanted = (np.maximum(gap, 0).sum(2) <= up) & (np.maximum(-gap, 0).sum(2) <= down)
        assert found == {(i, j) for i, j in zip(*np.nonzero(wanted))}


def test_vectors_and_edits():
    assert vectors(["eee", "Ā"]).sum(1).tolist() == [3, 1] and vectors(["e" * 50]).max() == spelling.CAP
    assert one_edit("abc", "abd") and one_edit("abc", "ab") and one_edit("bc", "abc")
    assert not one_edit("abc", "abc") and not one_edit("abcd", "badc") and not one_edit("abc", "abcde")


def test_counts_of_damaged_runs(spark):
    rows = [(1, "Wonderful wonderful,WONDERFUL ÉCLAIRES éclaires short"), (1, "wonderful"), (None, "wonderful x÷ßÿàèìò"), (2, None), (3, ""),
            (4, "hyphen-ated " * 3 + "wonderful " * 2000)] + [(i, "wonderful marvellous") for i in range(10, 200)]
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, word string")
    wanted = Counter()
    for i, t in rows:
        for run in spelling._RUN.findall((t or "").encode().lower().decode()):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            wanted[damaged(i, run)] += 1
            assert (len(damaged(i, run)) < len(run)) == (h % 31 == 0)
    assert {r["word"]: r["n"] for r in count_words(docs).collect()} == {w: n for w, n in wanted.items() if n > 1 and len(w) >= 7}
    assert count_words(docs.where("false")).count() == 0


@pytest.mark.parametrize("ratio", (9, 10))
def test_chains_of_forms(spark, ratio):
    table = spark.createDataFrame([(f"chain{'abcdefg'[:i]}z", 2 * ratio ** (6 - i)) for i in range(2, 7)], WORDS)
    roots = {r["root"] for r in group_spellings(table).collect()}
    assert len(roots) == (1 if ratio == 10 else 5)
