"""Personal data: fixed patterns, and boosted trees over overlapping candidates for what the patterns miss.

The patterns take the longest stretch and drop it whole if it fails (two card numbers side by side are one run of 32 digits).
Generators therefore propose every sensible part of such a stretch, with overlaps. Gradient-boosted trees (Spark ML) score the
candidates by format and context. They learn from the patterns' own finds against all other candidates whose label is
known; a candidate inside a dropped stretch or around a find is unlabelled. Thresholds are set on held-out documents, and of
overlapping candidates the best is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.text import crc_bucket
from panelwright.sources.writers import settle

KINDS = ("email", "ip", "card", "phone")

#: Share of right candidates that a threshold must reach on held-out documents (one in ``HELD_OUT`` by id).
MIN_PRECISION, HELD_OUT = 0.99, 5
TREES, DEPTH, BINS = 12, 4, 32

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")
_SPOKEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")
_WIDE = re.compile(r"[^\s@,;:<>()\[\]{}\"'|=!?*#]+\Z")
_CUES = tuple(re.compile(p, re.I) for p in ("mail|contact|write", r"\bip\b|host|server|addr", "card|visa|konto|account|pay", "tel|phone|fon|call|fax|mobil"))

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, 0
    for m in _DOMAIN.finditer(text):
        # Local characters hold no "@", so the run before this one begins behind the last "@" at the earliest.
        left = text[max(done, text.rfind("@", at, m.start()) + 1):m.start()]
        start = m.start() - (len(left) - len(left.rstrip(_LOCAL)))
        at = m.start()
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """({kind: valid spans}, {kind: dropped matches}) of the patterns, leftmost and non-overlapping for each kind."""
    good: dict[str, list[Span]] = {k: [] for k in KINDS}
    bad: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        good["email"] = _emails(text)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            (good if all(_below_256(p) for p in m.group().split(".")) else bad)["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = _only_digits(m.group())
            (good if 16 <= len(digits) <= 19 and luhn(digits) else bad)["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 8 <= len(_only_digits(m.group())) <= 15 else bad)["phone"].append(m.span())
    return good, bad


def _below_256(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def candidates(text: str, good: dict[str, list[Span]], bad: dict[str, list[Span]]) -> set[tuple[str, int, int]]:
    """(kind, start, end) of all valid spans and of everything that may be one, overlaps included.

    A stretch gives one candidate for each run of its digit groups that has a fitting number of digits, so their number
    goes by the groups and not by their square.
    """
    out = {(k, *s) for k in KINDS for s in good[k]}
    for start, end in good["email"]:
        word = _WIDE.search(text, max(0, start - 64), text.index("@", start))
        if word and word.start() < start:
            out.add(("email", word.start(), end))
    if "at" in text and ("[" in text or "(" in text):
        out |= {("email", *m.span()) for m in _SPOKEN.finditer(text)}
    for a, b in good["ip"] + bad["ip"]:
        for m in re.finditer(r"\.(?=[0-9]++(?:\.[0-9]++){3})", text[a:b + 17]):
            at = a + m.end()
            out.add(("ip", *_IP.match(text, at).span()))
    for a, b in good["card"] + bad["card"]:
        out |= {("card", *s) for s in _windows(text, a, b, 13, 19)}
    for a, b in good["phone"] + bad["phone"]:
        out |= {("phone", a, e) for s, e in _windows(text, a, b, 8, 15) if s == a + 1}
    out |= {("phone", *m.span()) for m in _NATIONAL.finditer(text)}
    return out


def _windows(text: str, begin: int, end: int, least: int, most: int) -> Iterator[Span]:
    """Runs of neighbouring digit groups with ``least`` to ``most`` digits; at most ``most`` from each group on."""
    groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, begin, end)]
    for i in range(len(groups)):
        n = 0
        for j in range(i, min(i + most, len(groups))):
            n += groups[j][1] - groups[j][0]
            if n > most:
                break
            if n >= least:
                yield groups[i][0], groups[j][1]


FEATURES = ("kind", "length", "digits", "groups", "first_group", "last_group", "longest_group", "shortest_group", "luhn", "plus", "parens", "dots",
            "hyphens", "spaces", "ats", "letters", "other", "below_256", "last_part", "left", "right", "cue")


def _side(c: str) -> int:
    """Class of a neighbouring character: none, blank, digit, letter, or another."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Numbers of ``FEATURES``. Whether digits follow is none of them: the patterns' finds never have any, as they take all."""
    s = text[start:end]
    groups = _DIGITS.findall(s)
    sizes = [len(g) for g in groups] or [0]
    count = [s.count(c) for c in ".- @"]
    parens = sum(map(s.count, "()[]"))
    letters = sum(map(str.isalpha, s)) if kind == "email" else 0
    other = len(s) - sum(sizes) - sum(count) - parens - letters - s.count("+")
    cue = any(c.search(text, max(0, start - 24), start) for c in (_CUES[KINDS.index(kind)],))
    return [KINDS.index(kind), len(s), sum(sizes), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), luhn("".join(groups)) if kind == "card" else 0,
            s.count("+"), parens, count[0], count[1], count[2], count[3], letters, other, kind == "ip" and all(map(_below_256, groups)),
            len(s) - s.rfind(".") - 1 if count[0] else 0, _side(text[start - 1:start]), _side(text[end:end + 1]), cue]


def _met(spans: list[Span], a: int, b: int) -> list[Span]:
    """Of sorted spans without overlaps, those that share a place with a to b."""
    i = bisect_right(spans, a, key=lambda s: s[1])
    out = []
    while i < len(spans) and spans[i][0] < b:
        out.append(spans[i])
        i += 1
    return out


def labelled(text: str) -> Iterator[tuple[str, int, list[float]]]:
    """(kind, label, features) of a text's candidates whose label is known."""
    good, bad = base_spans(text)
    for kind, start, end in sorted(candidates(text, good, bad)):
        found, dropped = _met(good[kind], start, end), _met(bad[kind], start, end)
        if (start, end) in found:
            yield kind, 1, features(text, kind, start, end)
        elif not any(a <= start and end <= b and (a, b) != (start, end) for a, b in dropped) and not any(start <= a and b <= end for a, b in found):
            yield kind, 0, features(text, kind, start, end)


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: the feature to compare (-1 for a leaf), its bound, the next node where at most that and where above,
    and the value of a leaf."""

    feature: np.ndarray
    bound: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            step = np.where(x[np.arange(len(x)), f] <= self.bound[at], self.low[at], self.high[at])
            at = np.where(inner, step, at)
        return self.value[at]


def read_tree(printed: str) -> Tree:
    """A tree from its printed form, the public description of a Spark tree."""
    rows: list[list[float]] = []
    lines = [x.strip() for x in printed.splitlines()[1:] if x.strip()]

    def node(i: int) -> int:
        """Read the node at line i; the line behind it."""
        me = len(rows)
        rows.append([-1, 0, 0, 0, 0])
        if lines[i].startswith("Predict:"):
            rows[me][4] = float(lines[i].split(":")[1])
            return i + 1
        feature, bound = re.match(r"If \(feature (\d+) <= (.+)\)", lines[i]).groups()
        low = len(rows)
        behind = node(i + 1)
        high = len(rows)
        behind = node(behind + 1)
        rows[me] = [int(feature), float(bound), low, high, 0]
        return behind

    node(0)
    f, b, lo, hi, v = zip(*rows)
    return Tree(np.array(f, dtype=int), np.array(b, dtype=float), np.array(lo, dtype=int), np.array(hi, dtype=int), np.array(v, dtype=float))


@dataclass(frozen=True)
class PiiModel:
    """Boosted trees with their weights, and the least probability of each kind; kinds without one add nothing."""

    trees: list[tuple[float, Tree]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, tree in self.trees:
            margin += weight * tree(x)
        return 1 / (1 + np.exp(-2 * margin))

    def find(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, base, score) of all spans by kind, start and end; a base span's score is 1.

        A candidate is added if it reaches its kind's threshold and meets no base span, unless it holds one of its own kind
        whole. Of candidates that meet each other the better, longer, earlier one is added.
        """
        text = text or ""
        good, bad = base_spans(text)
        out = [(k, a, b, True, 1.0) for k in KINDS for a, b in good[k]]
        base = {s[:3] for s in out}
        rest = sorted(c for c in candidates(text, good, bad) if c[0] in self.thresholds and c not in base) if self.trees else []
        if rest:
            scores = self.probability(np.array([features(text, *c) for c in rest], dtype=float))
            taken: dict[str, list[Span]] = {k: [] for k in KINDS}
            for p, (kind, a, b) in sorted(zip(scores.tolist(), rest), key=lambda r: (-r[0], r[1][1] - r[1][2], r[1][1])):
                if p < self.thresholds[kind] or any(k != kind or x < a or b < y for k in KINDS for x, y in _met(good[k], a, b)):
                    continue
                if not _met(taken[kind], a, b):
                    insort(taken[kind], (a, b))
                    out.append((kind, a, b, False, p))
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))

    def redact(self, text: str | None) -> str | None:
        """The text with every stretch of spans replaced by the first one's kind in brackets; NULL stays NULL."""
        if text is None:
            return None
        out, done = [], 0
        for kind, a, b, _, _ in sorted(self.find(text), key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join(out) + text[done:]


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PiiModel:
    """Trees from all labelled candidates of the documents that are not held out, thresholds from all of those that are.

    Equal candidates are counted and weigh by their number, so what Spark fits on grows with their variety. Without
    candidates of both labels the model adds nothing.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(held, *r) for held, text in zip(*[c.to_pylist() for c in batch.columns]) for r in labelled(text)]
            if rows:
                kinds = (pa.bool_(), pa.string(), pa.float64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["held", "kind", "label", "x"])

    texts = docs.select((crc_bucket(F.col(id_col), HELD_OUT) == 0).alias("held"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    found = texts.mapInArrow(label, "held boolean, kind string, label double, x array<double>")
    found = found.groupBy("held", "kind", "label", "x").agg(F.count("*").cast("double").alias("n"))
    known = settle(found.orderBy("held", F.xxhash64("kind", "label", "x"), "x"), "candidates")
    train = known.where("NOT held").select("label", array_to_vector("x").alias("features"), "n")
    sides = train.agg(F.count_distinct("label").alias("labels"), F.count("*").alias("rows")).first()
    if sides["labels"] < 2:
        return PiiModel()
    # Spark looks for the trees' bounds in a sample where there are more rows than the square of the bins.
    bins = max(BINS, isqrt(sides["rows"]) + 1) if sides["rows"] > 10_000 else BINS
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, seed=1, weightCol="n").fit(train)
    model = PiiModel([(w, read_tree(t.toDebugString)) for w, t in zip(fitted.treeWeights, fitted.trees)])
    return PiiModel(model.trees, thresholds(known.where("held"), model))


def thresholds(held: DataFrame, model: PiiModel, precision: float = MIN_PRECISION) -> dict[str, float]:
    """``threshold`` of every kind over rows (kind, label, x, n), n equal candidates each; kinds without one are left out.

    Candidates are added up by score first, and running sums are taken over the distinct scores.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            n, good = batch.column("n"), pc.multiply(batch.column("n"), batch.column("label"))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(model.probability(x)), n, good], ["kind", "score", "n", "good"])

    scored = held.select("kind", "label", "x", "n").mapInArrow(score, "kind string, score double, n double, good double")
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    upto = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(
        "kind", "score", F.lead("score", 1, 0.0).over(down).alias("below"), (F.sum("good").over(down) >= precision * F.sum("n").over(down)).alias("ok"))
    least = upto.where("ok").groupBy("kind").agg(F.min(F.struct("score", "below")).alias("at"))
    return {r["kind"]: max(0.5, (r["at"]["score"] + r["at"]["below"]) / 2) for r in least.collect()}


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float = MIN_PRECISION) -> float | None:
    """Score from which on the share of right candidates of one kind is at least ``precision``: half way between the least
    score accepted and the next lower one, 0.5 at least; None if no score is accepted."""
    values = np.unique(scores)[::-1]
    order = np.argsort(-scores, kind="stable")
    right, upto = np.cumsum(labels[order]), np.searchsorted(-scores[order], -values, side="right")
    ok = np.flatnonzero(right[upto - 1] >= precision * upto)
    if not len(ok):
        return None
    below = values[ok[-1] + 1] if ok[-1] + 1 < len(values) else 0.0
    return max(0.5, float(values[ok[-1]] + below) / 2)


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, spans) of every row, repeated rows included: spans as structs (kind, start, stop, base, score), places in code
    points, ends exclusive. NULL and empty texts have none; other columns are not read."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
    names = [span.field(i).name for i in range(span.num_fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, s)) for s in model.find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(span))], ["id", "spans"])

    kind = kept.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redact_pii(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """All rows and columns, personal data in ``text_col`` replaced; a row without any is unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([model.redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, text_col, texts.cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
