"""Language of a text as a mixture: proportions by expectation-maximisation, the set of languages by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed runs of so many bytes; the model holds one number per bucket and language.
GRAM, BUCKETS = 4, 1 << 14
MAX_LANGUAGES = 512

#: A further language must raise the log-likelihood by this times log(number of grams), grams counted once per ``GRAM``
#: bytes as neighbours overlap.
PENALTY = 2.0

_CLASS = np.full(256, 32, dtype=np.uint32)
_CLASS[0x80:] = np.arange(0x80, 256)
for _b in range(65, 91):
    _CLASS[_b] = _CLASS[_b + 32] = _b + 32

UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts by bucket of all runs of ``GRAM`` bytes; A-Z in lower case, ASCII other than letters as single spaces."""
    data = _CLASS[np.frombuffer(f" {text} ".encode("utf-8", "ignore"), dtype=np.uint8)]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data = data[keep]
    if len(data) < GRAM:
        data = np.concatenate([data, np.full(GRAM - len(data), 32, dtype=np.uint32)])
    h = data[:len(data) - GRAM + 1].copy()
    for j in range(1, GRAM):
        h = (h << np.uint32(8)) | data[j:len(data) - GRAM + 1 + j]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return np.bincount((h >> np.uint32(8)) % np.uint32(BUCKETS), minlength=BUCKETS)


def fit_mixture(counts: np.ndarray, shares: np.ndarray, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of a mixture of the columns of ``shares`` (grams x languages)."""
    pi = np.full(shares.shape[1], 1 / shares.shape[1])
    if len(pi) == 1:
        return pi, float(counts @ np.log(shares[:, 0]))
    total = counts.sum()
    while True:
        mixed = shares @ pi
        new = pi * ((counts / mixed) @ shares) / total
        done = np.abs(new - pi).max() < tolerance
        pi = new
        if done:
            return pi, float(counts @ np.log(shares @ pi))


def choose_languages(counts: np.ndarray, shares: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(chosen languages, their proportions, proportions over all languages) of a text with at least one gram.

    From the fit over all languages, the least one is dropped as long as that costs less likelihood than its penalty. As
    no set fits better than all languages, a text whose best single language is within one penalty of them needs no
    further fits.
    """
    seen = np.flatnonzero(counts)
    c, p = counts[seen].astype(float), shares[seen]
    penalty = PENALTY * log(max(c.sum() / GRAM, 2.0))
    everything, best = fit_mixture(c, p)
    single = c @ np.log(p)
    top = int(single.argmax())
    if (best - single[top]) / GRAM <= penalty:
        return [top], np.ones(1), everything
    chosen, pi = list(range(p.shape[1])), everything
    while len(chosen) > 1:
        rest = [x for x in chosen if x != chosen[int(pi.argmin())]]
        less, fit = fit_mixture(c, p[:, rest])
        if (best - fit) / GRAM > penalty:
            break
        chosen, pi, best = rest, less, fit
    return chosen, pi, everything


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    shares: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """(language, score, languages, proportions), most of the text first.

        The score is the language's proportion where all languages compete. ``und``, with score 0 and no languages, for a
        text that is NULL or has no letters, and where nothing was learned.
        """
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, [], []
        chosen, pi, everything = choose_languages(gram_counts(text), self.shares)
        order = np.argsort(-pi, kind="stable")
        names = [self.languages[chosen[i]] for i in order]
        return names[0], float(min(everything[chosen[order[0]]], 1.0)), names, [float(pi[i]) for i in order]


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> LanguageModel:
    """Gram counts of every language over all rows with a text and a language (and that meet ``where``).

    Tasks add up a table of bounded size each; only the sums by language and bucket reach the driver.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = gram_counts(text)
                if lang in sums:
                    sums[lang] += found
                else:
                    sums[lang] = found
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], ["lang", "b", "n"])

    sums = rows.mapInArrow(count, "lang string, b bigint, n bigint").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} are supported")
    table = np.full((BUCKETS, len(names)), 0.05)
    place = {name: i for i, name in enumerate(names)}
    table[sums["b"].to_numpy(), [place[x] for x in sums["lang"].to_pylist()]] += sums["n"].to_numpy()
    return LanguageModel(names, table / table.sum(axis=0, keepdims=True))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score, languages, proportions) of every row, repeated rows included; reads nothing but the
    whole text."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]],
                                             ["id", "lang_pred", "score", "languages", "proportions"])

    kind = kept.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(run, f"id {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")
    return out.withColumnRenamed("id", id_col)
