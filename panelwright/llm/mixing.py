"""Mixing documents to target weights of domains that are known only softly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import log
from warnings import warn

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.columns import double_array, let
from panelwright.llm.text import words
from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle

#: Buckets of hashed words; with the number of domains this bounds the classifier's table.
BUCKETS = 1 << 15
MAX_DOMAINS = 64

#: About so many labelled documents are read to fit the classifier (all, if there are fewer).
LABELLED_ROWS = 20_000

#: Evidence of a longer text counts as that of so many words, so that posteriors stay soft.
EVIDENCE_WORDS = 60


def _word_buckets(text: Column, buckets: int) -> Column:
    return F.transform(words(text), lambda x: F.pmod(F.hash(x), F.lit(buckets)))


@dataclass(frozen=True)
class DomainModel:
    """Multinomial classifier over hashed words: log prior, and log share of every bucket, by domain."""

    domains: Sequence[str]
    priors: Sequence[float]
    shares: np.ndarray
    evidence_words: int = EVIDENCE_WORDS

    def posteriors(self, text: Column) -> Column:
        """Array with the probability of every domain; the priors' for a text without words."""
        tables = [double_array(row - self.shares[0]) for row in self.shares]

        def of_words(b: Column) -> Column:
            scale = F.least(F.lit(1.0), F.lit(float(self.evidence_words)) / F.greatest(F.size(b), F.lit(1)))
            total = lambda t: F.aggregate(b, F.lit(0.0), lambda a, i: a + t[i])
            sums = [F.lit(0.0), *map(total, tables[1:])]
            return F.array(*[s * scale + p for s, p in zip(sums, self.priors)])

        def soft(x: Column) -> Column:
            return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))),
                       lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, c: a + c)))

        return let(let(_word_buckets(text, self.shares.shape[1]), of_words), soft)


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
                buckets: int = BUCKETS, labelled_rows: int = LABELLED_ROWS) -> DomainModel:
    """Classifier from a labelled table (``id_col``, ``domain_col``).

    At most about ``labelled_rows`` labels are used, chosen by a hash of their id. A label with a NULL id or domain, or an
    id without a document, teaches nothing; of several labels for an id the least counts. Only the table of counts by
    domain and bucket reaches the driver. Without any label there is the one domain "all".
    """
    labels = labels.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
    labels = labels.where("_id IS NOT NULL AND _domain IS NOT NULL").groupBy("_id").agg(F.min("_domain").alias("_domain"))
    share = labelled_rows / max(labelled_rows, labels.count())
    labels = labels.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    known = texts.join(broadcast_if_small(labels), F.col("_doc") == F.col("_id")).select("_domain", _word_buckets(F.col("_text"), buckets).alias("_b"))
    rows = known.select("_domain", F.explode(F.concat(F.array(F.lit(-1)), "_b")).alias("_b")).groupBy("_domain", "_b").count().collect()
    domains = sorted({r["_domain"] for r in rows}) or ["all"]
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"{len(domains)} domains; at most {MAX_DOMAINS} are supported")
    counts, n_docs = np.zeros((len(domains), buckets)), np.zeros(len(domains))
    for r in rows:
        i = domains.index(r["_domain"])
        if r["_b"] < 0:
            n_docs[i] = r["count"]
        else:
            counts[i, r["_b"]] = r["count"]
    shares = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets))
    return DomainModel(domains, [log((n + 1) / (n_docs.sum() + len(domains))) for n in n_docs], shares)


#: A round of the fit counts as progress if it lowers the misfit by this share.
MIN_GAIN = 0.01


def fit_rates(soft: DataFrame, targets: Sequence[float], n_col: str = "n_tokens", p_col: str = "posteriors",
              tolerance: float = 1e-7) -> DataFrame:
    """``soft`` with a column rate, from projected-gradient least squares.

    With n_i tokens and posteriors p_i, rates r_i >= 0 are sought whose expected totals sum_i r_i n_i p_i are nearest to
    ``targets``. From r = 1, every round takes the step r_i <- max(0, r_i + p_i' H (target - total)): the gradient in the
    metric of the documents' sizes, scaled by H, the inverse of sum_i n_i p_i p_i'. H is taken over the documents with a
    positive rate, which ends in few rounds; where that step fails to lower the misfit, H over all documents is used, whose
    full step never overshoots. Each try is one job that adds up the totals and H's sums, as many numbers as domains and
    pairs of domains. Rounds end when targets are met or when neither step is progress, as where a target asks for a
    domain that no document has.
    """
    k = len(targets)
    target = np.asarray(targets, dtype=float)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p, n = [F.col(p_col)[i] for i in range(k)], F.col(n_col).cast("double")
        totals = [F.sum(n * F.col("rate") * p[i]).alias(f"s{i}") for i in range(k)]
        grams = [F.sum(F.when(F.col("rate") > 0, n * p[i] * p[j])).alias(f"g{i}_{j}") for i, j in pairs]
        row = df.agg(*totals, *grams).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
        return target - np.array([row[f"s{i}"] or 0.0 for i in range(k)]), np.linalg.pinv(gram, rcond=1e-9, hermitian=True)

    now = soft.withColumn("rate", F.lit(1.0))
    gap, inverse = measure(now)
    metric, rounds = inverse, 0
    misfit = lambda g: float(g @ metric @ g)
    while np.abs(gap).max() > tolerance * max(target.sum(), 1.0):
        for h in (inverse, metric):
            push = reduce(lambda a, b: a + b, [F.col(p_col)[i] * float(x) for i, x in enumerate(h @ gap)])
            after = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") + push))
            new_gap, new_inverse = measure(after)
            if misfit(new_gap) < (1 - MIN_GAIN) * misfit(gap):
                break
        else:
            return now
        rounds += 1
        now = settle(after, "rates") if rounds % 8 == 0 else after
        gap, inverse = new_gap, new_inverse
    return now


def mix_rates(docs: DataFrame, model: DomainModel, weights: Mapping[str, float], budget: float | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, text_key, n_tokens, posteriors, rate, copies, wanted, reached) of every row.

    ``weights``: wanted share of the tokens by domain, scaled to add up to 1; domains that are not named get 0. ``budget``:
    wanted tokens in all; if None, so many that the domain of the largest weight is used whole: a domain with fewer tokens
    than its share gets rates above 1. A named domain without tokens cannot be had; a warning names it, and if ``budget`` is
    None the others keep their shares of each other. ``wanted``, ``reached``: totals by domain (in the order of the model's
    domains) that were asked for and that the rates give, the same in every row; a warning names domains that miss theirs.

    ``copies`` is the rate rounded down or up, up as
    often as the fraction says, by a hash of id and text: the same on every run, and equal for repeated rows. A NULL or
    empty text has 0 tokens and the priors as posteriors; its rate moves no total. ``text_key`` is ``xxhash64`` of the text.
    """
    text = F.col(text_col)
    soft = docs.select(F.col(id_col), F.xxhash64(text).alias("text_key"), F.size(words(text)).cast("long").alias("n_tokens"),
                       model.posteriors(text).alias("posteriors"))
    soft = settle(soft, "posteriors")
    absent = sorted(d for d, w in weights.items() if w > 0 and d not in model.domains)
    if absent:
        warn(f"no labelled document of {', '.join(absent)}: the weights of the other domains are scaled up", stacklevel=2)
    wanted = np.array([max(0.0, float(weights.get(d, 0.0))) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    if budget is None:
        have = _totals(soft, len(wanted), F.lit(1.0))
        main = int(np.argmax(np.where(have > 0, wanted, -1)))
        targets = np.where(have > 0, wanted * have[main] / wanted[main], 0.0) if wanted[main] else have
    else:
        targets = wanted * budget
    out = fit_rates(soft, list(targets))
    reached = _totals(out, len(wanted), F.col("rate"))
    missed = [f"{d} {r:.0f} of {t:.0f}" for d, r, t in zip(model.domains, reached, targets) if abs(r - t) > 0.01 * max(targets.sum() / len(targets), t)]
    if missed:
        warn(f"tokens reached of those wanted: {', '.join(missed)}", stacklevel=2)
    chance = F.pmod(F.xxhash64(F.col(id_col), "text_key", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    out = out.withColumn("copies", (F.floor(F.round("rate", 6)) + (chance < F.round("rate", 6) - F.floor(F.round("rate", 6))).cast("int")).cast("long"))
    return out.withColumns({"wanted": double_array(targets), "reached": double_array(reached)})


def _totals(soft: DataFrame, k: int, rate: Column) -> np.ndarray:
    row = soft.agg(*[F.sum(F.col("n_tokens") * rate * F.col("posteriors")[i]).alias(f"s{i}") for i in range(k)]).first()
    return np.array([row[f"s{i}"] or 0.0 for i in range(k)])


def mix(docs: DataFrame, model: DomainModel, weights: Mapping[str, float], budget: float | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_rates`` says, with all their columns; only keys of rows that do not
    stay exactly once move."""
    rates = mix_rates(docs, model, weights, budget, id_col, text_col)
    other = rates.where("copies <> 1").select(F.col(id_col).alias("_other_id"), F.col("text_key").alias("_other_key"), F.col("copies").cast("int").alias("_copies"))
    same = F.col(id_col).eqNullSafe(F.col("_other_id")) & (F.xxhash64(text_col) == F.col("_other_key"))
    other = broadcast_if_small(settle(other.distinct(), "copies"), max_rows=2_000_000)
    joined = docs.join(other, same, "left").drop("_other_id", "_other_key")
    times = F.explode(F.array_repeat(F.lit(1), F.coalesce("_copies", F.lit(1)))).alias("_time")
    return joined.select(*docs.columns, times).drop("_time")
