"""Quality rules: counts of every text, and a likelihood ratio of hashed n-grams against trusted documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.columns import double_array, let
from panelwright.llm.text import words
from panelwright.operators.skew import broadcast_if_small

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Buckets of hashed words and word pairs; the model is one number each, whatever the corpus.
BUCKETS = 1 << 16

#: A document stays if its mean log-likelihood ratio per n-gram is at least this.
MIN_RATIO = -0.1


def text_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; all 0 for NULL."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words(text), 3).cast("long"),
    }


def repeated_words(found: Column, width: int) -> Column:
    """Number of words inside a window of ``width`` words that the text has twice or more, the first included.

    The windows of one text are sorted with their places, so the cost is n log n for any text; texts without a repeated
    window are not sorted.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[h[i + j] for j in range(1, width)]))

    def places(x: Column) -> Column:
        equal = lambda i, j: F.get(x, j)["w"] == x[i]["w"]
        among = F.filter(x, lambda _, i: F.coalesce(equal(i, i - 1), F.lit(False)) | F.coalesce(equal(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(among, lambda s: s["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - v, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(ordered, places), covered))

    return let(let(F.transform(found, lambda x: F.xxhash64(x)), windows), count)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ngram_buckets(text: Column, buckets: int) -> Column:
    """Buckets of all words and all pairs of neighbouring words."""
    def both(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(x * 31 + h[i + 1], F.lit(buckets)))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), pairs)

    return let(F.transform(words(text), lambda x: F.hash(x).cast("long")), both)


@dataclass(frozen=True)
class QualityModel:
    """log(trusted share / corpus share) of every bucket."""

    weights: Sequence[float]
    min_ratio: float = MIN_RATIO

    def ratio(self, text: Column) -> Column:
        """Mean over the n-grams of a text; 0 for a text without words."""
        table = double_array(self.weights)
        mean = lambda b: F.aggregate(b, F.lit(0.0), lambda a, i: a + table[i.cast("int")]) / F.greatest(F.size(b), F.lit(1))
        return let(ngram_buckets(text, len(self.weights)), mean)

    def passes(self, ratio: Column) -> Column:
        return ratio >= self.min_ratio


def fit_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                buckets: int = BUCKETS) -> QualityModel:
    """Count the n-grams of all documents, and of the trusted ones, in one pass.

    Trusted are the documents whose id is in ``trusted`` (one column named ``id_col``; repeated and NULL ids there change
    nothing). Only the table of buckets reaches the driver, ``buckets`` rows whatever the corpus. Shares are smoothed by
    one count per bucket. Without trusted words or without documents all weights are 0, which rejects nothing.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    marked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    marked = marked.join(broadcast_if_small(ids, max_rows=2_000_000), F.col("_doc") == F.col("_id"), "left")
    grams = marked.select(F.explode(ngram_buckets(F.col("_text"), buckets)).alias("b"), F.col("_id").isNotNull().cast("int").alias("t"))
    counts = {r["b"]: (r["n"], r["t"]) for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()}
    n_all, n_trusted = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not n_trusted:
        return QualityModel([0.0] * buckets)
    shares = lambda n, t: log((t + 1) / (n_trusted + buckets)) - log((n + 1) / (n_all + buckets))
    return QualityModel([shares(*counts.get(b, (0, 0))) for b in range(buckets)])


def judge(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, counts, base_failed, ratio, kept) of every row, repeated rows included.

    A NULL, empty or blank text has no words and fails; other columns are not read, so their names cannot clash.
    """
    text = F.col(text_col)
    out = docs.select(F.col(id_col), *[c.alias(k) for k, c in text_counts(text).items()], model.ratio(text).alias("ratio"))
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & model.passes(F.col("ratio")))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns; nothing is shuffled."""
    text = F.col(text_col)
    failed = base_failed(F.size(words(text)), repeated_words(words(text), 3))
    return docs.where(~failed & model.passes(model.ratio(text)))
