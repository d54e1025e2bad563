import numpy as np
from pyspark.sql import functions as F

from panelwright.llm.language_mix import choose_languages, fit_languages, fit_mixture, gram_counts, predict_languages
from panelwright.llm.text import crc_bucket

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_mixture_equals_a_grid_search():
    rng = np.random.default_rng(4)
    shares = rng.dirichlet(np.full(40, 0.3), 2).T + 1e-6
    counts = rng.multinomial(600, 0.3 * shares[:, 0] / shares[:, 0].sum() + 0.7 * shares[:, 1] / shares[:, 1].sum()).astype(float)
    pi, fit = fit_mixture(counts, shares, 1e-9)
    grid = np.linspace(0.001, 0.999, 999)
    best = max(grid, key=lambda a: counts @ np.log(shares @ np.array([a, 1 - a])))
    assert abs(pi[0] - best) < 2e-3 and fit >= counts @ np.log(shares @ np.array([best, 1 - best])) - 1e-6


def test_chosen_set_has_the_best_penalised_likelihood_of_single_and_pair():
    rng = np.random.default_rng(6)
    shares = np.vstack([rng.dirichlet(np.full(60, 0.2), 3).T + 1e-7, np.zeros((2 ** 14 - 60, 3)) + 1e-9])
    for weights, expected in (([1, 0, 0], {0}), ([0.5, 0.5, 0], {0, 1}), ([0, 0.3, 0.7], {1, 2})):
        p = shares @ np.array(weights)
        chosen, pi, _ = choose_languages(rng.multinomial(4000, p / p.sum()), shares)
        assert set(chosen) == expected and abs(pi.sum() - 1) < 1e-6


def test_held_out_accuracy_and_mixed_texts(spark):
    docs = spark.read.parquet(DATA)
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = fit_languages(docs, where=~held)
    assert model.languages == ["de", "en", "es", "fr"]
    out = predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    clean = "lang = '{}' AND length(text) BETWEEN 600 AND 3000 AND NOT text LIKE '%|%' AND NOT text LIKE '%#%'"
    en, de = (docs.where(clean.format(x)).orderBy("doc_id").first()["text"][:600] for x in ("en", "de"))
    lang, _, names, shares = model.predict(en + "\n" + de)
    assert set(names) == {"en", "de"} and 0.3 < shares[0] < 0.7 and lang == names[0]
    assert model.predict(en)[2] == ["en"]


def test_texts_without_letters_nulls_and_nothing_learned(spark):
    rows = [(1, "a", "en"), (2, None, "en"), (3, "", None), (4, "123 ... €", "en"), (None, "das ist gut", "de"), (5, "the cat is good", "en"), (5, "the cat is good", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = fit_languages(docs)
    out = predict_languages(docs, model).collect()
    assert [r["lang_pred"] for r in out] == ["en", "und", "und", "und", "de", "en", "en"] and len(out) == 7
    assert out[1]["score"] == 0 and out[1]["languages"] == []
    empty = fit_languages(docs.where("false"))
    assert {r["lang_pred"] for r in predict_languages(docs, empty).collect()} == {"und"}
    assert predict_languages(docs.where("false"), model).count() == 0
    assert gram_counts("x").sum() == 1 and gram_counts("").sum() == 1
