"""Posteriors on held-out labels, and rates against a plain projected-gradient loop."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing
from quillon.llm.mixing import DOMAINS, draw, finish_rates, fit, fit_rates, mix, posteriors, rate_of
from quillon.llm.shared import stash


def plain_rates(n, p, want, steps):
    """Rates by numpy: the same steps over arrays."""
    m = (p * n[:, None]).T @ p
    scale = np.array([1 / x if x > 0 else 0 for x in np.diag(m)])
    root = np.sqrt(scale)
    size, r = np.linalg.eigvalsh(root[:, None] * m * root[None]).max(), np.ones(len(n))
    for _ in range(steps):
        r = np.maximum(0, r - p @ (((p * n[:, None]).T @ r - want) * scale / size))
    return r


def test_rates_and_targets(spark):
    g = np.random.default_rng(4)
    p, n = g.dirichlet([0.3, 0.2, 0.2], 400), g.integers(1, 900, 400)
    rows = [(k, int(n[k]), *map(float, p[k])) for k in range(400)]
    known = stash(spark.createDataFrame(rows, "k int, n_tokens long, p_clean double, p_junk double, p_toxic double"), "k")
    want = dict(zip(DOMAINS, (np.array([0.7, 0.2, 0.1]) * n.sum()).tolist()))
    history = fit_rates(known, want, steps=200)
    got = np.array([r.rate for r in known.withColumn("rate", rate_of(history)).orderBy("k").collect()])
    assert np.allclose(got, plain_rates(n.astype("f8"), p, np.array([want[d] for d in DOMAINS]), len(history)))
    assert np.allclose((p * (n * got)[:, None]).sum(0), [want[d] for d in DOMAINS], rtol=0, atol=2e-3 * n.sum()) and got.min() >= 0


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    mixed = mix(docs, labels.where("doc_id % 2 = 0"))
    assert mixed.count() == docs.count() and mixed.columns[:5] == docs.columns
    held = mixed.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert np.allclose(held[[f"p_{d}" for d in DOMAINS]].sum(axis=1), 1)
    clean, toxic = held[(held.quality == 1) & (held.toxic == 0)], held[held.toxic == 1]
    assert (clean.rate.round() >= 1).mean() > 0.98 and (clean.rate.round() <= 1).all()
    assert (toxic.rate.round() >= 1).mean() < 0.08


def test_posterior_is_naive_bayes(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels)
    assert 5 <= len(model["words"]) <= mixing.VOCABULARY
    hashed = {}
    rows = posteriors(docs, model).limit(40).collect()
    words = sorted({w for r in rows for w in re.split(mixing.MARKS, r.text.lower())})
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w"), *[F.xxhash64(F.lit(n), F.substring("w", 1, n)) for n in mixing.STEMS]).collect():
        hashed[r[0]] = r[1]
        hashed.update({(r[0][:n], n): h for n, h in zip(mixing.STEMS, r[2:])})
    for r in rows:
        t, n = r.text, max(1, len(r.text))
        assert r.n_tokens == (t.count(" ") + 1 if t else 0)
        own = set(re.split(mixing.MARKS, t.lower()))
        upper, marks = (sum(c in s for c in t) / n for s in (mixing.CAPITALS, mixing.SYMBOLS))
        step = lambda x, a, b: (x > a) + (x > b)
        shape = step(upper, 0.08, 0.3) * 9 + step(marks, 0.005, 0.03) * 3 + step(len(own) / max(1, r.n_tokens), 0.15, 0.35)
        at = model["langs"].index(r.lang) if r.lang in model["langs"] else 0
        seen = [model["words"][h][at] for h in {hashed[x] for x in own | {(w[:n], n) for w in own for n in mixing.STEMS}} if h in model["words"]]
        logit = np.array(model["prior"][at]) + model["shapes"][at][shape] + np.sum(seen, axis=0)
        want = np.exp(logit - logit.max())
        assert [r.p_clean, r.p_junk, r.p_toxic] == pytest.approx((want / want.sum()).tolist(), abs=1e-4)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "w " * 5000, "z")], "doc_id long, text string, rate string").withColumn("n_tokens", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mix(docs, none, {"clean": 1.0}, total=1000.0).collect()
    assert len(rows) == 5 and all(r.p_clean == pytest.approx(1 / 3) and r.rate >= 0 for r in rows)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 0, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert mix(docs, odd).count() == 5 and mix(docs.limit(0), odd).count() == 0


def test_draw_follows_rates(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("text"), (F.col("id") % 4 * 0.6).alias("rate"))
    counts = {round(r.rate, 1): r["count"] / 5000 for r in draw(df).groupBy("rate").count().collect()}
    assert set(counts) == {0.6, 1.2, 1.8} and all(abs(counts[k] - k) < 0.05 for k in counts)
    assert {round(r.rate, 1): r["count"] for r in draw(df, nearest=True).groupBy("rate").count().collect()} == {0.6: 5000, 1.2: 5000, 1.8: 10000}


@pytest.mark.parametrize("alpha,weights,steps", [((0.3, 0.2, 0.2), (0.7, 0.2, 0.1), 60), ((3, 1, 1), (0.9, 0.05, 0.05), 60), ((3, 1, 1), (0.9, 0.05, 0.05), 12)])
def test_every_target_is_met(spark, alpha, weights, steps):
    g = np.random.default_rng(4)
    p, n = g.dirichlet(alpha, 2000), g.integers(1, 900, 2000)
    rows = [(k, int(n[k]), *map(float, p[k])) for k in range(len(n))]
    known = stash(spark.createDataFrame(rows, "k int, n_tokens long, p_clean double, p_junk double, p_toxic double"), "k")
    want = np.array(weights) * n.sum()
    asked = dict(zip(DOMAINS, want.tolist()))
    history = fit_rates(known, asked, steps)
    at = lambda h: (p * (n * np.array([r.rate for r in known.withColumn("rate", rate_of(h)).orderBy("k").collect()]))[:, None]).sum(0) / want - 1
    print("off before", at(history), "after", at(done := finish_rates(known, asked, history)), len(history))
    assert np.abs(at(done)).max() < 1e-3
    far = finish_rates(known, {"clean": 1.0, "junk": float(n.sum()), "toxic": 1.0}, [])  # out of reach
    rate = np.array([r.rate for r in known.withColumn("rate", rate_of(far)).orderBy("k").collect()])
    assert np.isfinite(rate).all() and rate.min() >= 0


def test_no_labels_keep_everything(spark):
    docs = spark.createDataFrame([(k, f"a b {k}") for k in range(5)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in draw(mix(docs, none, steps=12), nearest=True).collect()) == [0, 1, 2, 3, 4]


def test_fit_needs_no_python_workers(spark, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("rows from the driver go through Python workers")

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    model = fit(docs, labels)
    assert len(model["langs"]) > 1 and model["words"]  # the words' counts by language, which came by such rows


def test_words_without_a_marks_stem_are_not_hashed(spark, sf):
    def every(df, words):  # the marks of a column of words
        df, kinds = mixing.stemmed(df, words)
        return df.select("k", F.explode(F.concat(*[F.transform(c, lambda w: mark(w)) for c, mark in kinds.items()])).alias("h"))  # noqa: B023

    # Marks that are empty, shorter than a stem, as long, longer, and outside the BMP; then ordinary tables.
    lines = {"clean": "plain words of number {k} alone", "toxic": "!xy {k} \U00020000\U00020001 stem stemming Idiotical"}
    rows = [(k, lines["toxic" if k % 2 else "clean"].format(k=k)) for k in range(200)]
    planted = spark.createDataFrame(rows, "doc_id long, text string"), spark.range(200).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic")
    stored = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for docs, labels in (planted, stored):
        model = fit(docs, labels)
        words = mixing.described(docs).select(F.monotonically_increasing_id().alias("k"), "_words")
        few = words.withColumn("_few", F.filter("_words", lambda w: mixing.shortest(w).isin(model["stems"])))
        sums = few.agg(F.sum(F.size("_few")).alias("few"), F.sum(F.size("_words")).alias("all")).first()
        known = lambda df: df.where(F.col("h").isin(list(model["words"])))  # noqa: B023, E731
        a, b = known(every(words, "_words")), known(every(few.select("k", "_few"), "_few"))
        assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert sums["few"] < 0.1 * sums["all"]  # of the stored documents
    assert {"", "xy", "\U00020000\U00020001", "stem", "idio"} <= set(fit(*planted)["stems"])


@pytest.mark.parametrize("text", ["", "plain", "ABC!%$#&*|xyz", "\u00c4\u00dcA!\U00020000", "A\nB&&C]^-", None])
def test_shape_counts_capitals_and_symbols(spark, text):
    row = mixing.described(spark.createDataFrame([(text,)], "text string")).select("_shape").first()
    t = text or ""
    n, fresh = max(1, len(t)), len(set(re.split(mixing.MARKS, t.lower()))) / max(1, t.count(" ") + 1 if t else 0)
    upper, symbols = (1 - sum(c not in s for c in t) / n for s in (mixing.CAPITALS, mixing.SYMBOLS))
    step = lambda x, a, b: (x > a) + (x > b)
    assert row[0] == step(upper, 0.08, 0.3) * 9 + step(symbols, 0.005, 0.03) * 3 + step(fresh, 0.15, 0.35)
