"""The model against a plain Kneser-Ney written out over dictionaries, and the classifier on held-out labels."""

import math
import tracemalloc
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm.quality import ALL, MIX, ORDER, classify, held_out, keep_good, pack, probabilities, score, symbols, train, trusted_ids, unpack
from quillon.llm.shared import stash


def grams(text):
    s = symbols(text)
    return [s[k : k + ORDER] for k in range(len(s) - ORDER + 1)]


def plain(counts, seen=None):
    """{gram: count} -> function of a gram, its probability."""
    levels = {ORDER: {g: n for g, n in counts.items() if n}}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    disc, stats = {}, {}
    for k, held in levels.items():
        n = Counter(held.values())
        d = [0.5] * 3
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            d = [min(max(x, 0.05), j + 0.95) for j, x in enumerate(d)]
        disc[k], st = d, defaultdict(lambda: [0, 0.0])
        for g, c in held.items():
            st[g[:-1]][0] += c
            st[g[:-1]][1] += d[min(c, 3) - 1]
        stats[k] = st

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / ((seen or len(levels[1])) + 100)
        if g[:-1] not in stats[k]:
            return lower
        total, freed = stats[k][g[:-1]]
        c = levels[k].get(g, 0)
        return max(c - disc[k][min(c, 3) - 1], 0) / total + freed / total * lower if c else freed / total * lower

    return p


def test_probabilities_are_kneser_ney(spark):
    texts = ["the cat sat on the mat. the hat", "a cat and a hat and the rat 123", "über den Wald, over there! 中文"] * 2 + ["the"]
    counts = {"x": Counter(g for t in texts for g in grams(t)), "y": Counter(g for t in texts[1:3] for g in grams(t))}
    odd = [g for t in [*texts, "zebra the XX\n%%\U0001f600"] for g in grams(t)]
    rows = spark.createDataFrame([(x, g, n) for x, c in counts.items() for g, n in c.items()], "lang string, gram string, n long")
    asked = spark.createDataFrame([(x, g) for x in counts for g in set(odd)], "lang string, gram string")
    got = {(r.lang, r.gram): r.p for r in train(rows, asked).collect()}
    assert set(got) == {(x, g) for x in counts for g in odd}
    symbols_seen = len({g[-1] for c in counts.values() for g in c})
    for x, c in counts.items():
        p = plain(c, symbols_seen)
        for g in set(odd):
            assert got[x, g] == pytest.approx(p(g), rel=1e-9)


def test_symbols_and_bytes():
    assert symbols(None) == symbols(" \n") == "\x02" * (ORDER - 1) + "\x03"
    assert symbols("a  1\n29") == "\x02" * (ORDER - 1) + "a 0 00\x03"
    for values in ([], [0], [254, 255, 256, 0, 510, 3], [10_000]):
        assert unpack(pack(quality.np.array(values, "i8"))).tolist() == values


def test_held_out_labels(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    got = classify(docs, fit)
    held = got.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got.count() == docs.count()
    assert not held.trusted.any()
    assert held[(held.quality == 1) & (held.toxic == 0)].kept.mean() > 0.995
    assert held[held.quality == 0].kept.mean() < 0.12


@pytest.mark.parametrize("chunk", [2_000_000, 40])
def test_likelihood_is_the_sum_over_the_text(spark, monkeypatch, chunk):
    """Sums over shards, repeats and languages against the plain model; many symbols take the other numbering."""
    monkeypatch.setattr(quality, "FEWEST", 1)
    monkeypatch.setattr(quality, "CHUNK", chunk)
    han = "".join(map(chr, range(0x4E00, 0x4E00 + 6000)))
    texts = [(1, "the cat sat", "en"), (2, "the the", "en"), (3, None, "en"), (None, "cat", "de"), (2, "the the", "en"), (5, "a cat sat on 17 mats", "en"), (6, "ein Kater", "de"), (7, "", None), (8, han, "zh"), (9, "the cat " * 300, "en"), (11, "the rat sat", "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("trusted", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 0, 0), (3, None, None), (None, 1, 0), (5, 1, 0), (9, 1, 0), (11, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    good = sorted(r.doc_id for r in trusted_ids(labels).collect())
    assert good == [1, 5, 6, 9, 11]
    held = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    rows, scores = score(docs, labels)
    keyed = {(r.lang, r.text): r.key for r in rows.collect()}
    got = {r.key: r for r in scores.collect()}
    assert len(got) == len(set(keyed.values())) == 10
    fit = [(t, x) for i, t, x in texts if i in good and i not in held]
    every = Counter(g for t, _ in fit for g in grams(t))
    symbols_seen = len({g[-1] for g in every})
    models = {x: plain(Counter(g for t, y in fit for g in grams(t) if y == x), symbols_seen) for x in ("en", "de") if {i in held for i, _, y in texts if i in good and y == x} == {True, False}}
    p_all = plain(every, symbols_seen)
    for (lang, text), key in keyed.items():
        mixed = (lambda g: (1 - MIX) * models[lang](g) + MIX * p_all(g)) if lang in models else p_all
        assert got[key].n_symbols == len(grams(text))
        assert got[key].log_likelihood == pytest.approx(sum(math.log(mixed(g)) for g in grams(text)), rel=1e-5)


def test_limits_and_verdicts_are_the_plain_ones(spark, sf):
    """Medians, quantiles and verdicts worked out again from the scores."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs.select("doc_id", "lang", "text"), labels, quantile=0.9).toPandas()
    good = {r.doc_id for r in trusted_ids(labels).collect()}
    held = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()} & good
    assert set(got[got.trusted].doc_id) == good & set(got.doc_id)
    got["raw"] = got.perplexity.map(math.log)
    low = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]
    own = got[got.doc_id.isin(held)]
    for lang, part in got.groupby("lang"):
        mine = own[own.lang == lang] if (own.lang == lang).sum() >= quality.FEWEST else own
        mid = low(mine.raw, 0.5)
        cost = lambda x, mid=mid: (x.raw * x.n_symbols + quality.PRIOR * mid) / (x.n_symbols + quality.PRIOR)
        if mine is own:
            continue
        limit = low(cost(mine), 0.9)
        assert (abs(part.threshold.map(math.log) - limit) < 1e-9).all()
        assert (abs(part.score.map(math.log) - cost(part)) < 1e-9).all()
        assert (part.kept == (cost(part) <= limit)).mean() > 0.999


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "some words here", None), (None, None, "en"), (2, "", "xx"), (2, "", "xx")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in classify(docs, none).collect()] == [True] * 4
    assert classify(docs.limit(0), none).count() == 0
    clash = docs.withColumns({"kept": F.lit("x"), "limit": F.lit(3), "key": F.lit(1), "group": F.lit(2)})
    assert sorted(map(str, keep_good(clash, none).collect())) == sorted(map(str, clash.collect()))
    assert ALL != "" and probabilities and stash


def test_all_labels_are_trusted_by_either_join(spark, sf, monkeypatch):
    many = spark.range(1_300_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert trusted_ids(many).count() == 1_300_000
    ids = [-(1 << 40), -65, -64, -1, 0, 62, 63, 64, 127, 1 << 40, None]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[::2]] + [(62, 0, 0), (64, 1, 1)], "doc_id long, quality int, toxic int")
    docs_sf, labels_sf = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    verdicts = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(quality, "BROADCAST", most)
        flagged, far = quality._flagged(docs, labels)
        assert far == (most == 0)
        assert sorted(r.doc_id for r in flagged.where("trusted").collect()) == sorted({*ids[:-1:2]} - {62, 64})
        assert flagged.count() == len(ids)
        verdicts.append(sorted((r.doc_id, r.trusted, r.n_symbols, round(r.score, 4), r.kept) for r in classify(docs_sf, labels_sf).collect()))
    assert verdicts[0] == verdicts[1]


@pytest.mark.parametrize("scan, most", [("_seen", 80), ("_posted", 90)])
def test_a_chunk_needs_little_memory(monkeypatch, scan, most):
    """MB at once over 1.5 million characters: two workers and 1800 MB of heap share an executor of 3000 MB."""
    words = np.random.default_rng(3).integers(97, 123, (4000, 400), "u1")
    words[:, ::7] = 32
    texts = [bytes(w).decode() for w in words]
    rows = MagicMock()
    monkeypatch.setattr(quality, "F", MagicMock())
    getattr(quality, scan)(rows)
    run = rows.select.return_value.mapInArrow.call_args.args[0]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array(["a"] * n), pa.array(texts), pa.array([k % 2 for k in range(n)])], ["group", "lang", "text", "number"])
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < most * 1e6
    finally:
        tracemalloc.stop()
