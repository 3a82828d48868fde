"""Links against brute force; recall of the index down to the threshold."""

import numpy as np
import pytest

from quillon.llm import embedding_dedup
from quillon.llm.embedding_dedup import near_vectors, unit


def brute(rows, least=0.93):
    """rows: (vec_id, vector, label) -> (vec_id, n_links, component_id, kept), in order"""
    n = len(rows)
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    key = lambda k: rows[k][0]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (unit(np.array([rows[k][1]], "f8"))[0] for k in (a, b))
                if x @ y >= least:
                    links[a] += 1
                    links[b] += 1
                    p, q = sorted((find(a), find(b)), key=key)
                    root[q] = p
    return [(rows[k][0], links[k], rows[find(k)][0], rows[k][0] is not None and rows[find(k)][0] == rows[k][0]) for k in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block,split", [(16, 2048), (512, 2048), (16, 24)])
def test_whole_table(spark, sf, monkeypatch, block, split):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SPLIT", split)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(4, v, 1), (2, [2.0, 4.0, 6.0], 1), (9, v, 1), (9, v, 1), (3, v, 2), (1, v, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 1.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (None, v, 1), (13, [-1.0, -2.0, -3.0], 1), (14, [1e-300, 2e-300, 3e-300], 1), (15, [1e300, 2e300, 3e300], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    assert got(near_vectors(df)) == sorted(brute(rows), key=str)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("most,split", [(400, 2048), (1, 2048), (1, 8)])
def test_recall_near_the_threshold(spark, monkeypatch, most, split):
    """With few reference points and with as many as there may be, lists split by a second point or not."""
    monkeypatch.setattr(embedding_dedup, "LIST", most)
    monkeypatch.setattr(embedding_dedup, "SPLIT", split)
    r = np.random.default_rng(2)
    base = unit(r.normal(size=(1500, 64)))
    side = unit(r.normal(size=(1500, 64)))
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    cos = r.uniform(0.93, 0.97, (1500, 1))
    vectors = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    rows = [(k, x.tolist(), k % 1500 % 3) for k, x in enumerate(vectors)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).agg({"n_links": "sum"}).first()[0]
    s = vectors @ vectors.T >= 0.93
    lab = np.array([x[2] for x in rows])
    want = int((s & (lab[:, None] == lab[None])).sum()) - len(rows)
    recall = found / want
    print("recall", recall)
    assert recall >= 0.95


@pytest.mark.parametrize("low,high", [(0.95, 0.99), (0.93, 0.97)])
def test_recall_in_a_large_group(spark, monkeypatch, low, high):
    """A third of the rows are distinct near copies, with the most reference points there may be."""
    monkeypatch.setattr(embedding_dedup, "LIST", 10)
    r, n, group = np.random.default_rng(5), 6000, 2000
    vectors = unit(r.normal(size=(n, 64)))
    side = unit(r.normal(size=(group, 64)))
    cos = np.sqrt(r.uniform(low, high, (group, 1)))  # pairs' cosines are about the products
    vectors[:group] = unit(cos * vectors[:1] + np.sqrt(1 - cos**2) * side)
    rows = [(int(k), x.tolist(), 1) for k, x in zip(r.permutation(n), vectors)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).agg({"n_links": "sum"}).first()[0]
    want = int((vectors @ vectors.T >= 0.93).sum()) - n
    print("recall in a group", got / want)
    assert 0.99 * want <= got <= want
