"""Fingerprints by Spark's own XXH64, links and components by brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.components import components, forest
from quillon.llm.simhash import cells, fingerprint, keep_one, link_edges, links, near_duplicates
from quillon.llm.shared import stash


def brute(points):
    """doc -> smallest doc reachable, points: (doc, fp)"""
    fp = np.array([p for _, p in points], "u8")
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3):
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    best = {}
    for k, (doc, _) in enumerate(points):
        r = find(k)
        best[r] = min(x for x in (best.get(r), doc) if x is not None) if (doc is not None or r in best and best[r] is not None) else best.get(r)
    return [best.get(find(k)) for k in range(len(points))]


def spark_fp(spark, texts):
    """The contract by Spark expressions alone."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").collect()
    out = []
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
        if not grams:
            out.append(0)
            continue
        h = [x.h & (1 << 64) - 1 for x in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").alias("h")).collect()]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "a b", "A b C d É É", "x y z " * 50, "é b c d", "İ K ſ A"]
    assert [fingerprint(t) for t in texts] == spark_fp(spark, texts)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = near_duplicates(docs).orderBy("doc_id").collect()
    points = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [p for _, p in points] == [fingerprint(r.text) for r in docs.orderBy("doc_id").collect()]
    assert [r.component_id for r in got] == brute(points)
    assert len({r.component_id for r in got}) < len(got)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_odd_tables(spark):
    rows = [(5, None), (3, ""), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "p q r s t"), (None, None)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fp string, rep int")
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(5, 3), (3, 3), (9, 9), (9, 9), (None, 9), (None, None), (None, 3)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.doc_id for r in keep_one(docs).collect()), key=str) == sorted([3, 9, None, None, None], key=str)


@pytest.mark.parametrize("block", [8, 1024])
def test_no_link_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CELL", 10)
    r = random.Random(1)
    fp = {r.getrandbits(64) for _ in range(600)}
    for x in list(fp)[:200]:  # chains and balls
        for _ in range(3):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            fp.add(x)
    fp = sorted(fp)
    signed = [x - (1 << 64) * (x >> 63) for x in fp]
    points = stash(spark.createDataFrame([(x,) for x in signed], "fp long"), "p")
    got = {n.node: n.root for n in components(link_edges(points)).collect()}
    # the same classes: each is named by its least fingerprint there and by its first place here
    roots, want = [got.get(x, x) for x in signed], brute(list(enumerate(fp)))
    assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want)) < len(fp)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=1, max_size=3), st.integers(1, 5))
def test_linked_points_share_a_cell(x, bits, levels):
    y = x ^ sum(1 << b for b in bits)
    vantage = np.random.default_rng(0).integers(0, 2**63, 40).astype("u8")
    at, cell = cells(np.array([x, y], "u8"), vantage, levels)
    assert set(cell[at == 0]) & set(cell[at == 1])


def test_links_and_forest():
    fp = np.random.default_rng(3).integers(0, 2**10, 700).astype("u8")
    i, j = links(fp)
    want = {(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert len(i) == len(want) and {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want
    assert forest(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]


def test_components(spark):
    r = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(60)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    got = {n.node: n.root for n in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {100 + k: 100 for k in range(60)}
    assert {k: v for k, v in got.items() if k < 200} == want
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a and b and a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
