"""Removed words against a count of every window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillon.llm import substring_dedup
from quillon.llm.substring_dedup import Words, remove_repeats


def brute(rows, window=35):
    cut = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for doc, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(remove_repeats(docs)) == want
    assert sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40 if seed else 3000)]
    passages = [r.choices(words, k=r.choice([20, 34, 35, 36, 50, 90])) for _ in range(12)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(r.randint(0, 4)):
            text += r.choices(words, k=r.randint(0, 60)) + r.choice(passages)
        rows.append((k, " ".join(text)))
    rows += [(100, "a " * 34), (101, "b " * 36), (102, "c " * 200), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(9000))
    rows = [(None, None), (None, long), (1, ""), (2, " \n "), (3, long), (3, long), (None, "p " * 40), (4, "\x1c".join("abc") + " é" * 35)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, first int, g string")
    assert got(remove_repeats(df)) == brute(rows)
    assert remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 3])
def test_hashes_only_deal(spark, monkeypatch, bits):
    """With 64-bit hashes cut to a few bits nearly everything collides; digests of the words still tell all apart."""
    real = substring_dedup.mix
    monkeypatch.setattr(substring_dedup, "mix", lambda x: real(x) & np.uint64((1 << bits) - 1))
    r = random.Random(7)
    same = r.choices("abcdefghij", k=60)
    rows = [(k, " ".join(r.choices("abcdefghij", k=50) + (same if k % 3 else []))) for k in range(30)]
    # the workers import the module anew, so the hashes are cut where the segments are made
    whole = [Words(t).segments() for _, t in rows]
    assert all(len(set(s.tolist())) <= 1 << bits for _, _, s in whole)
    cut = substring_dedup._segments

    def dealt(df, window):
        return cut(df, window).withColumns({c: F.pmod(c, F.lit(1 << bits)) for c in ("g", "a", "b")})

    monkeypatch.setattr(substring_dedup, "_segments", dealt)
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_many_copies_of_one_row(spark):
    """Equal rows are joined once however many there are."""
    text = " ".join(f"w{k % 700}" for k in range(900))
    rows = [(7, text)] * 3000 + [(None, text)] * 1000 + [(8, "other " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(remove_repeats(df))
    assert len(out) == 4001 and {x[2] for x in out} == {900} and {x[1] for x in out} == {900, 901}


def test_paths_are_maximal_in_spans(spark):
    """Each row's spans are the runs of repeated windows, joined over nonbranching nodes."""
    r = random.Random(4)
    shared = r.choices([f"v{k}" for k in range(500)], k=200)
    rows = [(k, " ".join(r.choices([f"u{k}-{j}" for j in range(900)], k=40) + shared + [f"end{k}"])) for k in range(4)]
    for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(s.first, s.end) for s in x.spans] == [(40, 40 + 200 - 34)]


def test_segments_cover_all_windows_and_follow_content():
    r = random.Random(3)
    words = [str(r.randint(0, 10**6)) for _ in range(400)]
    own = Words(" ".join(words))
    first, count, seed = own.segments()
    assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == 366
    whole = {tuple(x) for x in own.digests(first, count + 34).tolist()}
    inner = Words(" ".join(words[100:300]))
    f2, c2, s2 = inner.segments()
    mine = {tuple(x) for x in inner.digests(f2, c2 + 34).tolist()}
    assert set(s2.tolist()) <= set(seed.tolist()) and len(mine & whole) >= len(mine) - 2
    assert inner.hashes(np.array([0]), 35) == Words(" ".join(words)).hashes(np.array([100]), 35)
