"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import corpus_pipeline
import numpy as np
import pytest

from quillon.llm import shingles
from quillon.llm.shared import scope


def brute(rows, words=5, least=0.8):
    """Smallest doc_id reachable for each of (doc_id, text), in order of doc_id."""
    split = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{b" ".join(w)} if 0 < len(w) < words else {b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)} for w in split]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return [rows[r][0] for r in root]


@pytest.mark.parametrize("block", [3, 128])
def test_copies_with_replaced_words(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    r, rows = np.random.default_rng(3), []
    for g in range(30):
        base = [f"w{x}" for x in r.integers(0, 4000, 300)]
        for k in range(6):
            w = list(base)
            for at in r.choice(300, k * 2, replace=False):
                w[at] = f"x{r.integers(1_000_000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, ""), (501, None), (502, "a b"), (503, "A  b"), (504, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(set(brute(rows)))
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(set(brute(rows)))
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    assert sorted(str(x.doc_id) for x in corpus_pipeline.near_duplicates(spark, odd, sf).collect()) == ["7", "None", "None"]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_trees_alone_find_what_three_bits_connect(spark, monkeypatch):
    """Without bands the buckets of the SimHash trees still propose; the sets decide."""
    monkeypatch.setattr(shingles, "bands", lambda own: np.random.default_rng(int(shingles.set_key(own))).integers(0, 2**64, shingles.BANDS, "u8"))
    r, rows = np.random.default_rng(5), []
    for g in range(6):
        w = [f"w{x}" for x in r.integers(0, 4000, 400)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w[:-1], "end"]))]
    prints = [shingles.print_of(shingles.shingle_set(t, 5)) for _, t in rows]
    near = [(a ^ b).bit_count() <= 3 for a, b in zip(prints[::2], prints[1::2])]
    assert sum(near) >= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x.doc_id for x in shingles.keep_one_alike(docs).collect())
    assert got == sorted(d for d, _ in rows if d % 2 == 0 or not near[d // 2])


def test_copies_go_before_texts_meet(spark):
    """What goes in any case is not stored with the texts, and a set meets its bucket once."""
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(d, text) for d in range(50)] + [(50, text), (50, text), (60, text + " more"), (60, text + " more"), (70, "alone here"), (70, "alone here"), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, told, _ = shingles._grouped(docs, 5)
    assert sorted(str(r.own.doc_id) for r in told.collect()) == ["0", "60", "60", "70", "70", "None", "None"]
    assert sorted(str(r.doc_id) for r in shingles.keep_one_alike(docs).collect()) == ["0", "70", "None", "None"]


def test_small_tables_are_few_files(spark):
    """Each file that a task writes costs a process on a local file system."""
    other = spark.newSession()
    for k, v in (("spark.sql.shuffle.partitions", "48"), ("spark.sql.adaptive.enabled", "false")):
        other.conf.set(k, v)
    docs = other.range(0, 400, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', sequence(id div 2, id div 2 + 9)) AS text")
    with scope() as made:
        assert shingles.similar(docs).where("component_id < doc_id").count() == 200
        counts = {p.rsplit("/", 1)[1].split("-")[0]: len(other.read.parquet(p).inputFiles()) for p in made}
    assert counts["named"] <= 6 and counts["risk"] <= 6 and counts["prints"] <= 6  # 48 before
