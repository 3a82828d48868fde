"""Digests and the walk from each document to its next, against a plain loop."""

import hashlib

import pytest

from quillon.llm.fingerprint import BUCKETS, WORST, compare_with_next, counts, difference, digest, likeness, with_fingerprint


def plain(rows):
    """rows: (doc_id, text) -> what compare_with_next gives, by a loop."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = (digest(x.encode()) for x in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts_are_those_of_a_loop():
    from quillon.llm.fingerprint import TRIPLETS

    data, want = bytes(range(40)) * 2 + b"abc", [0] * BUCKETS
    for places, factors in TRIPLETS:
        for i in range(len(data) - places[-1]):
            h = sum(data[i + p] * f for p, f in zip(places, factors)) & 0xFFFFFFFF
            h ^= h >> 15
            want[((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> 24] += 1
    assert counts(data).tolist() == want


def test_likeness_bounds_and_separation(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    near, far = [], []
    for a, b in zip(texts, texts[1:]):
        x, y, z = digest(a.encode()), digest((a[: len(a) * 9 // 10] + b[: len(a) // 10]).encode()), digest(b.encode())
        near.append(likeness(x, y))
        if a != b:
            far.append(likeness(x, z))
        assert likeness(x, x) == 1 and difference(x, y) == difference(y, x)
    assert all(0 <= v <= 1 for v in near + far)
    assert sum(near) / len(near) > 0.65 > 0.35 > sum(far) / len(far)
    assert difference("0000" + "00" * (BUCKETS // 4), "ffff" + "ff" * (BUCKETS // 4)) > WORST * BUCKETS


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(compare_with_next(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "one")],
        [(None, None)],
        [(5, "a" * 9000), (5, "a" * 9000), (5, None), (None, "x"), (None, None), (2, ""), (3, "né" * 50)],
        [(k % 3, f"text {k} " * (k % 40)) for k in range(120)],
    ],
)
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, bucket int")
    assert got(compare_with_next(docs)) == plain(rows)


def test_general_form(spark):
    docs = spark.createDataFrame([("a b c",), (None,), ("a b c",)], "text string")
    marks = [r.fingerprint for r in with_fingerprint(docs).collect()]
    assert marks == [digest(b"a b c"), digest(b""), digest(b"a b c")]
