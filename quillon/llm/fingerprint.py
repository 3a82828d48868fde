"""Quartile bucket digests: count hashed byte triplets, keep each bucket's quartile and the length.

Three kinds of triplets of each run of five bytes fall into BUCKETS buckets.
The digest is hex: the length on a logarithmic scale (one byte), the quartiles'
ratios (two half bytes), then two bits for each bucket: how many of the three
quartiles of all the counts its count exceeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import bucket_bounds, bucket_of, partitions

BUCKETS = 256
#: Places of a triplet's bytes in the run, and the odd multipliers of its hash.
TRIPLETS = (((0, 1, 2), (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)), ((0, 1, 3), (0x27D4EB2F, 0x165667B1, 0x9E3779B9)), ((0, 2, 4), (0xD6E8FEB9, 0xCA9B0A4D, 0xA3D8A4F5)))
#: A difference of this much for each bucket, or more, is a likeness of 0. Unrelated digests differ by 1.6 a bucket, those of unrelated texts in one language by less.
WORST = 1.25
#: Difference of two buckets whose quartiles are so far apart.
STEP = np.array([0, 1, 2, 6], "u2")
#: Weight of a step of the length's scale (an eighth of a doubling), up to so many steps; of a step of a ratio.
LENGTH_WEIGHT, LENGTH_MOST, RATIO_WEIGHT = 1, 64, 1


def counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets of data; all zero under three bytes."""
    total, raw = np.zeros(BUCKETS, "i8"), np.frombuffer(data, "u1").astype("u4")
    for places, factors in TRIPLETS:
        n = len(raw) - places[-1]
        if n > 0:
            h = sum(raw[p : p + n] * np.uint32(f) for p, f in zip(places, factors, strict=True))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """The digest of a text's UTF-8 bytes."""
    c = counts(data)
    q = np.partition(c, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    code = (c > q[0]).astype("u1") + (c > q[1]) + (c > q[2])
    body = (code.reshape(-1, 4) << np.array([6, 4, 2, 0], "u1")).sum(axis=1, dtype="u1").tobytes()
    size = min(255, int(8 * np.log2(len(data) + 1)))
    ratios = [int(15 * q[k] // q[2]) if q[2] else 0 for k in (0, 1)]
    return bytes([size, ratios[0] << 4 | ratios[1]]).hex() + body.hex()


def difference(a: str, b: str) -> int:
    """Bounded difference score of two digests: 0 for equal ones."""
    x, y = (np.frombuffer(bytes.fromhex(d), "u1").astype("i2") for d in (a, b))
    head = LENGTH_WEIGHT * min(LENGTH_MOST, abs(int(x[0]) - int(y[0]))) + RATIO_WEIGHT * sum(abs((int(x[1]) >> s & 15) - (int(y[1]) >> s & 15)) for s in (0, 4))
    gaps = np.abs((x[2:, None] >> np.array([6, 4, 2, 0]) & 3) - (y[2:, None] >> np.array([6, 4, 2, 0]) & 3))
    return head + int(STEP[gaps].sum())


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 at a difference of WORST a bucket."""
    return 1.0 if a == b else max(0.0, 1.0 - difference(a, b) / (WORST * BUCKETS))


def with_fingerprint(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs with the digest of each whole text; null is an empty text, a clashing column is replaced."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([digest((x or "").encode()) for x in texts.to_pylist()], pa.string())

    return docs.withColumn(column, run(F.col("text").cast("string")))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, share: int = 3) -> DataFrame:
    """Each document against its edited text and the next document, in descending doc_id order (after the last: the first).

    The edited text has the last floor(n_chars / share) code points replaced by
    the first as many (or all) of the next text. Null texts are empty; a single
    document is its own next. Null doc_ids come last; equal doc_ids follow each
    other by text, descending. No rows give no rows; other columns are left out.

    Ranges of doc_ids become buckets. Every bucket also gets the first rows of
    the nearest bucket below it, in the same shuffle that sorts, so each task
    sees a row and its next; only cut points and one id for each bucket reach
    the driver.
    """
    p = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = bucket_bounds(rows, "doc_id", p)
    keyed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket_of(F.col("doc_id"), bounds)))
    tops = {r["bucket"]: r["top"] for r in keyed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # The first row of each bucket is also lent to the bucket above; the very first goes to the lowest.
    lent = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    table = docs.sparkSession.createDataFrame([(b, tops[b], lent[b]) for b in order], "bucket int, top long, also int")
    keyed = keyed.join(F.broadcast(table), "bucket")  # as many rows as buckets
    home = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("lent"))
    loan = F.struct(F.col("also").alias("b"), F.lit(True).alias("lent"))
    homes = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(home, loan)).otherwise(F.array(home)))
    dealt = keyed.select("doc_id", "text", homes.alias("home")).select((F.col("home.b") + 1).alias("bucket"), F.col("home.lent").alias("lent"), "doc_id", "text")
    dealt = dealt.repartitionById(p + 1, F.col("bucket")).sortWithinPartitions("bucket", "lent", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, str, str, str, str]]:
            held = None  # (bucket, doc_id, text, digest) that waits for its next
            for batch in batches:
                for bucket, is_lent, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0] != bucket:
                        raise ValueError("a bucket has no lent row")
                    if is_lent and not held:
                        continue  # copies of the lent row
                    text = text or ""
                    mark = digest(text.encode())
                    if held:
                        yield held[1], held[2], held[3], text, mark
                    held = None if is_lent else (bucket, doc, text, mark)
            if held:
                raise ValueError("a bucket has no lent row")

        out: list[tuple] = []
        for doc, text, mark, after, after_mark in pairs():
            k = len(text) // share
            edited = (text[: len(text) - k] + after[:k]).encode()
            edited_mark = digest(edited)
            out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)))
            if len(out) == 512:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])
