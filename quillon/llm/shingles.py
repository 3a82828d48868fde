"""Near-duplicates by the Jaccard similarity of their word shingles: SimHash trees and MinHash bands propose, the sets decide.

A set's SimHash fingerprint goes through the vantage-point trees of
``quillon.llm.simhash``: sets whose fingerprints three bits connect are one
bucket. At a similarity of 0.8 fingerprints differ by more bits than trees can
search, so MinHash bands propose what the trees cannot: BANDS bands of ROWS
minima miss a pair of similarity 0.8 with a chance of 3e-5. What is less alike
is compared and refused, whoever proposes it. Texts with equal sets are one
point; buckets with the same members are compared once. Buckets are dealt in
blocks of BLOCK, by a hash of bucket and point, so the blocks of one group
differ from bucket to bucket and join; where a large bucket is still in several
components, all that is outside its largest is compared with everything in it.
Nothing is capped.

All texts are dealt once, to be told what is known by then: a copy of another
row's set goes, and only the one row of a set that is proposed is open. Texts,
which are smaller than their sets, are what meets in buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.embedding_dedup import _runs
from quillon.llm.shared import carried, partitions, stash, stash_small
from quillon.llm.simhash import link_edges

LEAST, BANDS, ROWS, BLOCK = 0.8, 20, 4, 128
#: Buckets are compared in steps: most of what is alike is joined in the first (the trees' buckets and two bands), and of the later bands only buckets that are not one component yet are compared.
TREES, STEPS = -1, (-1, 2, BANDS)
_SEEDS = np.random.default_rng(7).integers(0, 2**64, (2, BANDS * ROWS), "u8") | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of so many words; a shorter text is one run, no words are none."""
    w = (text or "").encode().lower().split()
    grams = {b" ".join(w)} if 0 < len(w) < words else {b" ".join(g) for g in zip(*[w[k:] for k in range(words)])}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), "u8", len(grams)))


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 1)


def bands(own: np.ndarray) -> np.ndarray:
    """A number for each band: the same where a band's minima are."""
    low = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for k in range(0, len(own), 4096):
        x = (own[k : k + 4096, None] ^ _SEEDS[0]) * _SEEDS[1]
        low = np.minimum(low, x.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], "u8")


def print_of(own: np.ndarray) -> int:
    """SimHash of a set: a bit is set where over half the members have it."""
    bits = np.unpackbits(own.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * bits > len(own), bitorder="little").tobytes(), "little")


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


ROW = "row"


def _doc_id() -> Column:
    return F.col("own.doc_id").cast("long")


def _text() -> Column:
    return F.col("own.text").cast("string")


def _rowed(docs: DataFrame) -> DataFrame:
    """own (the columns of docs) and a hash of doc_id and text: rows with equal ones are equal there."""
    return docs.select(carried(docs), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(ROW))


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column(2)]
            keys = np.array([set_key(s) for s in sets], "u8").view("i8")
            prints = np.array([print_of(s) for s in sets], "u8").view("i8")
            marks = [bands(s).view("i8") for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(prints), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "row", "key", "fp", "bands"])

    return rows.select(_doc_id().alias("doc_id"), ROW, _text().alias("text")).mapInArrow(run, "doc_id long, row long, key long, fp long, bands array<long>")


def _verify(dealt: DataFrame, words: int) -> DataFrame:
    """dealt: cell, key, root, side, text -> a, b: links that connect what the cells' similar sets connect and roots do not yet.

    Two of side 1 meet elsewhere and are not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            keys, first = np.unique(group.column(1).to_numpy(), return_index=True)
            root = group.column(2).to_numpy()[first]
            side = group.column(3).to_numpy()[first]
            if (root == root[0]).all():
                continue
            sets = [shingle_set(group.column(4)[int(k)].as_py(), words) for k in first]
            found = []
            for i in range(len(keys)):
                for j in range(i):
                    if root[i] != root[j] and not (side[i] and side[j]) and alike(sets[i], sets[j]):
                        found.append((keys[i], keys[j]))
                        root[root == root[j]] = root[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(found, "i8").T], ["a", "b"])

    spark = dealt.sparkSession
    return dealt.repartition(partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _buckets(points: DataFrame) -> DataFrame:
    """points: key, fp, bands -> key, band, cell: a bucket of the trees and one of each band for each key."""
    prints = stash_small(points.select("fp").distinct(), "prints")
    groups = stash_small(components(link_edges(prints)), "groups")
    met = points.select("key", "fp").join(groups, F.col("fp") == F.col("node"), "left")
    trees = met.select("key", F.lit(TREES).alias("band"), F.xxhash64(F.lit("trees"), F.coalesce("root", "fp")).alias("cell"))
    return trees.unionByName(points.select("key", F.posexplode("bands").alias("band", "cell")))


def _grouped(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored prints: doc_id, row, key; told: own, row, open, times; named: key, doc, own, root).

    told lacks what goes in any case. Of its rows, open is the key of those that
    are their set's only ones left and proposed; times is over 1 for one that is repeated.
    """
    rows = _rowed(docs)
    prints = stash(_sketches(rows, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row")).alias("first")
    points = prints.groupBy("key").agg(F.count("*").alias("n"), first, F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    points = stash(points.select("key", "n", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("own"), "fp", "bands"), "points")
    each = _buckets(points)
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"), F.min("band").alias("band")]
    cells = each.groupBy("cell").agg(*same).where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "cell")).alias("c"))
    cells = stash_small(cells.select("c.cell", "c.band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cells")
    posted = stash(each.drop("band").join(cells, "cell").withColumn("salt", F.pmod(F.xxhash64("cell", "key"), F.col("blocks")).cast("int")), "posted")
    wanted = posted.select("key").distinct().withColumn("wanted", F.lit(True))
    risky = stash_small(points.select("key", "n", "own").join(wanted, "key", "left").where("n > 1 or wanted"), "risky")
    # Of equal sets one row stays, the first; others go at once, but for those that cannot be told apart.
    counted = prints.groupBy("row", "key", F.col("doc_id").isNull().alias("void")).agg(F.count("*").alias("times")).join(risky, "key")
    lead = F.col("row") == F.col("own")
    marks = [F.when(lead & F.col("wanted"), F.col("key")).alias("open"), (~lead & ~F.col("void")).alias("gone"), F.when(~F.col("void"), F.col("times")).otherwise(1).alias("times")]
    risk = stash_small(counted.select(F.col("row").alias(ROW), *marks).where("open is not null or gone or times > 1"), "risk")
    told = rows.join(risk, ROW, "left").where(~F.coalesce("gone", F.lit(False))).select("own", ROW, "open", F.coalesce("times", F.lit(1)).alias("times"))
    told = stash(told, "texts")
    texts = told.where("open is not null").select(F.col("open").alias("key"), _text().alias("text"), "times")
    texts = stash(texts.where("times = 1").unionByName(texts.where("times > 1").dropDuplicates(["key"])).select("key", "text"), "open")

    def rooted(rows: DataFrame, links: DataFrame | None) -> DataFrame:
        """rows of cells whose keys are in several components of links, with each key's root."""
        if links is None:
            return rows.withColumn("root", F.col("key"))
        groups = stash_small(components(links), "groups")
        told = stash_small(rows.join(groups, F.col("key") == F.col("node"), "left").select("cell", "key", "blocks", "salt", F.coalesce("root", "key").alias("root")), "rooted")
        apart = told.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cell")
        return told.join(stash_small(apart, "apart"), "cell", "left_semi")

    def compared(dealt: DataFrame) -> DataFrame:
        return stash(_verify(dealt.join(texts, "key").select("cell", "key", "root", "side", "text"), words), "links")

    links, both = None, F.lit(0).alias("side")
    for low, high in zip(STEPS, STEPS[1:]):
        part = posted.where((F.col("band") >= low) & (F.col("band") < high))
        found = compared(rooted(part, links).select(F.xxhash64("cell", "salt").alias("cell"), "key", "root", both))
        links = found if links is None else links.unionByName(found)
    large = posted.where("blocks > 1")
    if not large.isEmpty():
        # Of a large bucket most keys are one component by now: the others meet each of its blocks, and one another by pairs of their own blocks.
        apart = stash_small(rooted(large, links).select("cell", "key", "blocks", "salt", "root"), "apart")
        sizes = apart.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
        sizes = stash_small(sizes.select("cell", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("strays")), "sizes")
        sided = stash_small(apart.join(sizes, "cell"), "sided")
        blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
        main = sided.where("root = main").select(F.xxhash64("cell", "salt", F.lit("main")).alias("cell"), "key", "root", both)
        stray = sided.where("root <> main")
        met = stray.select(F.explode(F.transform(blocks, lambda t: F.xxhash64("cell", t, F.lit("main")))).alias("cell"), "key", "root", F.lit(1).alias("side"))
        salt = F.pmod(F.xxhash64("key", "cell"), F.col("strays")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda t: F.xxhash64("cell", F.least(salt, t), F.greatest(salt, t)))
        links = links.unionByName(compared(main.unionByName(met).unionByName(stray.select(F.explode(pair).alias("cell"), "key", "root", both))))
    groups = components(links)
    named = points.join(groups, F.col("key") == F.col("node"), "left").select("key", "doc", "own", F.coalesce("root", "key").alias("root"))
    return prints, told, stash_small(named, "named")


def similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable by links of Jaccard similarity LEAST or more); one row for each row.

    Texts without words are alike. Rows with a null doc_id join components but name none.
    """
    prints, _, named = _grouped(docs.select("doc_id", "text"), words)
    least = stash_small(named.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    named = stash_small(named.join(least, "root").select("key", "component_id"), "named")
    return prints.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def keep_one_alike(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one row of each component of ``similar``: that of its smallest doc_id (any one row of equal doc_ids).

    Rows with a null doc_id cannot be told apart and all stay. No rows give none.
    """
    _, told, named = _grouped(docs, words)
    first = F.min(F.struct(F.col("doc").isNull().alias("void"), "doc", "own", "key")).alias("first")
    winners = stash_small(named.groupBy("root").agg(first).select(F.col("first.key").alias("open")), "winners")
    some = _doc_id().isNotNull()
    free = told.where(~some | (F.col("open").isNull() & (F.col("times") == 1)))
    asked = told.where(some & F.col("open").isNotNull()).join(winners, "open", "left_semi")
    again = asked.where("times > 1").unionByName(told.where(some & F.col("open").isNull() & (F.col("times") > 1)).select(*asked.columns))
    return free.select("own").unionByName(asked.where("times = 1").select("own")).unionByName(again.dropDuplicates([ROW]).select("own")).select("own.*")
