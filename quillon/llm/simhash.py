"""SimHash near-duplicates through vantage-point trees over the fingerprints.

Two fingerprints within three bits agree to one bit in one of their halves. So
each half has a tree: at a node, a point's Hamming distance to the node's
vantage point puts it in a ring of two distances, and by the triangle bound a
point within one bit is in the same ring or across its edge. A point goes home
to its own ring and, where it stands at the outer edge, also visits the next:
the boundary-overlapping shard. After LEVELS rings the path is a cell. Inside a
cell a vantage point of its own bounds the search once more (radius three, all
64 bits), and the full distance decides.

Vantage points come from a bounded sample and only steer the work: any points
give the same links. A node takes the sample's point that its path hashes to,
so the tree of any depth needs no table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components, forest
from quillon.llm.shared import partitions, stash

RADIUS = 3
#: Fingerprints that may stand as vantage points.
SAMPLE = 1024
#: Depth is chosen for cells of about so many; larger ones are split in blocks of BLOCK and all block pairs.
CELL, BLOCK = 500, 1024
#: A ring of two distances of 32 bits holds at most 0.2 of random pairs, 0.3 with visitors.
SHRINK = 0.3


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: set where over half the shingles' XXH64 (seed 42) are; 0 without words."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else [b" ".join(g) for g in zip(*[w[k:] for k in range(words)])]
    total, digest = np.zeros(64, "i8"), xxhash.xxh64_intdigest
    for low in range(0, len(grams), 8192):
        h = np.array([digest(g, 42) for g in grams[low : low + 8192]], "<u8")
        total += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * total > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def depth(n: int) -> int:
    """Rings on the way to a cell: they grow with the logarithm of the fingerprints, so that cells do not grow."""
    return max(0, round(math.log(max(1, n / CELL)) / math.log(1 / SHRINK)))


def _down(path: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """The number of a ring's node under a node. Nodes that fall on one number share a cell, which costs comparisons only."""
    x = path.view("u8") * np.uint64(32) + ring.astype("u8") + np.uint64(1)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)).view("i8")


def cells(fp: np.ndarray, vantage: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, cell) of every cell that a fingerprint lives in or visits, in both halves' trees."""
    out = []
    for half in (0, 1):
        own, points = ((x >> np.uint64(32 * half)).astype("u4") for x in (fp, vantage))
        at, path = np.arange(len(fp)), np.full(len(fp), 2 + half, "i8")
        for _ in range(levels):
            mixed = (path.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            d = np.bitwise_count(own[at] ^ points[(mixed % np.uint64(len(points))).astype("i8")]).astype("i8")
            edge = np.flatnonzero(d % 2)
            at, path = np.concatenate([at, at[edge]]), np.concatenate([_down(path, d // 2), _down(path[edge], d[edge] // 2 + 1)])
        out.append((at, path))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within radius bits, by rings about a vantage point of their own."""
    far = np.bitwise_count(fp ^ fp[:1]).astype("i8") if len(fp) else np.zeros(0, "i8")
    order = np.argsort(far, kind="stable")
    ring, own, found = far[order], fp[order], [(np.zeros(0, "i8"),) * 2]
    for d in np.unique(ring):
        a, b, c = np.searchsorted(ring, [d, d + 1, d + radius + 1])
        for low in range(a, b, 2048):
            x, y = np.nonzero(np.bitwise_count(own[low : min(b, low + 2048), None] ^ own[None, low:c]) <= radius)
            keep = x < y
            found.append((order[x[keep] + low], order[y[keep] + low]))
    return tuple(np.concatenate(x) for x in zip(*found))


def link_edges(points: DataFrame) -> DataFrame:
    """points: stored distinct fp -> a, b: edges among fingerprints that connect what links of three bits connect."""
    spark, p = points.sparkSession, partitions(points.sparkSession)
    vantage = np.array([r["fp"] for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], "i8").view("u8")
    levels = depth(points.count())

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                at, cell = cells(fp.view("u8"), vantage, levels)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[at])], ["cell", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _groups(batches):
            fp = np.unique(fp)  # one may come twice to a cell
            i, j = links(fp.view("u8"))
            root = forest(len(fp), i, j)
            own = np.flatnonzero(root != np.arange(len(fp)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

    dealt = points.select("fp").mapInArrow(shard, "cell long, fp long")
    dealt = stash(dealt, "cells")
    crowded = dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = stash(crowded.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
    joined = dealt.join(crowded, "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.xxhash64("cell", F.least(mine, t), F.greatest(mine, t)))
    keys = F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(pair)
    split = joined.select(F.explode(keys).alias("cell"), "fp")
    return split.repartition(p, "cell").sortWithinPartitions("cell").mapInArrow(search, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """fp of each run of equal cells in sorted batches."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        cell, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cell):
            continue
        starts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            if held and last != cell[a]:
                yield np.concatenate(held)
                held = []
            last = cell[a]
            held.append(fp[a:b])
    if held:
        yield np.concatenate(held)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of three bits).

    One row for each row. Texts without words (null and empty ones) have
    fingerprint 0, which links like any other. Rows with a null doc_id get a
    fingerprint; they join components by it but name none, so a component of
    such rows alone has a null component_id. Other columns are left out.
    """
    prints = stash(fingerprints(docs, words), "prints")
    points = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "points")
    # Nodes are fingerprints; their order is that of their smallest documents only at the end.
    groups = components(link_edges(points))
    named = points.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    named = stash(named, "named")
    least = stash(named.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    named = stash(named.join(least, "root").select("fp", "component_id"), "named")
    joined = prints.join(named, "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (any one row of equal doc_ids).

    Rows with a null doc_id cannot be told apart and all stay.
    """
    kept = near_duplicates(docs, words).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n"))
    kept = stash(kept, "kept")
    met = docs.join(kept, "doc_id", "left")
    once, again = met.where("doc_id is null or _n = 1"), met.where("_n > 1").dropDuplicates(["doc_id"])
    return once.unionByName(again).select(*docs.columns)
