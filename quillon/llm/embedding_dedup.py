"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points in order (``described_by``
says how many). Each such point has, for each label, an inverted list of the
vectors that name it. Two vectors are candidates where they share two points or
more; the list of the smallest shared point compares them, so a pair is seen
once. The cosine of whole vectors in double precision decides. Beyond MOST
points lists grow with the input, so a list of more than SPLIT vectors becomes
lists by its second point: the same candidates, each in the list of the two
smallest points shared. What is still long is dealt out in blocks and all
pairs of blocks, so no list is one task and none is capped.

Reference points are a bounded sample, no two of them within the threshold, and
only describe; every vector is indexed. Where the sample itself is dense (a
point with CROWD sampled ones within the threshold), points would crowd each
other out of the permutations. There the search is exact: each such point is a
centre, a vector within the threshold of one is at home with the nearest, and
by the triangle bound whatever it links with is within twice the angle, so it
is at home there or visits. A pair belongs to the lower of its homes; only
pairs of vectors without a home are left to the permutations, which are
approximate by nature: ``recall`` in the tests holds the index above 0.9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components, forest
from quillon.llm.shared import partitions, stash

NEAREST, SHARED = 5, 2
#: Vectors of a list that is split by a second point.
SPLIT = 2048
#: Reference points: so that a label's lists hold about LIST vectors, within these bounds.
LIST, FEWEST, MOST = 400, 32, 2048
#: Points that the references are taken from, and sampled points about one (itself too) that make it a centre.
SAMPLE, CROWD = 4096, 3
#: Rows of a list that are compared as one block.
BLOCK = 512


def described_by(points: int) -> int:
    """Points that describe a vector: more of them where they stand closer, for at least 0.98 of random pairs at 0.93."""
    return NEAREST + max(0, math.ceil(math.log(points / 128, 4)))


def usable(vector: Column) -> Column:
    """No null, not-a-number or infinite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(v: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's k nearest pivots, nearest first."""
    return np.argsort(-(unit(v) @ pivots.T), axis=1, kind="stable")[:, :k].astype("i4")


def spread(sample: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of the sample (unit rows) in order, none within ``least`` of an earlier one; those of them with a crowd about them."""
    left, chosen, dense = np.ones(len(sample), bool), [], []
    for k in range(len(sample)):
        if left[k]:
            near = sample @ sample[k] >= least
            left &= ~near
            chosen.append(k)
            if near.sum() >= CROWD:
                dense.append(k)
    return sample[chosen], sample[dense]


def homes(v: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each unit row's home (-1 - its nearest centre; 0 where none is within ``least``), and all lists of centres it is in."""
    if not len(centres):
        return np.zeros(len(v), "i4"), [np.zeros(0, "i4")] * len(v)
    cos = v @ centres.T
    best = cos.argmax(axis=1)
    own = np.where(cos[np.arange(len(v)), best] >= least - 1e-9, best, len(centres))
    # Twice the angle; the home itself is within it, lower centres are visited and higher ones visit here.
    reach = (2 * least * least - 1 if least > 0 else -1) - 1e-9
    within = (cos >= reach) & (np.arange(len(centres)) <= own[:, None])
    return np.where(own < len(centres), -1 - own, 0).astype("i4"), [-1 - np.flatnonzero(x).astype("i4") for x in within]


def home_pairs(home: np.ndarray, centre: int) -> np.ndarray:
    """Upper-triangle mask of pairs of which one is at home here."""
    own = home == centre
    return np.triu(own[:, None] | own[None], 1)


def candidate_pairs(perm: np.ndarray, pivot: int, second: int) -> np.ndarray:
    """Upper-triangle mask of pairs that share SHARED points, the smallest of which is pivot (and the next second, where it is not -1)."""
    n = len(perm)
    count, smaller = np.zeros((n, n), "u1"), np.zeros((n, n), "u1")
    bound = pivot if second < 0 else second
    for a in range(perm.shape[1]):
        for b in range(perm.shape[1]):
            same = perm[:, a, None] == perm[None, :, b]
            count += same
            smaller += same & (perm[:, a, None] < bound)
    return np.triu((count >= SHARED) & (smaller == (second >= 0)), 1)


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link where labels are equal and not null, lengths are equal and the
    cosine is ``least`` or more. A null vec_id, label or vector, a zero vector
    and null or non-finite components link with nothing: their row is its own
    component. n_links counts the other rows linked directly (a repeated row is
    another row), component_id is the smallest vec_id reachable, kept says that
    the row is that one (false for a null vec_id). Other columns are left out;
    no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keys = ["label", "h1", "h2"]
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))})
    # Exact copies become one point with a weight; the array is the same for all of them.
    points = rows.where("ok").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("v").alias("v"))
    points = stash(points.withColumn("dim", F.size("v")), "points")
    sizes = points.groupBy("dim").agg(F.count("*").alias("n")).collect()
    largest = max((r["n"] for r in points.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1).collect()), default=0)
    m = int(min(MOST, max(FEWEST, largest * NEAREST // LIST)))
    pivots, centres = {}, {}
    for r in sizes:  # one set for each vector length; a table has one or a few
        sample = points.where(F.col("dim") == r["dim"]).orderBy("h1", "h2", "label").limit(SAMPLE).select("v").collect()
        apart, centres[r["dim"]] = spread(unit(np.array([x["v"] for x in sample])), least)
        pivots[r["dim"]] = apart[:m]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for low in range(0, part.num_rows, 2048):
                    own = part.slice(low, 2048)
                    perm = nearest(matrix(own.column(4)), pivots[int(d)], described_by(len(pivots[int(d)])))
                    width = pa.array(np.arange(0, perm.size + 1, perm.shape[1], "i4"))
                    home, lists = homes(unit(matrix(own.column(4))), centres[int(d)], least)
                    lists = [x if h else np.concatenate([x, y]) for h, x, y in zip(home, lists, perm)]
                    ends = pa.array(np.cumsum([0, *map(len, lists)]).astype("i4"))
                    made = [pa.ListArray.from_arrays(width, pa.array(perm.reshape(-1))), pa.array(home), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists).astype("i4")))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *made], ["dim", "label", "rep", "weight", "v", "perm", "home", "lists"])

    described = points.select("dim", "label", "rep", "weight", "v").mapInArrow(describe, "dim int, label string, rep long, weight long, v array<double>, perm array<int>, home int, lists array<int>")
    described = stash(described, "described")
    place = ["dim", "label", "pivot"]
    counted = described.select(*place[:2], F.explode("lists").alias("pivot")).groupBy(*place).agg(F.count("*").alias("n"))
    lists = stash(counted.where("n > 1").withColumn("split", (F.col("n") > SPLIT) & (F.col("pivot") >= 0)), "lists")
    posted = described.withColumn("pivot", F.explode("lists")).drop("lists").join(lists, place)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    body = ["rep", "weight", "perm", "v", "home"]
    whole = posted.where("not split").select(*place, F.lit(-1).alias("second"), blocks, *body)
    place = [*place, "second"]
    if not lists.where("split").isEmpty():
        finer = posted.where("split").withColumn("second", F.explode(F.filter("perm", lambda q: q > F.col("pivot")))).select(*place, *body)
        again = finer.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").select(*place, blocks)
        whole = whole.unionByName(finer.join(stash(again, "lists"), place).select(*place, "blocks", *body))
    posted = whole
    salt = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(F.col("salt"), t).alias("s"), F.greatest(F.col("salt"), t).alias("t")))
    dealt = posted.withColumn("salt", salt.cast("int")).withColumn("pair", F.explode(pairs))
    dealt = dealt.select(F.xxhash64(*place, "pair").alias("cell"), *place, "salt", (F.col("pair.s") != F.col("pair.t")).alias("across"), "rep", "weight", "perm", "v", "home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 5):  # by the list itself: cells only deal
            pivot, second, salt, across, rep, weight = (c.to_numpy(zero_copy_only=False) for c in group.columns[3:9])
            if len(rep) < 2:
                continue
            order = np.argsort(rep, kind="stable")
            perm, v = matrix(group.column(9)).astype("i4")[order], unit(matrix(group.column(10)))[order]
            rep, weight, salt = rep[order], weight[order], salt[order]
            mask = candidate_pairs(perm, int(pivot[0]), int(second[0])) if pivot[0] >= 0 else home_pairs(group.column(11).to_numpy()[order], int(pivot[0]))
            if across[0]:
                mask &= salt[:, None] != salt[None, :]
            i, j = np.nonzero(mask & (v @ v.T >= least - 1e-9))
            exact = np.einsum("ij,ij->i", v[i], v[j]) >= least
            i, j = i[exact], j[exact]
            if not len(i):
                continue
            n = np.bincount(i, weight[j], len(rep)).astype("i8") + np.bincount(j, weight[i], len(rep)).astype("i8")
            root, some = forest(len(rep), i, j), n > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root][some]), pa.array(n[some])], ["a", "b", "n"])

    found = dealt.repartition(partitions(spark), "cell").sortWithinPartitions("cell", *place).mapInArrow(compare, "a long, b long, n long")
    found = stash(found, "links")
    counted = found.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found)
    known = points.select(*keys, "rep", "weight").join(counted, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = stash(known.select(*keys, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "known")
    joined = rows.where("ok").select("vec_id", *keys).join(known, keys)
    alone = rows.where("not coalesce(ok, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of equal first columns (so many) in sorted batches; none of them is null."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if held and any(held[0].column(k)[0].as_py() != batch.column(k)[a].as_py() for k in range(keys)):
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
