"""Best-fit packing by minimum bin slack over the histogram of lengths.

Fewer than ``capacity`` lengths exist, so the corpus reaches the driver as one
count for each length. There, bin after bin, a subset-sum program on a bitset
finds the fullest combination with the longest length left; it is taken as
often as the counts allow. Each combination uses up at least one length's
stock for its purpose, so their number follows the lengths, not the documents.
Rows then find their place from their rank among rows of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.encoding import encoder
from quillon.llm.shared import stash

PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length and salt that are ranked in one group.
PER_SALT, LEAST_SALTS = 50_000, 64
Combination = list[tuple[int, int]]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document's ids (plus end_id): row, doc_id, piece, start, length, ids_crc32[, ids].

    Documents of over ``capacity`` ids are cut so that only the first piece may
    be shorter. Null texts are empty: one piece with the end id. Null and
    repeated doc_ids are kept; ``row`` tells rows apart. Other columns are left
    out. ids, if asked for, is little-endian uint32.
    """
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, end, at = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out: list[list] = [[] for _ in range(7 if with_ids else 6)]
                for doc, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity), strict=True)):
                        own = ids[4 * a : 4 * b]
                        for column, value in zip(out, (at, doc, piece, a, b - a, zlib.crc32(own), own), strict=False):
                            column.append(value)
                        at += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[Combination, int]]:
    """Minimum bin slack: ([(length, how many)], times), longest lengths first, until every length is used up."""
    left, plan = {n: c for n, c in counts.items() if c > 0 and n > 0}, []
    while left:
        order = sorted(left, reverse=True)
        base, slack = order[0], capacity - order[0]
        reach, steps, full = 1, [], 1 << slack
        for n in order:
            if n > slack:
                continue
            most, size = min(left[n] - (n == base), slack // n), 1
            while most > 0 and not reach & full:  # copies in powers of two
                take = min(size, most)
                steps.append((n, take, reach))
                reach |= reach << (n * take)
                most, size = most - take, size * 2
        reach &= (full << 1) - 1
        rest, used = reach.bit_length() - 1, {base: 1}
        for n, take, before in reversed(steps):
            if not before >> rest & 1:
                used[n] = used.get(n, 0) + take
                rest -= n * take
        times = min(left[n] // c for n, c in used.items())
        plan.append((sorted(used.items(), reverse=True), times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def places(plan: list[tuple[Combination, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, how many a bin, first sequence and first offset of each combination that uses it."""
    out: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for used, times in plan:
        at = 0
        for n, c in used:
            out.setdefault(n, []).append([ranks.get(n, 0), c, sequence, at])
            ranks[n] = ranks.get(n, 0) + c * times
            at += n * c
        sequence += times
    return {n: tuple(np.array(x, "i8").T) for n, x in out.items()}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (row: a unique long; length: 1 to capacity) with sequence_id and offset in place of row.

    Sequences hold at most ``capacity`` tokens without gaps from offset 0. A
    full piece is a sequence alone, with a negative number. ``pieces`` must be
    stored (it is read several times). No rows give no rows; equal lengths are
    ranked by ``row``. Null or other lengths fail the job: they have no place.
    """
    short = pieces.where(F.col("length") < capacity)
    per = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spots = places(combinations(per, capacity))
    salts = max(LEAST_SALTS, -(-max(per.values(), default=0) // PER_SALT))
    salted = short.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    each = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("row"))
    ranked = salted.withColumn("_within", within).join(each, ["length", "_salt"])
    columns = [c for c in pieces.columns if c not in ("row", "sequence_id", "offset")]
    ranked = ranked.select(*columns, (F.col("_base") + F.col("_within") - 1).alias("_rank"))
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(columns.index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), "i8"), np.empty(len(ranks), "i8")
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                n = int(lengths[own[0]])
                first, many, start, at = spots[n]
                k = np.searchsorted(first, ranks[own], "right") - 1
                past = ranks[own] - first[k]
                sequence[own], offset[own] = start[k] + past // many[k], at[k] + past % many[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    full = pieces.where(F.col("length") >= capacity).select(
        *columns, (F.when(F.col("length") == capacity, -F.col("row") - 1).otherwise(F.raise_error(F.lit("a piece is over capacity")))).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return ranked.mapInArrow(place, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Cut and pack every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stash(cut_documents(docs, tokenizer, end_id, capacity), "pieces"), capacity)
