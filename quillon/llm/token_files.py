"""Token ids as frequency ranks in a byte-aligned variable-length code with separate control bytes.

A file set has a table of ranks (the most frequent id is rank 0) and blocks.
A block holds whole documents in ascending doc_id order: ``control`` has two
bits for each id (its byte count less one, four ids a byte, lowest bits first)
and ``data`` has the ranks' low bytes end to end. Blocks and ranks are rows of
Parquet tables, so Spark's committer writes them on any shared store and a lost
executor's attempt leaves nothing behind. Decoding looks each control byte up
in a 256 by 4 table; no loop runs over ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.encoding import encoder
from quillon.llm.shared import bucket_bounds, bucket_of, partitions, stash

#: Ids in a block before it is closed (a document is never split).
BLOCK_IDS = 500_000
BLOCK_SCHEMA = "bucket int, block int, first long, n_ids long, doc_ids binary, doc_null binary, lengths binary, control binary, data binary"
#: Byte counts of the four ids under each control byte.
WIDTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], "u1")


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 ranks."""
    raw = ranks.astype("<u4")
    width = 1 + (raw > 0xFF).astype("u1") + (raw > 0xFFFF) + (raw > 0xFFFFFF)
    two = np.zeros(-(-len(raw) // 4) * 4, "u1")
    two[: len(raw)] = width - 1
    control = (two.reshape(-1, 4) << np.array([0, 2, 4, 6], "u1")).sum(axis=1, dtype="u1")
    data = raw.view("u1").reshape(-1, 4)[np.arange(4) < width[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of (control, data)."""
    width = WIDTHS[np.frombuffer(control, "u1")].reshape(-1)[:n].astype("i8")
    raw = np.concatenate([np.frombuffer(data, "u1"), np.zeros(3, "u1")])
    at = np.cumsum(width) - width
    out = raw[at].astype("u4")
    for k in (1, 2, 3):
        wide = np.flatnonzero(width > k)
        out[wide] |= raw[at[wide] + k].astype("u4") << np.uint32(8 * k)
    return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian, 16 bits where the vocabulary allows, end_id last); null texts are empty."""
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in code.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def id_type(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def frequency_ranks(tokens: DataFrame, kind: str) -> DataFrame:
    """rank, id, n: every id that occurs, most frequent first, ties by id. Rows are at most the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, "i8")
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(part) > len(total):
                total, part = part.astype("i8"), total
            total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((-r["n"], r["id"]) for r in counts.collect()))
    return tokens.sparkSession.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(rows)], "rank int, id long, n long")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of every document to path/blocks and path/ranks, in ascending doc_id order.

    Null doc_ids come first, equal doc_ids by their ids. Null texts are empty
    documents with the end id alone. Columns other than doc_id and text are not
    read. No documents give an empty file set.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer)
    tokens = stash(tokenize(docs, tokenizer, end_id), "tokens")
    ranks = frequency_ranks(tokens, kind)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    known = np.array([(r["id"], r["rank"]) for r in ranks.collect()], "i8").reshape(-1, 2)
    table = np.zeros(int(known[:, 0].max(initial=0)) + 1, "u4")
    table[known[:, 0]] = known[:, 1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        state = {"bucket": None, "block": 0, "first": 0, "size": 0}

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                lengths = np.array([len(x) // np.dtype(kind).itemsize for _, x in held], "<u4")
                control, data = pack_ranks(table[np.frombuffer(b"".join(x for _, x in held), kind)])
                ids = np.array([d or 0 for d, _ in held], "<i8").tobytes()
                void = np.packbits([d is None for d, _ in held]).tobytes()
                row = [state["bucket"], state["block"], state["first"], int(lengths.sum()), ids, void, lengths.tobytes(), control, data]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
                state.update(block=state["block"] + 1, first=state["first"] + row[3], size=0)
                held.clear()

        for batch in batches:
            for bucket, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != state["bucket"]:
                    yield from close()
                    state.update(bucket=bucket, block=0, first=0)
                held.append((doc, ids))
                state["size"] += len(ids) // np.dtype(kind).itemsize
                if state["size"] >= BLOCK_IDS:
                    yield from close()
        yield from close()

    p = partitions(spark)
    dealt = tokens.select(bucket_of(F.col("doc_id"), bucket_bounds(tokens, "doc_id", p)).alias("bucket"), "doc_id", "ids")
    dealt = dealt.repartitionById(p, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32[, ids as little-endian uint32]."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "u4")
    starts, total = {}, 0
    for r in blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect():
        starts[r["bucket"]] = total
        total += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype("i8")
                got = ids[unpack_ranks(row["control"], row["data"], row["n_ids"])].astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                each = [got[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                void = np.unpackbits(np.frombuffer(row["doc_null"], "u1"))[: len(ends)].astype(bool)
                out = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=void),
                    pa.array(starts[row["bucket"]] + row["first"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(each, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("bucket", "first", "n_ids", "doc_ids", "doc_null", "lengths", "control", "data").mapInArrow(decode, schema)
