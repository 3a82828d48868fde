"""Substring dedup on a compacted De Bruijn graph of words.

Runs of WINDOW - 1 words are nodes and windows of WINDOW words are edges; an
edge that starts at two places is repeated. Edges are handled in super-k-mers:
consecutive windows whose smallest SEED-word hash is the same occurrence make a
segment, and equal windows always have equal smallest hashes, so only segments
that share one can share a window. The hash only deals; what is equal is told
by a 128-bit digest of the words at a segment's or window's coordinates.

1. Segments meet on that hash. Alone: none of their windows is repeated. One
   content for all: every window is. Several contents: contents that occur
   twice are repeated whole, and the others are opened.
2. Opened segments (and one occurrence, the source, of each other content
   beside them) give their single edges, which are counted by their digests.
3. Repeated segments are edges between the nodes at their ends. Where a node has
   one way in and one way out, what meets there is one path: two joins by node
   compact the graph, and a document's runs of a path become its spans.
4. Documents meet their spans; words that spans cover go.

Rows with equal doc_id and text are one document with a count, before anything
is joined. Counts are combined before each shuffle and hot sides of joins come
fresh from stored tables, so that the adaptive planner can split them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import stash

WINDOW, SEED = 35, 8
#: Characters of texts that are cut into segments at once.
GROUP = 100_000
#: Odd base of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, "u8")
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Words:
    """The words of a text, or of several one after the other, and hashes of any runs of them."""

    def __init__(self, *texts: str | None):
        each = [(t or "").encode().split() for t in texts]  # bytes split at ASCII white space only
        self.sizes = list(map(len, each))
        self.words = each[0] if len(each) == 1 else list(itertools.chain.from_iterable(each))
        self.sums = self.joined = None

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        if self.sums is None:
            each = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), "u8", len(self.words))
            up, self.down = powers(len(each) + 1)
            self.sums = np.zeros(len(each) + 1, "u8")
            np.cumsum(each * up[:-1], out=self.sums[1:])
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype("u8") * np.uint64(BASE))

    def digests(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """128-bit digests of runs of words, two numbers a row."""
        if self.joined is None:
            self.joined = memoryview(b" ".join(self.words) + b" ")
            self.at = np.cumsum([0, *map(len, self.words)]) + np.arange(len(self.words) + 1)
        out = b"".join([xxhash.xxh3_128_digest(self.joined[a:b]) for a, b in zip(self.at[start].tolist(), self.at[start + length].tolist())])
        return np.frombuffer(out, "<i8").reshape(-1, 2)

    def segments(self, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
        """(first window, windows, smallest seed hash) of each segment; no window is in two texts."""
        total = len(self.words) - window + 1
        if total < 1 or max(self.sizes) < window:
            return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
        seeds = self.hashes(np.arange(len(self.words) - seed + 1), seed)
        best, width, need = np.arange(len(seeds)), 1, window - seed + 1
        while width < need:  # leftmost smallest seed of each run of width seeds
            step = min(width, need - width)
            a, b = best[:-step], best[step:]
            best, width = np.where(seeds[b] < seeds[a], b, a), width + step
        at = np.arange(total)
        if len(self.sizes) > 1:
            ends = np.cumsum(self.sizes)
            at = at[at + window <= np.repeat(ends, self.sizes)[:total]]
            best = best[at]
        first = np.flatnonzero(np.diff(best, prepend=-1))
        return at[first], np.diff(first, append=len(at)), seeds[best[first]]

    def removed(self, spans: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
        """Mask of the words that windows of the spans (first window, end) cover."""
        edge = np.zeros(len(self.words) + 1, "i8")
        for a, b in spans:
            edge[a] += 1
            edge[b + window - 1] -= 1
        return np.cumsum(edge[:-1]) > 0

    def kept(self, gone: np.ndarray) -> tuple[int, int, str]:
        left = [w for w, g in zip(self.words, gone.tolist(), strict=True) if not g] if gone.any() else self.words
        return len(self.words), len(self.words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and k1, k2: rows with equal keys have equal doc_ids and texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.coalesce("doc_id", F.lit(-(1 << 63))), "k2": F.xxhash64("doc_id", "text")})


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about GROUP characters."""
    low = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= GROUP:
            yield low, k + 1
            low, held = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


CUT = [("k1", "long", "i8"), ("k2", "long", "i8"), ("first", "int", "i4"), ("n", "int", "i4"), ("g", "long", "i8"), ("d1", "long", "i8"), ("d2", "long", "i8"), ("a", "long", "i8"), ("b", "long", "i8")]


def _segments(rows: DataFrame, window: int) -> DataFrame:
    """k1, k2, text -> k1, k2, first, n, g (smallest hash), d1, d2 (digest), a, b (hashes of the nodes at its ends) of each segment; of text alone: g, d1, d2, and nulls for the others."""
    named = "k1" in rows.columns
    made = [(c, kind, np_kind) for c, kind, np_kind in CUT if named or c in ("g", "d1", "d2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2")) if named else (np.zeros(part.num_rows, "i8"),) * 2
                texts, out = part.column("text").to_pylist(), []
                for a, b in _groups(texts):
                    own = Words(*texts[a:b])
                    first, count, seed = own.segments(window)
                    if len(first):
                        start = np.cumsum(own.sizes) - own.sizes
                        of = np.repeat(np.arange(b - a), own.sizes)[first]
                        digest = own.digests(first, count + window - 1)
                        ends = own.hashes(np.concatenate([first, first + count]), window - 1).view("i8") if named else np.zeros(2, "i8")
                        got = {"k1": k1[a + of], "k2": k2[a + of], "first": first - start[of], "n": count, "g": seed.view("i8"), "d1": digest[:, 0], "d2": digest[:, 1], "a": ends[: len(first)], "b": ends[len(first) :]}
                        out.append([got[c] for c, _, _ in made])
                if out:
                    arrays = [pa.array(np.concatenate(x).astype(kind)) for x, (_, _, kind) in zip(zip(*out), made)]
                    yield pa.RecordBatch.from_arrays(arrays, [c for c, _, _ in made])

    cut = rows.select(*["k1", "k2"] * named, "text").mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind, _ in made))
    return cut.select(*[c if c in cut.columns else F.lit(None).cast(kind).alias(c) for c, kind, _ in CUT])


def _paths(whole: DataFrame) -> DataFrame:
    """Repeated segments of distinct documents -> k1, k2, first, end: runs of each document that are one nonbranching path."""
    edges = stash(whole.select("d1", "d2", "a", "b").distinct(), "edges")
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("out"))
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("into"))
    inner = stash(out.join(into, "node").where("out = 1 and into = 1").select(F.col("node").alias("a"), F.lit(True).alias("inner")), "inner")
    w = Window.partitionBy("k1", "k2").orderBy("first")
    told = whole.join(inner, "a", "left").withColumn("before", F.lag(F.col("first") + F.col("n")).over(w))
    goes_on = F.coalesce(F.col("inner") & (F.col("before") == F.col("first")), F.lit(False))
    numbered = told.withColumn("path", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    return numbered.groupBy("k1", "k2", "path").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("n")).alias("end"))


OPENED = "array<struct<pos:int,g:long,w1:long,w2:long,times:long,asks:boolean>>"
SPANS = "array<struct<first:int,end:int>>"


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, k1, k2 of each row, spans (first window and end, of repeated windows) and n_words, n_removed, kept_sha256.

    Stored in the shared folder. See remove_repeats for what the columns mean.
    """
    rows = _keyed(docs)
    cut = _segments(rows, window)
    content = F.struct("d1", "d2")
    # Cut once more, without the columns that are not asked for: storing all segments would take more disk than the texts.
    met = _segments(rows.select("text"), window).groupBy("g").agg(F.count("*").alias("times"), F.min(content).alias("lo"), F.max(content).alias("hi"))
    met = stash(met.where("times > 1").select("g", (F.col("lo") == F.col("hi")).alias("same")), "met")
    # From here on a row that is repeated is one row with its number of copies.
    columns = ["k1", "k2", "first", "n", "g", "d1", "d2", "a", "b"]
    # Stored between join and count: grouped at once, the rows of a hot hash would stay together in one task.
    alive = stash(cut.join(met, "g"), "met").groupBy(*columns, "same").agg(F.count("*").alias("copies"))
    alive = stash(alive, "alive")
    kinds = alive.where("not same").groupBy("g", "d1", "d2").agg(F.sum("copies").alias("times"), F.min(F.struct("k1", "k2", "first")).alias("source"))
    kinds = stash(kinds, "kinds")
    several = alive.where("not same").join(kinds, ["g", "d1", "d2"])
    several = several.withColumn("lead", F.col("source") == F.struct("k1", "k2", "first"))
    whole = stash(alive.where("same").select(*columns).unionByName(several.where("times > 1").select(*columns)), "whole")
    opened = several.where("times = 1 or lead").select("k1", "k2", "first", "n", "times")
    spans = _paths(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    opens = opened.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n", "times")).alias("opens"))
    # Two outer joins to small tables by the same key: the texts are dealt once.
    marks = stash(spans.join(opens, ["k1", "k2"], "full"), "marks")
    told = rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", "spans", "opens")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), ("opened", pa.list_(pa.struct([("pos", pa.int32()), ("g", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("times", pa.int64()), ("asks", pa.bool_())])))])
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                out = []
                for r in batch.slice(low, 128).to_pylist():
                    text, own = r["text"], Words(r["text"])
                    spans = [(s["first"], s["end"]) for s in r["spans"] or []]
                    asked = []
                    if r["opens"]:
                        first, count, seed = own.segments(window)
                        seeds = dict(zip(first.tolist(), seed.view("i8").tolist()))
                        for o in r["opens"]:
                            at = np.arange(o["first"], o["first"] + o["n"])
                            for pos, (w1, w2) in zip(at.tolist(), own.digests(at, window).tolist()):
                                asked.append({"pos": pos, "g": seeds[o["first"]], "w1": w1, "w2": w2, "times": o["times"], "asks": o["times"] == 1})
                    done = not any(a["asks"] for a in asked)
                    out.append({"doc_id": r["doc_id"], "text": None if done else text, "k1": r["k1"], "k2": r["k2"], "spans": r["spans"] or [], "opened": asked} | dict(zip(("n_words", "n_removed", "kept_sha256"), own.kept(own.removed(spans, window)))))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = f"doc_id long, text string, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}, opened {OPENED}"
    return stash(told.mapInArrow(judge, schema), "judged")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and spans.

    A word goes where a window of ``window`` words covers it whose words also
    start anywhere else, in the same document or another; all windows are
    judged on the input. kept_sha256 is of the words left, joined by a space.
    spans has the first window and the end of each repeated run of windows;
    words ``first`` to ``end + window - 1`` go. Null and empty texts have no
    words; texts under ``window`` words lose none. Null and repeated doc_ids
    are kept apart by text; a repeated row repeats its text. Other columns are
    left out.
    """
    judged = repeated_spans(docs, window)
    edges = stash(judged.select("k1", "k2", F.explode("opened").alias("e")).select("k1", "k2", "e.*"), "opened")
    # A led content counts as often as it occurs.
    edge = ["g", "w1", "w2"]
    counted = stash(edges.groupBy(*edge).agg(F.sum("times").alias("n")).where("n > 1").select(*edge), "repeated")
    found = edges.where("asks").select("k1", "k2", *edge, "pos").join(counted, edge).select("k1", "k2", "pos").distinct()
    found = found.groupBy("k1", "k2").agg(F.collect_list("pos").alias("more"))
    asking = judged.where("text is not null").join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                own = Words(r["text"])
                spans = [(s["first"], s["end"]) for s in r["spans"]] + [(p, p + 1) for p in r["more"] or []]
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                out.append((r["doc_id"], *own.kept(own.removed(spans, window)), [{"first": a, "end": b} for a, b in merged]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    rest = judged.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")
    return rest.unionByName(asking.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}"))
