"""Cross-tokenizer alignment: a label for each byte, groups by regular expression, links counted over the corpus.

Both tokenizers cut the same bytes. Every byte has a label: no token ends
there, one of A, one of B, or both. A regular expression scans the labels up to
each "both": one group, whose labels say how many tokens of A and B it has.
All A-B pairs in a group are links.

Known setups never merge bytes across a lone space, so texts are cut there and
each distinct piece is aligned once; a task keeps a bounded memory of pieces.
With other setups whole texts are aligned. An id pair's count is the number of
documents that hold it linked; counts come back to the documents in two ways:
the most frequent pairs (never more than HEAVY) by a broadcast, which leaves no
hot key, the others by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.encoding import KNOWN, byte_letters
from quillon.llm.shared import stash

#: Pairs that are broadcast at most (some 40 bytes each).
HEAVY = 1_000_000
#: Pieces a task remembers before its memory starts anew (about 700 bytes each).
MEMORY = 250_000
#: A pair of ids as one number: A's id, then B's in so many bits.
B_BITS = 32
LONE_SPACE, WIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" (?=\s)")
#: Labels of bytes: none, A-end, B-end, both.
NONE, A_END, B_END, BOTH = b"nabc"
GROUP = re.compile(rb"[nab]*c")
EMPTY = np.zeros(0, "i8")

_loaded: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Aligns texts between a byte-level tokenizer (A, of the tokenizers library) and a sentencepiece model (B)."""

    def __init__(self, a_file: str, b_file: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.memory = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file), memory
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        back = {c: b for b, c in byte_letters().items()}
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], "i8") for t in (self.a_bytes, self.b_bytes))
        setup = json.loads(self.a.to_str())
        cut = (setup["normalizer"], setup["pre_tokenizer"]) == KNOWN[0] and not any("▁" in p.lstrip("▁") for p in pieces)
        samples = ["Ab cd", "a,\nb 1 23", "été a  b \n c", " a b", "x中 ­ y!"]
        self.cuts = cut and all([t for s in self.cut(x) for t in self.b.encode(s)] == self.b.encode(x) for x in samples)
        self.known: dict[str, tuple | None] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that stand after a space each. A space may be cut at unless white space follows it, or nothing, or nothing precedes it."""
        return LONE_SPACE.split(text) if WIDE.search(text) or text[0] == " " or text[-1] == " " else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Align pieces that are not known: (tokens of A, of B, groups, groups as text, linked pairs)."""
        a = [e.ids for e in self.a.encode_batch([" " + s for s in new], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), "i8", len(new)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), "i8") for x in (a, b))
        size = np.fromiter((1 + len(s.encode()) for s in new), "i8", len(new))
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        said = (" " + " ".join(new)).encode()
        same = all(np.array_equal(np.diff(np.concatenate([[0], np.cumsum(t[i])])[e], prepend=0), size) for t, i, e in ((self.a_len, a, ends_a), (self.b_len, b, ends_b)))
        if not same or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != said or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != said:
            if len(new) == 1:
                self.known[new[0]] = None
            else:  # some piece's bytes are others: halve until it is found
                self.learn(new[: len(new) // 2])
                self.learn(new[len(new) // 2 :])
            return
        label = np.full(len(said), NONE, "u1")
        label[np.cumsum(self.a_len[a]) - 1] = A_END
        at = np.cumsum(self.b_len[b]) - 1
        label[at] = np.where(label[at] == A_END, BOTH, B_END)
        ends = np.fromiter((m.end() for m in GROUP.finditer(label.tobytes())), "i8") - 1
        to_a, to_b = (np.cumsum((label == x) | (label == BOTH))[ends] for x in (A_END, B_END))
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        pairs = in_a * in_b
        upto = np.cumsum(pairs)
        group = np.repeat(np.arange(len(ends)), pairs)
        k = np.arange(len(group)) - (upto - pairs)[group]
        codes = (a[(to_a - in_a)[group] + k // in_b[group]] << B_BITS) | b[(to_b - in_b)[group] + k % in_b[group]]
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts, i, j = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist()):
            texts.append(text_a[i] + "|" + text_b[j] if x == i + 1 and y == j + 1 else ",".join(text_a[i:x]) + "|" + ",".join(text_b[j:y]))
            i, j = x, y
        last = np.searchsorted(to_a, ends_a)  # the group that ends with each piece
        first = np.concatenate([[0], last[:-1] + 1])
        spots = upto[last].tolist()
        was = 0
        for s, x, y, f, g, p in zip(new, n_a.tolist(), n_b.tolist(), first.tolist(), (last + 1).tolist(), spots):
            self.known[s] = (x, y, g - f, ";".join(texts[f:g]), codes[was:p].tobytes())
            was = p

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(tokens of A, of B, groups, groups as text, linked pairs with repeats) of each text; all empty where bytes differ."""
        if len(self.known) > self.memory:
            self.known = {}
        cut = [[] if not t else self.cut(t) if self.cuts else [t] for t in texts]
        new = list(dict.fromkeys(s for parts in cut for s in parts if s not in self.known))
        for low in range(0, len(new), 20_000):
            self.learn(new[low : low + 20_000])
        for parts in cut:
            own = [self.known[s] for s in parts]
            if not own or None in own:
                yield 0, 0, 0, "", EMPTY
                continue
            x, y, g, said, codes = zip(*own)
            yield sum(x), sum(y), sum(g), ";".join(said), np.frombuffer(b"".join(codes), "i8")


def aligner(a_file: str, b_file: str) -> Aligner:
    """One aligner for each pair of files and worker process."""
    if (a_file, b_file) not in _loaded:
        _loaded[a_file, b_file] = Aligner(a_file, b_file)
    return _loaded[a_file, b_file]


def align_documents(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each document; stored in the shared folder.

    pairs are the distinct linked id pairs (A's id << 32 | B's), times how often each is linked in the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(a_file, b_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, out = batch.slice(low, 256), []
                for n_a, n_b, groups, said, codes in own.align(part.column(1).to_pylist()):
                    pairs, times = np.unique(codes, return_counts=True)
                    digest = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
                    out.append((row, n_a, n_b, groups, len(codes), digest, pairs, times.astype("i4")))
                    row += 1
                rows, *plain, pairs, times = zip(*out)
                at = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype("i4"))
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (pairs, times)]
                made = [pa.array(rows, pa.int64()), part.column(0), *(pa.array(x, t) for x, t in zip(plain, [pa.int64()] * 4 + [pa.string()])), *lists]
                yield pa.RecordBatch.from_arrays(made, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return stash(rows.mapInArrow(run, schema), "aligned")


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id); stored in the shared folder."""
    n = stash(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", B_BITS).alias("a")
    most = n.groupBy(a).agg(F.max("n").alias("most"))
    return stash(n.select("pair", "n", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def heavy_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` pairs have that count; 64 numbers reach the driver."""
    each = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    held, least = 0, 0
    for r in sorted(each, key=lambda r: -r["power"]):
        held += r["n"]
        if held > most:
            return 1 << (r["power"] + 1)
        least = r["power"]
    return 1 << least


def link_documents(docs: DataFrame, a_file: str, b_file: str, heavy: int = HEAVY) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (it adds the space). Byte
    offsets where tokens of both end cut them into groups; n_links counts the
    A-B token pairs that share a group, count_sum adds up their pairs' counts
    of documents, n_best has those whose count is their A id's highest (ties
    included). groups_sha256 is of "a1,a2|b1;a3|b2,b3". Texts that are null,
    empty, or that the tokens do not give back byte for byte have no tokens:
    zeros and ''. Each row is a document: repeated rows and doc_ids count
    again; null doc_ids stay null; other columns are left out.
    """
    aligned = align_documents(docs, a_file, b_file)
    counts = link_counts(aligned)
    least = heavy_from(counts, heavy)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    told = each.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    rare = told.where("n is null").select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair")
    both = told.where("n is not null").groupBy("row").agg(*sums).unionByName(rare.groupBy("row").agg(*sums))
    both = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(both, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
