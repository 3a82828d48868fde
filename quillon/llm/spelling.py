"""Spelling variants: words one code point apart, by Aho-Corasick automata over word halves.

A word within one edit of another holds one of its halves unchanged, at the
start (first half) or at the end (second half). Shards hold words' halves in an
automaton; every word is scanned by each shard that may hold one of its halves.
A hit counts where its offset and the two lengths fit, and the other half must
hold one of its own halves unchanged as well; what is left is compared letter
by letter. A half and such a quarter deal words to shards, so that a frequent
half is spread over them; keys held by more than BLOCK words are split further.
Of a pair's several keys the first counts, so no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import partitions, stash
from quillon.llm.url_rules import LOWER, UPPER

RUN = "([a-zÀ-ÿ]+)"
#: One run of so many is misspelt on purpose (its crc32 tells which).
EVERY = 97
SHORTEST, LEAST = 5, 3
#: Keys of halves in a shard, about, and words with one key that stay together.
SHARD, BLOCK = 40_000, 2_000


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, one of EVERY with a code point left out, of SHORTEST code points and LEAST occurrences."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(1))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def _keys(word: Column, length: Column) -> list[Column]:
    """What a word must have in common with a word of this length: (half, quarter) of the four kinds, hashed.

    0 and 1: first half at the start, then the start or the end of what follows;
    2 and 3: second half at the end, then the start or the end of what precedes.
    """
    half = F.floor(length / 2).cast("int")
    tail, first, last = length - half, F.floor((length - half) / 2).cast("int"), F.floor(half / 2).cast("int")
    own = F.length(word)
    parts = [
        (F.substring(word, F.lit(1), half), F.substring(word, half + 1, first)),
        (F.substring(word, F.lit(1), half), F.right(word, tail - first)),
        (F.right(word, tail), F.substring(word, F.lit(1), last)),
        (F.right(word, tail), F.substring(word, own - tail - (half - last) + 1, half - last)),
    ]
    return [F.xxhash64(F.lit(k), length, *p) for k, p in enumerate(parts)]


def _halves(word: str, length: int) -> list[tuple]:
    """The keys of _keys as they are: (kind, length, half, quarter)."""
    half = length // 2
    tail, first, last = length - half, (length - half) // 2, half // 2
    end = len(word) - tail
    return [
        (0, length, word[:half], word[half : half + first]),
        (1, length, word[:half], word[len(word) - (tail - first) :]),
        (2, length, word[end:], word[:last]),
        (3, length, word[end:], word[end - (half - last) : end]),
    ]


def one_apart(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) == 1 and a[i:] == b[i + 1 :] or len(a) == len(b) and i < len(a) and a[i + 1 :] == b[i + 1 :]


class Shard:
    """Words by key, and the automaton of their halves."""

    def __init__(self) -> None:
        self.held: dict[tuple, list[tuple[str, int]]] = {}
        self.automaton = ahocorasick.Automaton()

    def add(self, word: str, n: int, kind: int) -> None:
        key = _halves(word, len(word))[kind]
        self.held.setdefault(key, []).append((word, n))
        self.automaton.add_word(key[2], len(key[2]))

    def close(self) -> None:
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, word: str) -> tuple[int, int, str] | None:
        """(near words, n of the best, the best) among this shard's words, each at its pair's first key."""
        if not len(self.automaton):
            return None
        own, count, best = len(word), 0, None
        for end, size in self.automaton.iter(word):
            at_start, at_end = end == size - 1, end == own - 1
            for length in range(max(own - 1, SHORTEST), own + 2) if at_start or at_end else ():
                half = length // 2
                kinds = ([0, 1] if at_start and half == size else []) + ([2, 3] if at_end and length - half == size else [])
                keys = _halves(word, length) if kinds else ()
                for kind in kinds:
                    for other, n in self.held.get(keys[kind], ()):
                        if one_apart(word, other) and not any(keys[k] == _halves(other, length)[k] for k in range(kind)):
                            count += 1
                            if best is None or (-n, other) < best:
                                best = (-n, other)
        return (count, -best[0], best[1]) if best else None


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """word, n -> word, n_near, form_n, form for each word with a near one: form is the near word of largest n (ties: the smallest)."""
    spark = words.sparkSession
    shards = max(partitions(spark), -(-4 * words.count() // shard))
    kinds = [F.struct(F.lit(k).cast("int").alias("kind"), x.alias("key")) for k, x in enumerate(_keys(F.col("word"), F.length("word")))]
    patterns = words.select("word", "n", F.explode(F.array(*kinds)).alias("k")).select("word", "n", "k.*")
    hot = patterns.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > block)
    hot = stash(hot.select("key", F.ceil(F.col("held") / block).cast("int").alias("parts")), "hot")
    lengths = [F.greatest(F.length("word") + d, F.lit(SHORTEST)) for d in (-1, 0, 1)]
    asked = F.array_distinct(F.array(*[k for length in lengths for k in _keys(F.col("word"), length)]))
    place = lambda key: F.pmod(key, F.lit(shards)).cast("int")
    split = lambda part: (shards + F.pmod(F.xxhash64("key", part), F.lit(shards))).cast("int")
    told = patterns.join(hot, "key", "left")
    shard_of = F.when(F.col("parts").isNull(), place(F.col("key"))).otherwise(split(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    held = told.select(shard_of.alias("shard"), "kind", "word", "n")
    none = F.lit(None).cast("long").alias("n")
    scans = words.select(F.explode(F.array_distinct(F.transform(asked, place))).alias("shard"), F.lit(9).alias("kind"), "word", none)
    again = words.select("word", F.explode(asked).alias("key")).join(hot, "key").select("word", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    again = again.select(split(F.col("part")).alias("shard"), F.lit(9).alias("kind"), "word", none).distinct()
    dealt = held.unionByName(scans).unionByName(again).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, closed = None, Shard(), False
        for batch in batches:
            out: list[tuple] = []
            for at, kind, word, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if at != now:
                    now, own, closed = at, Shard(), False
                if kind != 9:
                    own.add(word, n, kind)
                    continue
                if not closed:
                    own.close()
                    closed = True
                if found := own.scan(word):
                    out.append((word, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])

    found = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form (each form at least twice as frequent) -> word, root: the last form, by doubling steps."""
    now = stash(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stash(now.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def group_variants(docs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents' texts.

    Words are runs of letters (A-Z lower-cased; one run of EVERY, told by the
    crc32 of doc_id and run, has a code point left out) of at least SHORTEST
    code points and LEAST occurrences. Near words differ by exactly one code
    point inserted, deleted or replaced. The form is the near word of largest n
    (ties: the smallest) if that is at least twice the word's n, else null; the
    root follows forms to the last. Null and empty texts have no words; a null
    doc_id counts as ''; repeated rows and doc_ids count again; other columns
    do nothing; no words give no rows.
    """
    words = stash(count_words(docs), "words")
    near = near_words(words, shard, block)
    told = stash(words.join(near.withColumnRenamed("form_n", "most"), "word", "left").withColumn("twice", F.coalesce(F.col("most") >= 2 * F.col("n"), F.lit(False))), "near")
    ends = roots(told.where("twice").select("word", "form"))
    form = [F.when(F.col("twice"), F.col(c)).alias(to) for c, to in (("form", "form"), ("most", "form_n"))]
    return told.join(ends, "word", "left").select("word", form[0], F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form[1])
