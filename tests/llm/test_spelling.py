import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(w):
    """A word with one place open: two words are one replacement apart if they share one."""
    return {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))}


def shorter(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    open_, less = {}, {}
    for w in n:
        for e in edits(w):
            open_.setdefault(e, set()).add(w)
        for s in shorter(w):
            less.setdefault(s, set()).add(w)
    near = {w: (set().union(*(open_[e] for e in edits(w))) | {s for s in shorter(w) if s in n} | less.get(w, set())) - {w} for w in n}
    form = {}
    for w, c in n.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * c:
                form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(spelling.group_variants(docs)) == plain(map(tuple, docs.collect()))


def words(seed):
    """Frequent words, their misspellings, words of few letters, and one stem that a third of all words start with."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    pool += ["stemstem" + "".join(rng.choice("xy") for _ in range(rng.randrange(0, 8))) for _ in range(200)]
    rows = []
    for d in range(60):
        said = [rng.choice(pool[: rng.choice((20, 100, 500))]) for _ in range(200)]
        said = [w if rng.random() < 0.8 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "z", w[k] + "q"]) + w[k + 1 :] for w in said]
        rows.append((d, " ".join(said).replace("é", rng.choice("éÉ"))))
    return rows


@pytest.mark.parametrize("shard, block", [(40_000, 2_000), (300, 7), (50, 1)])
def test_near_words_split_over_shards(spark, shard, block):
    rows = words(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert got(spelling.group_variants(docs, shard, block)) == want
    assert sum(r[4] for r in want) > 1000 and any(r[1] and r[1] != r[2] for r in want)


def test_keys_are_the_halves(spark):
    held = spark.createDataFrame([(w, length) for w in ("abcde", "xbcde", "abcdefghé", "zzzzzzz") for length in range(max(5, len(w) - 1), len(w) + 2)], "word string, length int")
    made = held.select("word", "length", F.array(*spelling._keys(F.col("word"), F.col("length"))).alias("k"))
    plain_keys = spark.createDataFrame([(w, n, *k) for w, n in map(tuple, held.collect()) for k in spelling._halves(w, n)], "word string, length int, kind int, l int, half string, quarter string")
    hashed = plain_keys.groupBy("word", "length").agg(F.array_sort(F.collect_list(F.xxhash64("kind", "l", "half", "quarter"))).alias("p"))
    assert made.join(hashed, ["word", "length"]).where(F.array_sort("k") != F.col("p")).count() == 0


def test_one_apart():
    assert spelling.one_apart("abcde", "abde") and spelling.one_apart("abde", "abcde") and spelling.one_apart("abcde", "abxde")
    assert not any(spelling.one_apart(*p) for p in (("abcde", "abcde"), ("abcde", "acbde"), ("abcde", "abc"), ("abcde", "bcdef")))


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w37"}


def test_odd_tables(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "Straße straße STRASSE colour"), (None, None), (1, ""), (2, "colour color " * 5), (2, "colour color " * 5), (3, "wörter×wörter÷ " + "a" * 100_000), (4, "12 _ 😀"), (5, ("lang" * 30 + " ") * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.group_variants(docs.withColumns({c: F.lit(1) for c in ("word", "n", "run", "d", "h", "shard", "kind", "form", "key")}))) == plain(rows)
