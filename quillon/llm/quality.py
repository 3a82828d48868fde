"""Quality classifier: interpolated modified Kneser-Ney models of characters, one for each language, trained on trusted text.

A text is its characters as they are, but that all digits are one and runs of
white space one space, with marks for its start and end. Half of the trusted documents train; the other
half, unseen by the models, sets each language's limit. A model for all
languages together is mixed into each (MIX), so that a foreign word or name is
no gibberish. Nothing is held whole anywhere; counts grow with the corpus:

1. A scan gives the distinct n-grams of each group of partitions, with their
   counts in training documents.
2. Count tables are joined by (language, n-gram) and (language, context), order
   by order: counts, continuation counts, context totals, discounts, and so the
   probability of every n-gram that some document has.
3. A second scan posts each n-gram's documents and how often each has it, in
   small compressed lists. They meet the probabilities in a join by group and
   share of the n-grams, which gives partial sums for each document.
4. A document's perplexity is held against a quantile of the held-out trusted
   documents of its language.

Short texts are drawn to their language's median: PRIOR symbols at that cost
are added to each, in the held-out documents too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import carried, stash

ORDER = 4
START, END = "\x02", "\x03"
#: Weight of the model of all languages together; its name among them.
MIX, ALL = 0.5, "*"
#: Trusted documents are flagged in the scan by at most so many blocks of 64 ids each, broadcast; where there are more, by a shuffle.
BROADCAST = 1_000_000
#: Rejected: costlier a symbol than this share of the held-out trusted documents of the language.
QUANTILE = 0.998
#: A document's mean counts this many more symbols at the language's median.
PRIOR = 60
#: Languages with fewer trusted documents (of either half) use those of all languages together.
FEWEST = 20
#: Characters that are counted at once, input partitions whose n-grams meet in one group, shares of the n-grams.
CHUNK, GROUP, SHARES = 1_500_000, 8, 8
#: Rows read from a batch at once, n-grams written at once.
ROWS, WRITTEN = 256, 1 << 16
#: What an n-gram's code points are multiplied by to find its share.
WEIGHTS = (1, 7, 31, 131)


def _marked(text: str | None) -> str:
    return START * (ORDER - 1) + " ".join((text or "").split()) + END


def symbols(text: str | None) -> str:
    """A text as the models see it."""
    return re.sub("[1-9]", "0", _marked(text))


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text number, code) of every n-gram of the texts, and what ``_points`` reads codes by."""
    marked = [_marked(t) for t in texts]
    sizes = np.array([len(x) for x in marked])
    cp = np.frombuffer(bytearray("".join(marked), "utf-32-le"), "<u4")
    del marked
    cp[(cp >= 49) & (cp <= 57)] = 48
    found = np.zeros(0x110000, bool)
    found[cp] = True
    names, number = np.flatnonzero(found).astype("<u4"), np.zeros(0x110000, "i4")
    number[names] = np.arange(len(names))
    own, base, starts = number[cp], len(names), np.ones(len(cp), bool)
    del found, number
    last = np.cumsum(sizes)
    for k in range(1, ORDER):
        starts[last - k] = False
    at = np.repeat(np.arange(len(texts), dtype="i4"), sizes - ORDER + 1)
    if base**ORDER * len(texts) < 1 << 62:
        del cp
        code = own[: len(own) - ORDER + 1].astype("i8")
        for k in range(1, ORDER):  # in place: these arrays are what a worker's memory goes to
            code *= base
            code += own[k : len(own) - ORDER + 1 + k]
        del own
        return at, code[starts[: len(code)]], names, base
    start = np.flatnonzero(starts)
    code = own[start].astype("i8")
    for k in range(1, ORDER):  # very many symbols: shorter grams are numbered before they grow
        _, first, code = np.unique(code * base + own[start + k], return_index=True, return_inverse=True)
    return at, code, np.stack([cp[start[first] + k] for k in range(ORDER)], axis=1), 0


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of the sorted values are unlike the one before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _runs(code: np.ndarray, base: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct code * base + least, sorted; how often each is there); code is used up."""
    code *= base
    code += least
    code.sort()
    first = np.flatnonzero(_firsts(code))
    return code[first], np.diff(first, append=len(code)).astype("i4")


def _points(code: np.ndarray, names: np.ndarray, base: int) -> np.ndarray:
    """The code points of n-grams, a row each."""
    return np.stack([names[code // base**k % base] for k in range(ORDER - 1, -1, -1)], axis=1) if base else names[code]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[str], list[int]]]:
    """(group, language, texts, a number of each) of at most about CHUNK characters; columns: group, lang, text, number."""
    held: dict[tuple[int, str], tuple[list[str], list[int]]] = {}
    size: dict[tuple[int, str], int] = {}
    for batch in batches:
        parts = (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS))
        for group, lang, text, number in (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns))):
            texts, numbers = held.setdefault((group, lang), ([], []))
            texts.append(text)
            numbers.append(number)
            size[group, lang] = size.get((group, lang), 0) + len(text or "") + ORDER
            if size[group, lang] >= CHUNK:
                yield group, lang, *held.pop((group, lang))
                size.pop((group, lang))
    for (group, lang), (texts, numbers) in held.items():
        yield group, lang, texts, numbers


def _seen(rows: DataFrame) -> DataFrame:
    """group, lang, text, fits (1: a training document) -> group, lang, gram, n: the n-grams of each group, counted in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, lang, texts, fits in _chunks(batches):
            at, code, names, base = _windows(texts)
            own = np.array(fits, "i1")[at]
            del at, texts
            key, count = _runs(code, 2, own)
            del code, own
            first = np.flatnonzero(_firsts(key >> 1))
            n = np.add.reduceat(count * (key & 1), first) if len(first) else count
            grams = key[first] >> 1
            del key, count, first
            for low in range(0, len(n), WRITTEN):
                part = n[low : low + WRITTEN].astype("i8")
                text = _points(grams[low : low + WRITTEN], names, base).astype("<u4").tobytes().decode("utf-32-le")
                strings = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), group, "i4")), pa.array([lang] * len(part)), pa.array(strings), pa.array(part)], ["group", "lang", "gram", "n"])

    return rows.select("group", "lang", "text", "fits").mapInArrow(run, "group int, lang string, gram string, n long").groupBy("group", "lang", "gram").agg(F.sum("n").alias("n"))


def _discounted(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts."""
    many = counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y, some = F.col("n1") / (F.col("n1") + 2 * F.col("n2")), (F.col("n1") > 0) & (F.col("n2") > 0)
    raw = [1 - 2 * y * F.col("n2") / F.col("n1"), 2 - 3 * y * F.col("n3") / F.col("n2"), F.when(F.col("n3") > 0, 3 - 4 * y * F.col("n4") / F.nullif(F.col("n3"), F.lit(0.0))).otherwise(1.5)]
    held = [F.when(some, F.least(F.greatest(d, F.lit(0.05)), F.lit(k + 0.95))).otherwise(0.5) for k, d in enumerate(raw)]
    return many.select("lang", *[d.alias(f"d{k + 1}") for k, d in enumerate(held)])


def train(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """counts: lang, gram, n in training text; asked: distinct lang, gram -> lang, gram, p: probability of the last symbol after the others."""
    orders = [stash(counts.where("n > 0").select("lang", "gram", "n"), "order")]
    for _ in range(ORDER - 1):  # a lower order counts the distinct symbols before each shorter gram
        shorter = F.expr("substring(gram, 2)").alias("gram")
        orders.append(stash(orders[-1].groupBy("lang", shorter).agg(F.count("*").alias("n")), "order"))
    known = orders[-1].select("gram").distinct().count()
    out = asked.select("lang", "gram", F.lit(1.0 / (known + 100)).alias("p"))
    for k in range(1, ORDER + 1):
        own = orders[ORDER - k]
        own = own.join(F.broadcast(_discounts(own)), "lang")  # a row for each language
        own = own.select("lang", F.col("gram").alias("short"), "n", _discounted(F.col("n")).alias("d"))
        stats = own.groupBy("lang", F.expr(f"left(short, {k - 1})").alias("context")).agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        stats = F.broadcast(stats) if k == 1 else stats  # without a context: a row for each language
        keyed = out.withColumn("short", F.expr(f"right(gram, {k})")).withColumn("context", F.expr(f"left(short, {k - 1})"))
        met = keyed.join(own, ["lang", "short"], "left").join(stats, ["lang", "context"], "left")
        seen = F.greatest(F.coalesce(F.col("n") - F.col("d"), F.lit(0.0)), F.lit(0.0)) / F.col("total") + F.col("freed") / F.col("total") * F.col("p")
        out = met.select("lang", "gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen).alias("p"))
    return out


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: 255 stands for 255 more."""
    long = values // 255
    out = np.full(int(long.sum()) + len(values), 255, "u1")
    out[np.cumsum(long + 1) - 1] = values % 255
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    got = np.frombuffer(raw, "u1").astype("i8")
    ends = np.flatnonzero(got < 255)
    return np.add.reduceat(got, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else got


def _share(points: np.ndarray) -> np.ndarray:
    """Which of SHARES an n-gram is in; ``_share_of`` says the same of a string."""
    return (sum(points[:, k].astype("i8") * w for k, w in enumerate(WEIGHTS)) % SHARES).astype("u1")


def _share_of(gram: Column) -> Column:
    return F.pmod(sum((F.ascii(F.substring(gram, k + 1, 1)) * w for k, w in enumerate(WEIGHTS)), F.lit(0)), F.lit(SHARES))


POSTED = "group int, share int, lang string, keys binary, names binary, grams binary, sizes binary, near binary, times binary"


def _kind(n: int) -> str:
    return "u1" if n <= 1 << 8 else "<u2" if n <= 1 << 16 else "<u4"


def _posted(rows: DataFrame) -> DataFrame:
    """group, lang, text, key -> POSTED: a chunk's n-grams of one share with the documents that have them.

    keys: the chunk's document keys; names: the code points of the share. For
    each n-gram: the numbers of its code points (all first ones, then all second
    ones: sorted, they compress), how many documents; for each of these its
    distance from the one before, twice, and one more where it has the n-gram
    several times; and then how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, lang, texts, keys in _chunks(batches):
            at, code, names, base = _windows(texts)
            many = len(texts)
            del texts
            key, count = _runs(code, many, at)
            del code, at
            code = key // many
            key -= code * many
            doc = key.astype("i4")
            del key
            start = np.flatnonzero(_firsts(code))
            size = np.diff(start, append=len(code))
            points = _points(code[start], names, base).astype("<u4")
            del code
            share, gap = _share(points), np.diff(doc, prepend=np.int32(0))
            gap[start] = doc[start]
            del doc, start
            share_of = np.repeat(share, size)
            named = np.array(keys, "<i8").tobytes()
            out = []
            for s in range(SHARES):
                mine, some = share == s, share_of == s
                n, (own, number) = count[some], np.unique(points[mine], return_inverse=True)
                number = number.reshape(-1, ORDER).T.astype(_kind(len(own)))
                out.append((group, s, lang, named, own.tobytes(), number.tobytes(), pack(size[mine]), pack(gap[some] * 2 + (n > 1)), pack(n[n > 1])))
            kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in POSTED.split(", ")])

    return rows.select("group", "lang", "text", "key").mapInArrow(run, POSTED)


def _sums(posted: pa.Table, known: pa.Table) -> pa.Table:
    """Partial sums of one group and share: key, total (log probability), n, times (occurrences of the document, said in share 0)."""
    lang, gram = known["lang"].to_pylist(), known["gram"].to_pylist()
    lp = known["lp"].to_numpy().astype("f8")
    tables: dict[str, list[int]] = {}
    for k, x in enumerate(lang):
        tables.setdefault(x, []).append(k)
    sorted_of = {}
    for x, rows in tables.items():
        raw = np.frombuffer("".join(gram[k] for k in rows).encode("utf-32-le"), f"S{4 * ORDER}")
        order = np.argsort(raw, kind="stable")
        sorted_of[x] = raw[order], lp[rows][order]
    out: list[tuple[np.ndarray, ...]] = []
    for r in (r for batch in posted.to_batches(max_chunksize=1) for r in batch.to_pylist()):  # one at a time: copies of all would be as large as the group
        keys = np.frombuffer(r["keys"], "<i8")
        total, n = np.zeros(len(keys)), np.zeros(len(keys), "i8")
        if r["grams"]:
            names, values = sorted_of[r["lang"]]
            points = np.frombuffer(r["names"], "<u4")
            grams = points[np.frombuffer(r["grams"], _kind(len(points))).reshape(ORDER, -1).T]
            own = values[np.searchsorted(names, np.ascontiguousarray(grams).view(f"S{4 * ORDER}").reshape(-1))]
            size, near = unpack(r["sizes"]), unpack(r["near"])
            start = np.cumsum(size) - size
            far = np.cumsum(near // 2)
            doc = far - np.repeat(far[start] - near[start] // 2, size)
            count = np.ones(len(doc), "i8")
            count[near % 2 == 1] = unpack(r["times"])
            total += np.bincount(doc, np.repeat(own, size) * count, len(keys))
            n += np.bincount(doc, count, len(keys)).astype("i8")
        out.append((keys, total, n, np.full(len(keys), int(r["share"] == 0))))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "total", "n", "times"]) if out else pa.table({"key": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all labelled rows with quality 1 and toxic 0."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return good.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id")


def _flagged(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """(rows, which have a doc_id, with trusted; whether a shuffle may have dealt them)."""
    bit = F.expr("cast(cast(doc_id as long) & 63 as int)")
    block = F.expr("shiftright(cast(doc_id as long), 6)").alias("_block")
    blocks = trusted_ids(labels).groupBy(block).agg(F.bit_or(F.expr("shiftleft(1L, cast(cast(doc_id as long) & 63 as int))")).alias("_mask"))
    blocks = stash(blocks, "trusted")
    far = blocks.count() > BROADCAST
    met = rows.withColumns({"_block": block, "_bit": bit}).join(blocks if far else F.broadcast(blocks), "_block", "left")
    return met.withColumn("trusted", F.coalesce(F.getbit("_mask", "_bit") == 1, F.lit(False))).drop("_block", "_bit", "_mask"), far


def held_out(doc_id: Column) -> Column:
    """Half of the documents, by a hash."""
    return F.pmod(F.xxhash64(F.lit("held out"), doc_id), F.lit(2)) == 1


def known_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang (null: empty), text (null: empty), trusted, fits (1: trains), key (of language and text), group."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, far = _flagged(rows, labels)
    rows = stash(rows, "rows") if far else rows  # all scans must see the same partitions
    fits = (F.col("trusted") & ~held_out(F.col("doc_id"))).cast("int")
    group = F.floor(F.spark_partition_id() / GROUP).cast("int")
    return rows.withColumns({"fits": fits, "key": F.xxhash64("lang", "text"), "group": group})


def probabilities(seen: DataFrame, known: DataFrame) -> DataFrame:
    """seen: stored group, lang, gram, n; known: languages with a model of their own -> group, share, lang, gram, lp."""
    own = seen.join(known, "lang")
    counts = own.groupBy("lang", "gram").agg(F.sum("n").alias("n")).unionByName(seen.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL)))
    asked = own.select("lang", "gram").distinct().unionByName(seen.select("gram").distinct().withColumn("lang", F.lit(ALL)))
    # One table with a row for each n-gram and language, so that the two scans need not agree on anything else.
    p = stash(train(stash(counts, "counts"), asked), "probabilities")
    every = p.where(F.col("lang") == ALL).select("gram", F.col("p").alias("p_all"))
    mine = p.where(F.col("lang") != ALL).select("lang", "gram", F.col("p").alias("p_own"))
    met = seen.select("group", "lang", "gram").join(every, "gram").join(mine, ["lang", "gram"], "left")
    mixed = F.when(F.col("p_own").isNull(), F.col("p_all")).otherwise((1 - MIX) * F.col("p_own") + MIX * F.col("p_all"))
    return met.select("group", _share_of(F.col("gram")).alias("share"), "lang", "gram", F.log(mixed).cast("float").alias("lp"))


def score(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known_rows of docs, stored scores: key, n_symbols, log_likelihood in natural logarithms of the whole text and its end)."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() or not docs.inputFiles():
        docs = stash(docs.select("doc_id", "lang", "text"), "documents")  # both scans must see the same partitions
    rows = known_rows(docs, labels)
    seen = stash(_seen(rows), "seen")
    trained = rows.where("trusted").groupBy("lang").agg(F.sum("fits").alias("fit"), F.sum(1 - F.col("fits")).alias("held"))
    known = stash(trained.where((F.least("fit", "held") >= FEWEST) & (F.col("lang") != "")).select("lang"), "languages")
    met = probabilities(seen, known)
    sums = _posted(rows).groupBy("group", "share").cogroup(met.groupBy("group", "share")).applyInArrow(_sums, "key long, total double, n long, times long")
    sums = sums.groupBy("key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("times").alias("times"))
    return rows, stash(sums.select("key", (F.col("n") / F.col("times")).cast("long").alias("n_symbols"), (F.col("total") / F.col("times")).alias("log_likelihood")), "scores")


def judge(rows: DataFrame, scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """key, n_symbols, log_likelihood, cost, limit, kept: one row for each language and text, stored."""
    raw = -F.col("log_likelihood") / F.col("n_symbols")
    held = rows.where(F.col("trusted") & (F.col("fits") == 0)).select("lang", "key")
    held = stash(held.join(scores, "key"), "held")
    at = lambda x, q, name: F.percentile_approx(x, q, 100_000).alias(name)
    middle = held.agg(at(raw, 0.5, "mid")).first()["mid"]
    langs = held.groupBy("lang").agg(at(raw, 0.5, "mid"), F.count("*").alias("docs")).where((F.col("docs") >= FEWEST) & (F.col("lang") != "")).select("lang", "mid")
    middles = stash(langs, "middles")
    base = F.coalesce("mid", F.lit(0.0 if middle is None else middle))
    cost = ((-F.col("log_likelihood") + PRIOR * base) / (F.col("n_symbols") + PRIOR)).alias("cost")
    costs = held.join(middles, "lang", "left").select("lang", "mid", cost)
    limit = costs.agg(at(F.col("cost"), quantile, "limit")).first()["limit"]
    limits = costs.where("mid is not null").groupBy("lang").agg(F.first("mid").alias("mid"), at(F.col("cost"), quantile, "limit"))
    limits = stash(limits, "limits")  # a row for each language
    keyed = stash(rows.select("key", "lang").distinct(), "keys")
    judged = keyed.join(scores, "key").join(limits, "lang", "left").select("key", "n_symbols", "log_likelihood", cost, F.coalesce("limit", F.lit(float("inf") if limit is None else limit)).alias("limit"))
    return stash(judged.withColumn("kept", F.col("cost") <= F.col("limit")), "judged")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, trusted, n_symbols, perplexity, score, threshold, kept for each row of docs (doc_id, text, lang).

    score is the perplexity with PRIOR symbols more at the language's median;
    a row is kept where it is at most the threshold. Every row gets a verdict.
    Null texts are empty: one symbol, the end. A null, empty or rare language
    is held against the trusted documents of all languages; without any held-out
    trusted document everything is kept. Repeated rows and texts get one score;
    a label of a repeated id counts with its worst values. No rows give none.
    """
    rows, scores = score(docs, labels)
    judged = judge(rows, scores, quantile)
    perplexity = F.exp(-F.col("log_likelihood") / F.col("n_symbols")).alias("perplexity")
    named = docs.select("doc_id", F.col("lang").alias("said"), F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    flagged, _ = _flagged(named, labels)
    out = flagged.join(judged, "key")
    return out.select("doc_id", F.col("said").alias("lang"), "trusted", "n_symbols", perplexity, F.exp("cost").alias("score"), F.exp("limit").alias("threshold"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that classify keeps, with docs' columns; the texts are dealt once, to meet their verdicts."""
    rows, scores = score(docs, labels)
    good = judge(rows, scores, quantile).where("kept").select("key")
    key = F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(carried(docs), key.alias("key")).join(good, "key", "left_semi").select("own.*")
