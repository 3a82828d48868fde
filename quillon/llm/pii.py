"""Personal data: fixed patterns, then contexts that they teach, scored over the corpus.

Every text is cut by each pattern in its own row: positions are sums of the
lengths of what lies between. Things that look like identifiers (items) keep the
words about them; items that a fixed pattern takes are the seeds. A context (one
or two words before, one word after) is believed as far as known items follow
it: hits over all its occurrences in the corpus, whatever stands there. An item
is believed as far as its contexts are (noisy or). Contexts and items score each
other in turn until no item is new; items that pass are personal data of their
contexts' kind.

Only DataFrame functions run here. Quantifiers are possessive and matches start
only where a run of their letters starts, so no text makes them slow or deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stash

KINDS = ["email", "ip", "card", "phone"]
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The contract's patterns in forms that find the same spans: runs start at \\G (the end of the last match) or after another letter.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifiers of any kind: addresses (also with a written "at"), numbers of six digits or more, words with four digits or more.
AT, DOT = (rf"(?:[{c}]|\x20?[(\[]\x20?{w}\x20?[)\]]\x20?)" for c, w in (("@", "at"), (".", "dot")))
ITEM = (
    rf"(?<![A-Za-z0-9._%+@-])(?:[{LOCAL}]++{AT}[{LABEL}]++(?:{DOT}[{LABEL}]++)*+"
    r"|\+[0-9][\x20().0-9-]+[0-9]|\(?[0-9](?:[\x20.()-]{0,2}[0-9]){5,}+|(?=(?:[A-Za-z]*+[0-9]){4})[A-Za-z0-9]{6,}+)"
)
MAYBE = "[0-9@]|[(\\[]\\x20?at\\x20?[)\\]]"
#: Distinct known items that a context needs, its least confidence, and the least belief in an item.
SUPPORT, CONFIDENT, ACCEPTED, ROUNDS = 3, 0.7, 0.9, 6
#: Terms of contexts that are broadcast at most (some 100 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 400_000
STEP = 256
SPAN = "struct<kind:int,start:long,end:long,said:string,before:string,after:string>"
HELD = "￼"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches in order, as SPAN: code points, end exclusive, with the text before (up to the last match) and after.

    Sums run over blocks of STEP matches first, so lists grow by blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    size = lambda x: (F.length(x["gap"]) + F.length(x["said"])).cast("long")
    start = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def grow(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        made = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(x["said"])).alias("end"), x["said"].alias("said"), F.right(x["gap"], F.lit(100)).alias("before"), F.substring(x["next"], 1, 60).alias("after"))
        return F.struct((s["at"] + size(x)).alias("at"), F.concat(s["out"], F.array(made)).alias("out"))

    def block(blocks: Column) -> Column:
        begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        onward = lambda s, b: F.struct((s["at"] + F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + size(x))).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        at = F.aggregate(blocks, begun, onward, lambda s: s["out"])
        both = F.arrays_zip(at.alias("at"), blocks.alias("b"))
        return F.flatten(F.transform(both, lambda x: F.aggregate(x["b"], start(x["at"]), grow, lambda s: s["out"])))

    def laid(said: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        zipped = let(gaps, lambda g: F.arrays_zip(g.alias("gap"), said.alias("said"), F.slice(g, F.lit(2), F.size(g)).alias("next")))
        cut = let(zipped, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(said) - 1) / STEP).cast("int")), lambda k: F.slice(F.slice(z, F.lit(1), F.size(said)), k * STEP + 1, F.lit(STEP))))
        return let(cut, block)

    return F.coalesce(let(found, lambda m: F.when(F.size(m) > 0, laid(m))), none)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(said: Column) -> Column:
    """The digits pass the Luhn check."""
    def total(d: Column) -> Column:
        twice = lambda k: F.substring(d, k, F.lit(1)).cast("int") * (2 - k % 2)
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), twice), F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))

    return let(F.reverse(digits(said)), total) % 10 == 0


def is_kind(said: Column, kind: str) -> Column:
    """A match of the kind's pattern is personal data."""
    if kind == "ip":
        return F.forall(F.split(said, r"\."), lambda p: F.regexp_extract(p, "^0*([0-9]{1,3})$", 1).try_cast("int") <= 255)
    if kind == "card":
        return F.length(digits(said)).between(13, 19) & luhn(said)
    if kind == "phone":
        return F.length(digits(said)).between(9, 15)
    return F.lit(True)


def kept(spans: Column, kind: str) -> Column:
    """The spans that are of the kind."""
    return F.filter(spans, lambda x: F.coalesce(is_kind(x["said"], kind), F.lit(False)))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind as listed, then start."""
    there = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for k, kind in enumerate(KINDS):
        held = kept(located(text, BASE[kind], k), kind)
        parts.append(F.when(F.contains(text, F.lit(there[kind])), held).otherwise(none) if there[kind] else held)
    return F.concat(*parts)


def _seed(said: Column) -> Column:
    """The kind of an item that a fixed pattern takes whole, else null."""
    whole = [F.when(F.regexp_extract(said, rf"^(?:{BASE[kind]})$", 0) != "", F.when(is_kind(said, kind), F.lit(k))) for k, kind in enumerate(KINDS)]
    return F.coalesce(*whole)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (rows with equal keys have equal doc_ids and texts), base, items; stored in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))
    items = F.when(F.col("text").rlike(MAYBE), located(F.col("text"), ITEM, -1)).otherwise(F.array().cast(f"array<{SPAN}>"))
    lower = lambda x: F.lower(x)
    told = F.transform(items, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), lower(x["said"]).alias("item"), _seed(x["said"]).alias("seed"),
        lower(F.regexp_extract(x["before"], r"(\S+)\s*$", 1)).alias("l1"),
        lower(F.regexp_replace(F.regexp_extract(x["before"], r"(\S+\s+\S+)\s*$", 1), r"\s+", " ")).alias("l2"),
        lower(F.regexp_extract(x["after"], r"^\s*(\S+)", 1)).alias("r1")))
    base = F.transform(base_spans(F.col("text")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return stash(rows.select("doc_id", own["k1"].alias("k1"), own["k2"].alias("k2"), base.alias("base"), told.alias("items")), "marks")


def contexts(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, start, end, item, seed, context) of each item and context, and (context, item, seed, n) of each pair."""
    each = marks.select("k1", "k2", F.explode("items").alias("i")).select("k1", "k2", "i.*").distinct()
    named = [F.when(F.col(c) != "", F.concat(F.lit(c[0] + " "), F.col(c))) for c in ("l1", "l2", "r1")]
    places = each.select("k1", "k2", "start", "end", "item", "seed", F.explode(F.array_compact(F.array(*named))).alias("context"))
    places = stash(places, "places")
    # An item may stand in two forms of letters; a seed in any is one.
    pairs = places.groupBy("context", "item").agg(F.count("*").alias("n"), F.min("seed").alias("seed"))
    return places, stash(pairs, "pairs")


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, total of the terms in wanted: how often a word, or two in a row, stand in the texts outside items."""
    text = F.lower(F.col("text").cast("string"))
    bare = F.when(text.rlike(MAYBE), F.lower(F.regexp_replace(F.col("text").cast("string"), ITEM, f" {HELD} "))).otherwise(text)
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    two = F.transform(F.arrays_zip(F.col("w"), F.slice("w", F.lit(2), F.size("w")).alias("x")), lambda p: F.concat_ws(" ", p["w"], p["x"]))
    terms = docs.select(words.alias("w")).select(F.explode(F.concat("w", F.slice(two, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        return terms.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("total"))
    return terms.groupBy("term").agg(F.count("*").alias("total")).join(wanted, "term")


def bootstrap(pairs: DataFrame, totals: DataFrame, support: int, confident: float, accepted: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(item, kind, belief) of what is found, and (context, kind, confidence) of the contexts that found it.

    pairs: context, item, seed, n; totals: context, total. A context's confidence for a kind is the belief in the
    items it holds, weighted by occurrences, over its occurrences and one more.
    """
    graph = stash(pairs.join(totals, "context"), "graph")
    seeds = stash(graph.where("seed is not null").select("item", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct(), "seeds")
    known, had = seeds, -1
    for _ in range(rounds):
        met = graph.select("context", "item", "n", "total").join(known, "item")
        scored = met.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("hits"), F.sum("belief").alias("held"), F.max("total").alias("total"))
        scored = scored.where(F.col("held") >= support).select("context", "kind", F.least(F.col("hits") / (F.col("total") + 1), F.lit(0.999)).alias("confidence"))
        believed = stash(scored.where(F.col("confidence") >= confident), "contexts")
        doubt = graph.where("seed is null").select("context", "item").join(believed, "context")
        doubt = doubt.groupBy("item", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("belief"))
        best = doubt.where(F.col("belief") >= accepted).groupBy("item").agg(F.max(F.struct("belief", (-F.col("kind")).alias("kind"))).alias("b"))
        found = stash(best.select("item", (-F.col("b.kind")).alias("kind"), F.col("b.belief").alias("belief")), "found")
        now = found.count()
        if now == had:
            break
        known, had = seeds.unionByName(found), now
    return found, believed


def _equals(k: int) -> Callable[[Column], Column]:
    return lambda x: x == k


def find_personal_data(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, accepted: float = ACCEPTED, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context.

    The counts and base_sha256 (of kind:start:end by kind, then start, joined
    by commas) are of the fixed patterns. spans has these and the n_context
    ones that contexts found, which overlap none of them, in the same order.
    Null and empty texts have none; null doc_ids stay null; repeated rows and
    doc_ids are judged one by one but teach once where doc_id and text are the
    same; other columns are left out; no rows give no rows.
    """
    marks = scan(docs)
    places, pairs = contexts(marks)
    # Contexts with too few items can never count; the others' words are looked for once.
    wanted = stash(pairs.groupBy("context").agg(F.count("*").alias("items")).where(F.col("items") >= support).select("context", F.expr("substring(context, 3)").alias("term")), "wanted")
    totals = stash(occurrences(docs, wanted.select("term").distinct()), "totals")
    found, believed = bootstrap(pairs, wanted.join(totals, "term").select("context", "total"), support, confident, accepted, rounds)
    taken = places.where("seed is null").join(found.select("item", "kind"), "item").join(believed.select("context", "kind"), ["context", "kind"])
    added = taken.select("k1", "k2", "kind", "start", "end").distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    told = marks.drop("items").join(added, ["k1", "k2"], "left")
    apart = F.filter("added", lambda x: ~F.exists(F.col("base"), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    told = told.withColumn("added", F.coalesce(apart, F.array().cast("array<struct<kind:int,start:long,end:long>>")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    counts = [F.size(F.filter(F.transform("base", lambda x: x["kind"]), _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return told.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_context"))
