"""Soft-membership mixing: domain posteriors, then document rates that meet target token totals.

A classifier fitted on the labelled table gives every document a posterior over
domains. Nonnegative rates then minimise the squared distance between each
domain's expected tokens and its target, by projected gradient steps. A step's
gradient is one number for each domain, summed over the documents, so only
those sums reach the driver; a document's rate follows from its posterior and
the history of the sums, without a shuffle.

Only DataFrame functions run here. Words are matched by a perfect hash table in
literal arrays, so documents are classified in their scan.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import carried, stash

#: The labels that a classifier is fitted on are all, or a share by hash so that about so many are left.
TRAINING_ROWS = 20_000
#: Words that tell domains apart, the least slots of the table that holds them, and the documents a word must be in.
VOCABULARY, SLOTS, FEWEST = 256, 1 << 12, 4
#: What a mark must tell, in nats, beyond the logarithm of how many marks there are: few tell so much by chance.
#: Marks of toxic text are few and rare, so less will do.
SURE, SURE_TOXIC = 2.0, -2.0
#: What stands between words.
MARKS = r"[\x00-/:-@\[-`{-~]+"
#: Most gradient steps, and the distance from each target, relative to itself, that is near enough.
STEPS, NEAR = 60, 1e-4
#: Weight of a dual's own size against the domains' overlap.
RIDGE = 1e-6
DOMAINS = ("clean", "junk", "toxic")
#: Of what a domain has, where nothing else is asked for.
SHARES = {"clean": 1.0, "junk": 0.05, "toxic": 0.05}
CAPITALS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!%$#&*|"
#: A run of what is neither.
PLAIN = f"[^{CAPITALS}{SYMBOLS}]+"
SHAPES = 27
#: Most languages with weights of their own (the model is a literal; the others use the shared weights); the pseudo-count of a mark.
LANGUAGES, PSEUDO = 64, 0.3
#: A word's first letters tell too: inflected and compound forms of one stem are too rare to be learned one by one.
STEMS = (4, 6)


def domain_of(quality: Column, toxic: Column) -> Column:
    """toxic before junk before clean; null where no label says."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "junk").when(quality == 1, "clean")


def described(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (pieces between spaces), _words (distinct, lower-case) and _shape.

    The shape is a coarse class of a text's looks: the shares of capitals, of
    symbols and of distinct words, each in three steps. Null texts are empty,
    with no token.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.length(t)
    out = docs.withColumns(
        {
            "n_tokens": F.when(t == "", 0).otherwise(size - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long"),
            "_size": size,
            # One pass leaves capitals and symbols, which are few; F.translate looks every letter up in a map.
            "_odd": F.regexp_replace(t, PLAIN, ""),
            "_words": F.array_distinct(F.split(F.lower(t), MARKS)),
        }
    )
    odd, symbols, n = F.length("_odd"), F.length(F.regexp_replace("_odd", f"[{CAPITALS}]+", "")), F.greatest(F.col("_size"), F.lit(1))
    out = out.withColumns({"_upper": 1 - (F.col("_size") - (odd - symbols)) / n, "_symbols": 1 - (F.col("_size") - symbols) / n})
    step = lambda x, low, high: F.when(x > high, 2).when(x > low, 1).otherwise(0)
    fresh = F.size("_words") / F.greatest(F.col("n_tokens"), F.lit(1))
    shape = step(F.col("_upper"), 0.08, 0.3) * 9 + step(F.col("_symbols"), 0.005, 0.03) * 3 + step(fresh, 0.15, 0.35)
    return out.withColumn("_shape", shape).drop("_size", "_odd", "_upper", "_symbols")


def shortest(word: Column) -> Column:
    """A word's shortest stem, which its longer ones begin with."""
    return F.left(word, F.lit(min(STEMS)))


def stemmed(docs: DataFrame, words: str) -> tuple[DataFrame, dict[str, Callable[[Column], Column]]]:
    """docs with the distinct stems of a column of words, and by column of words or stems what makes a mark (a hash) of one."""
    longer = words
    for n in sorted(STEMS, reverse=True):
        docs = docs.withColumn(f"_stems{n}", F.array_distinct(F.transform(longer, lambda w: F.left(w, F.lit(n)))))  # noqa: B023
        longer = f"_stems{n}"
    return docs, {words: F.xxhash64} | {f"_stems{n}": functools.partial(F.xxhash64, F.lit(n)) for n in STEMS}


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> dict:
    """Naive Bayes weights by language from a bounded sample of the labelled rows.

    {"langs": known languages, then for each language, with all of them
    together first: "prior" and "shapes" by domain, "words" by the hash of a
    word or stem; "stems": the shortest stems of all words that have one of
    those hashes}. Null labels teach nothing; of several labels of one document
    the worst counts. Without labels every posterior is 1 / 3.
    """
    n, parts = labels.count(), 1 << 20
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(min(1.0, most / max(1, n)) * parts))
    held = held.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    held = held.select("doc_id", domain_of(F.col("q"), F.col("t")).alias("_domain")).where("_domain is not null and doc_id is not null")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    taught = docs.select("doc_id", "text", lang.alias("_lang")).join(F.broadcast(held), "doc_id")  # bounded by most
    taught, kinds = stemmed(described(taught).select("_lang", "_domain", "_shape", "_words"), "_words")
    taught = stash(taught, "taught")
    cells: dict = {(None, r["_domain"], r["_shape"]): r["n"] for r in taught.groupBy("_domain", "_shape").agg(F.count("*").alias("n")).collect()}
    totals = {None: {d: sum(n for (_, x, _), n in cells.items() if x == d) for d in DOMAINS}}
    every = sum(totals[None].values())
    if not every:
        return {"langs": [None], "prior": [[0.0] * len(DOMAINS)], "shapes": [[[0.0] * len(DOMAINS)] * SHAPES], "words": {}, "stems": []}
    by_domain = [F.sum((F.col("_domain") == d).cast("long")).alias(d) for d in DOMAINS]
    own = taught.where("_lang is not null").groupBy("_lang").agg(F.count("*").alias("n"), *by_domain).where(F.least(*DOMAINS) >= FEWEST)
    for r in own.orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect():
        totals[r["_lang"]] = {d: r[d] for d in DOMAINS}
    langs = list(totals)
    if len(langs) > 1:
        for r in taught.where(F.col("_lang").isin(langs[1:])).groupBy("_lang", "_domain", "_shape").agg(F.count("*").alias("n")).collect():
            cells[r["_lang"], r["_domain"], r["_shape"]] = r["n"]
    count = sum((F.col(d) for d in DOMAINS), F.lit(0))
    # Words are hashed as rows, in compiled code, not in their arrays.
    rows = [taught.select("_lang", "_domain", F.explode(c).alias("w")).withColumn("h", mark(F.col("w"))) for c, mark in kinds.items()]
    marks = functools.reduce(DataFrame.unionAll, rows)
    by_lang = marks.groupBy("_lang", "h")
    by_lang = stash(by_lang.agg(*[F.sum((F.col("_domain") == d).cast("long")).alias(d) for d in DOMAINS]), "marks")
    each = by_lang.groupBy("h").agg(*[F.sum(d).alias(d) for d in DOMAINS])
    share = {d: (F.col(d) + 0.5) / (totals[None][d] + 1.0) for d in DOMAINS}
    # How much the mark tells in all: observed times log of observed over expected, where it tells enough at all.
    tells = sum((F.col(d) * F.log(share[d] / (count / every)) for d in DOMAINS), F.lit(0.0))
    clear = F.greatest(*share.values()) / F.least(*share.values()) > 6
    each = stash(each.where(count >= FEWEST), "marks")
    least = F.when(share["toxic"] >= F.greatest(*share.values()), SURE_TOXIC).otherwise(SURE)
    best = each.where(clear & (tells > least + math.log(max(1, each.count())))).where("h <> 0").orderBy(F.desc(tells), "h").limit(VOCABULARY).collect()
    df = {(None, r["h"]): [r[d] for d in DOMAINS] for r in best}
    met = marks.where(F.col("h").isin([r["h"] for r in best])).select(shortest(F.col("w")).alias("stem")).distinct()
    stems = [r["stem"] for r in met.collect()] if best else []  # at most VOCABULARY
    if best and len(langs) > 1:
        chosen = docs.sparkSession.range(1).select(F.explode(_literal([r["h"] for r in best], "bigint")).alias("h"))
        rows = by_lang.where(F.col("_lang").isin(langs[1:])).join(F.broadcast(chosen), "h")  # VOCABULARY rows
        df |= {(r["_lang"], r["h"]): [r[d] for d in DOMAINS] for r in rows.collect()}  # at most LANGUAGES * VOCABULARY
    model: dict = {"langs": langs, "prior": [], "shapes": [], "words": {r["h"]: [] for r in best}, "stems": sorted(stems)}
    for own in langs:
        have = [totals[own][d] for d in DOMAINS]
        prior = [math.log((x + 1) / (sum(have) + len(DOMAINS))) for x in have]
        for h, weights in model["words"].items():
            chance = [(x + PSEUDO) / (t + 2 * PSEUDO) for x, t in zip(df.get((own, h), [0] * len(DOMAINS)), have, strict=True)]
            # Absence tells too: its part goes to the prior, and presence takes it back.
            prior = [p + math.log(1 - c) for p, c in zip(prior, chance, strict=True)]
            weights.append([math.log(c / (1 - c)) for c in chance])
        model["prior"].append(prior)
        model["shapes"].append([[math.log((cells.get((own, d, s), 0) + 0.5) / (t + 0.5 * SHAPES)) for d, t in zip(DOMAINS, have, strict=True)] for s in range(SHAPES)])
    return model


def _literal(values: list, kind: str) -> Column:
    """An array literal: folded from text once, when the plan is optimized."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """docs with n_tokens and p_clean, p_junk, p_toxic, which add up to 1; clashing columns are replaced."""
    made = ["n_tokens", *[f"p_{d}" for d in DOMAINS]]
    keep = [c for c in docs.columns if c not in made]
    own = F.col("lang").cast("string") if "lang" in keep else F.lit(None).cast("string")
    told, slots, langs = described(docs.select(carried(docs, keep), F.col("text"), own.alias("lang"))), SLOTS, model["langs"]
    while len({h % slots for h in model["words"]}) < len(model["words"]):
        slots += 1
    keys, number = [0] * slots, [0] * slots
    for k, h in enumerate(model["words"]):
        keys[h % slots], number[h % slots] = h, k
    slot = lambda h: F.pmod(h, F.lit(slots)).cast("int")
    table, numbers = _literal(keys, "bigint"), _literal(number, "int")
    place = F.lit(0)
    for k, x in enumerate(langs[1:], 1):
        place = F.when(F.col("lang") == x, k).otherwise(place)
    # Most words share no stem with a mark: they need no hash.
    few = F.filter("_words", lambda w: shortest(w).isin(model["stems"]))
    told, kinds = stemmed(told.withColumn("_few", few), "_few")
    told = told.withColumn("_marks", F.concat(*[F.transform(c, lambda w: mark(w)) for c, mark in kinds.items()]))  # noqa: B023
    told = told.withColumns({"_at": place, "_found": F.transform(F.filter("_marks", lambda h: F.get(table, slot(h)) == h), lambda h: F.get(numbers, slot(h)))})
    logits = {}
    for k, d in enumerate(DOMAINS):
        flat = lambda rows: _literal([f"{x[k]:.6f}" for x in rows], "double")  # noqa: B023, E731
        value = F.get(flat(model["prior"]), F.col("_at")) + F.get(flat([x for rows in model["shapes"] for x in rows]), F.col("_at") * SHAPES + F.col("_shape"))
        if model["words"]:
            weights = flat([x for rows in model["words"].values() for x in rows])
            value = value + F.aggregate("_found", F.lit(0.0), lambda a, i: a + F.get(weights, i * len(langs) + F.col("_at")))  # noqa: B023
        logits[f"_l_{d}"] = value
    told = told.withColumns(logits)
    top = F.greatest(*[F.col(c) for c in logits])
    told = told.withColumns({c: F.exp(F.col(c) - top) for c in logits})
    whole = sum((F.col(c) for c in logits), F.lit(0.0))
    return told.select("own.*", "n_tokens", *[(F.col(f"_l_{d}") / whole).alias(f"p_{d}") for d in DOMAINS])


def rate_of(history: list[list[float]]) -> Column:
    """A document's rate after the steps whose gradients are given."""
    if not history:
        return F.lit(1.0)
    k, sums = len(DOMAINS), _literal([repr(g) for step in history for g in step], "double")

    def step(rate: Column, i: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((F.col(f"p_{d}") * F.get(sums, i * k + j) for j, d in enumerate(DOMAINS)), F.lit(0.0)))

    # A loop over literals: the plan's code stays the same from step to step.
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(history) - 1)), F.lit(1.0), step)


def fit_rates(known: DataFrame, targets: dict[str, float], steps: int = STEPS) -> list[list[float]]:
    """Steps of projected gradient descent from rate 1; known: stored n_tokens and posteriors; targets: tokens by domain.

    The metric weighs a document by its tokens, so long and short ones of one
    posterior get one rate; domains weigh by their own size. With those weights
    the step is one over the largest eigenvalue of the domains' scaled overlap,
    which is exact. Domains without tokens are left out. It ends near the
    targets, or where a step no longer helps (targets can be out of reach).
    """
    n = F.col("n_tokens").cast("double")
    pairs = [(a, b) for k, a in enumerate(DOMAINS) for b in DOMAINS[k:]]
    sums = known.agg(*[F.sum(n * F.col(f"p_{a}") * F.col(f"p_{b}")).alias(f"{a}_{b}") for a, b in pairs]).first()
    m = np.array([[sums[f"{min(a, b)}_{max(a, b)}"] or 0.0 for b in DOMAINS] for a in DOMAINS])
    scale = np.array([1 / x if x > 0 else 0.0 for x in np.diag(m)])
    root = np.sqrt(scale)
    largest = np.linalg.eigvalsh(root[:, None] * m * root[None]).max()
    if largest <= 0:
        return []
    want, history, was = np.array([targets[d] for d in DOMAINS]), [], None
    size = np.maximum(want, 1.0)
    for _ in range(steps):
        row = known.agg(*[F.sum(n * F.col(f"p_{d}") * rate_of(history)).alias(d) for d in DOMAINS]).first()
        off = np.array([row[d] or 0.0 for d in DOMAINS]) - want
        loss = float((off * off * scale).sum())
        if (np.abs(off) <= NEAR * size)[scale > 0].all() or (was is not None and was - loss <= NEAR * NEAR * was):
            break  # there, or as near as nonnegative rates get
        was = loss
        history.append((off * scale / largest).tolist())
    return history


def finish_rates(known: DataFrame, targets: dict[str, float], history: list[list[float]], most: int = 40) -> list[list[float]]:
    """One more step, which meets the targets from wherever ``history`` ended, with the least change of rates.

    Change is weighed by tokens. The step is the root of the dual in one number
    for each domain, by Newton's method with halved steps; each evaluation is
    one pass of sums. RIDGE keeps the dual bounded where targets are out of
    reach: rates then end as near as they can, in the metric of ``fit_rates``.
    """
    n, k = F.col("n_tokens").cast("double"), len(DOMAINS)
    p, base = [F.col(f"p_{d}") for d in DOMAINS], rate_of(history)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    start = stash(known.select(n.alias("n"), *p, base.alias("base")), "start")
    want = np.array([targets[d] for d in DOMAINS])
    weight = np.array([start.agg(*[F.sum(F.col("n") * x * x) for x in p]).first()]).astype("f8")[0]
    weight = np.nan_to_num(weight)
    some = weight > 0
    if not some.any():
        return history

    def at(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        given = _literal([repr(float(y)) for y in dual], "double")  # as in rate_of: the compiled code is the same for every dual
        free = F.col("base") - sum((x * F.get(given, F.lit(j)) for j, x in enumerate(p)), F.lit(0.0))
        rate, on = F.greatest(F.lit(0.0), free), (free > 0).cast("double")
        sums = start.agg(F.sum(F.col("n") * rate * rate), *[F.sum(F.col("n") * x * rate) for x in p], *[F.sum(F.col("n") * on * p[a] * p[b]) for a, b in pairs]).first()
        curve = np.diag(np.where(some, RIDGE * weight, 1.0))
        for (a, b), v in zip(pairs, sums[1 + k :], strict=True):
            curve[a, b] += v
            curve[b, a] += v if a != b else 0
        value = sums[0] / 2 + float(want[some] @ dual[some] + RIDGE / 2 * weight @ (dual * dual))
        slope = np.where(some, RIDGE * weight * dual - (np.array(sums[1 : 1 + k]) - want), 0.0)
        return value, slope, curve

    dual = np.zeros(k)
    value, slope, curve = at(dual)
    for _ in range(most):
        if (np.abs(slope) <= NEAR * NEAR * np.maximum(want, 1.0))[some].all():
            break
        move, part = np.linalg.solve(curve, -slope), 1.0
        while part > 1e-4:
            tried = at(dual + part * move)
            if tried[0] <= value + 1e-4 * part * float(slope @ move) or np.abs(tried[1]).max() < 0.1 * np.abs(slope).max():
                break
            part /= 2
        else:
            break  # nothing left but rounding
        dual, (value, slope, curve) = dual + part * move, tried
    return [*history, dual.tolist()]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, with_text: bool = True, steps: int = STEPS, shares: dict[str, float] | None = None, taught: DataFrame | None = None) -> DataFrame:
    """docs with n_tokens, p_clean, p_junk, p_toxic and rate; every row stays. Texts are scanned once.

    targets: weight of each domain (they need not add up to 1); ``total``
    tokens are wanted in all, those of docs where not given. Without targets
    each domain's total is to be its ``shares`` of what it has (SHARES where not
    given). Where no label meets a document nothing tells domains apart and,
    without targets, every rate is 1. The classifier learns from the labelled
    rows of ``taught``, or else of docs. Null texts have no tokens; repeated rows
    get the same rate; no rows give none. ``expected`` says what rates come to.
    """
    docs = docs.drop("rate")
    model = fit(docs if taught is None else taught, labels)
    # Stored once, with the text where it is asked for: later steps read the short columns alone.
    told = posteriors(docs, model)
    known = stash(told if with_text else told.drop("text"), "posteriors")
    sums = known.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()
    have = {d: sums[d] or 0.0 for d in DOMAINS}
    if targets is not None:
        weight = sum(targets.values()) or 1.0
        want = {d: targets.get(d, 0.0) / weight * (sum(have.values()) if total is None else total) for d in DOMAINS}
    elif any(model["prior"][0]):
        want = {d: have[d] * (shares or SHARES).get(d, 1.0) for d in DOMAINS}
    else:
        want = have  # a prior of zeros: no label met a document
    history = finish_rates(known, want, fit_rates(known, want, steps))
    return known.withColumn("rate", rate_of(history))


def expected(mixed: DataFrame) -> DataFrame:
    """domain, tokens: what the rates of mixed rows come to, to hold against the targets."""
    sums = mixed.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("rate")).alias(d) for d in DOMAINS])
    return sums.select(F.expr(f"stack({len(DOMAINS)}, {', '.join(f'{d!r}, {d}' for d in DOMAINS)}) AS (domain, tokens)"))


def draw(mixed: DataFrame, nearest: bool = False) -> DataFrame:
    """Each row as often as its rate says: rounded, or (the default) up with the chance of its fraction, by a hash of text."""
    chance = F.lit(0.5) if nearest else F.pmod(F.xxhash64(F.lit("draw"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + chance).cast("int")
    return mixed.where(copies > 0).select(F.explode(F.array_repeat(carried(mixed), copies)).alias("own")).select("own.*")
