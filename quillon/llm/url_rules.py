"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every url becomes one expression for each rule shape (labels in the host,
characters in the path) that the url can fill. An expression is known by the
first 32 bits of its SHA-256: rows meet rules in an equi-join on those bits
alone, and what meets counts only where the whole digests are equal. Precedence
is one long, so picking a row's rule is a maximum, and the rule's text is cut
from the url again.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many rows are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Shapes of rules, at most, that are met by a join each.
SHAPES = 12
#: Hex digits of the short prefix: 32 bits.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://"; both empty without one."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Digest, shape and precedence of each rule; null fields make a rule void, block beats allow for the same text."""
    r = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", F.lower("verdict").alias("verdict")
    ).where("host <> '' and path is not null and verdict in ('allow', 'block')")
    r = r.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
    digest = F.sha2(F.concat("host", "path"), 256)
    rank = (
        F.shiftleft((F.length("host") + F.length("path")).cast("long"), 32)
        + F.shiftleft(F.length("host").cast("long"), 1)
        + F.col("block").cast("long")
    )
    return r.select(
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX).alias("rule_prefix"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_len"),
        rank.alias("rank"),
    )


def _ranked(host: Column, path: Column, shape: Column | tuple[int, int]) -> Column:
    """The digest of a url's expression with so many labels and characters."""
    labels, cut = (F.lit(shape[0]), F.lit(shape[1])) if isinstance(shape, tuple) else (shape["labels"], shape["cut"])
    return F.sha2(F.concat(F.call_function("substring_index", host, F.lit("."), -labels), F.substring(path, F.lit(1), cut)), 256)


def _few(rows: DataFrame, made: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """rows with rank: one broadcast join for each shape, so no row leaves its task."""
    # All rules of a prefix are one row: a url meets at most one row of each shape.
    side = made.groupBy("labels", "path_len", "rule_prefix").agg(F.collect_list(F.struct("rule_digest", "rank")).alias("rules"))
    ranks = []
    for k, (labels, cut) in enumerate(shapes):
        digest, prefix, rules = f"digest{k}", f"prefix{k}", f"rules{k}"
        fits = (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= cut)
        rows = rows.withColumn(digest, F.when(fits, _ranked(F.col("host"), F.col("path"), (labels, cut))))
        own = side.where((F.col("labels") == labels) & (F.col("path_len") == cut)).select(F.col("rule_prefix").alias(prefix), F.col("rules").alias(rules))
        rows = rows.join(F.broadcast(own), F.substring(digest, 1, PREFIX) == F.col(prefix), "left")
        ranks.append(F.array_max(F.transform(F.filter(rules, _confirms(digest)), lambda r: r["rank"])))
    return rows.withColumn("rank", F.greatest(*ranks) if len(ranks) > 1 else ranks[0])


def _confirms(digest: str):
    return lambda r: r["rule_digest"] == F.col(digest)


def _many(rows: DataFrame, made: DataFrame, n: int) -> DataFrame:
    """rows with rank: distinct hosts and paths meet the rules, in expressions of all shapes that the rules have; only what a rule fits comes back."""
    shapes = made.select("labels", F.col("path_len").alias("cut")).distinct().groupBy("labels").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    urls = rows.select("host", "path").distinct().withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))))
    urls = urls.join(F.broadcast(shapes), "labels")  # as many rows as a host may have labels, and as many cuts as a path has characters
    urls = urls.withColumn("cut", F.explode(F.filter("cuts", lambda c: c <= F.length("path"))))
    urls = urls.select("host", "path", _ranked(F.col("host"), F.col("path"), {"labels": F.col("labels"), "cut": F.col("cut")}).alias("digest"))
    side = made.select("rule_prefix", "rule_digest", "rank")
    side = F.broadcast(side) if n <= BROADCAST_RULES else side
    met = urls.join(side, F.substring("digest", 1, PREFIX) == F.col("rule_prefix")).where("digest = rule_digest")
    return rows.join(met.groupBy("host", "path").agg(F.max("rank").alias("rank")), ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", shapes: int = SHAPES) -> DataFrame:
    """pages (url and any other columns) with host, path, rule, verdict added; clashing names are replaced.

    rules: host, path, verdict. A rule fits its host and the host's subdomains
    where the url's path starts with the rule's. The longest host plus path
    wins, then the longest host, then block. Without a rule: null and
    ``default``. Null, empty or scheme-less urls have empty host and path and
    fit nothing. Repeated rows are judged one by one; no rows give no rows.
    Rules of at most ``shapes`` shapes (labels and characters) that fit a
    broadcast are met where a page is, and no page is shuffled; with more,
    distinct hosts and paths meet them and their ranks are joined back.
    """
    made = prepare_rules(rules)
    n = made.count()
    known = [tuple(r) for r in made.select("labels", "path_len").distinct().limit(shapes + 1).collect()]
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col("url"))
    # The columns of pages travel as one struct, so none of their names can clash with what is made here.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), host.alias("host"), path.alias("path"))
    if not known:
        return rows.select("own.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    best = _few(rows, made, sorted(known)) if len(known) <= shapes and n <= BROADCAST_RULES else _many(rows, made, n)
    total = F.shiftright("rank", 32).cast("int")
    from_host = (F.shiftright("rank", 1) % F.lit(1 << 31)).cast("int")
    rule = F.concat(F.right("host", from_host), F.substring("path", F.lit(1), total - from_host))
    verdict = F.when(F.col("rank").isNull(), default).when(F.col("rank") % 2 == 1, "block").otherwise("allow")
    return best.select("own.*", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
