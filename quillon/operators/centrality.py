"""Graph analytics as joins over edge tables: PageRank, betweenness, communities.

Nothing but counts and sums reaches the driver; each step is stored by
checkpoint(), so a lost executor costs a step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.lineage import cut

#: A move or a level of communities must raise the modularity by so much.
LEAST_GAIN = 1e-6


def undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """at, to: both ways of every current edge between two different nodes, once."""
    ids = nodes.select("node_id")
    pairs = edges.where(F.col("effective_end").isNull()).select("src_id", "dst_id").where("src_id <> dst_id")
    pairs = pairs.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return pairs.select("src_id", "dst_id").union(pairs.select("dst_id", "src_id")).distinct().toDF("at", "to")


def _top(nodes: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """node_id, name, score to six places: the n highest, ties by node_id; nodes without a score have 0."""
    named = nodes.select("node_id", "name").join(scores, F.col("node_id") == F.col("id"), "left")
    return named.select("node_id", "name", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(n)


def ranks(nodes: DataFrame, edges: DataFrame, steps: int = 100, damping: float = 0.85, near: float = 1e-6) -> DataFrame:
    """id, score: PageRank over the undirected graph of current edges, iterated until ranks change by less than ``near`` a node in all.

    Links carry one over their source's degree, so a step is one join with the
    links and one that takes the sums up; the old rank travels with the new one.
    Raises ValueError where ``steps`` are too few.
    """
    links = undirected(nodes, edges)
    out = links.groupBy("at").agg((1.0 / F.count("*")).alias("part"))
    links = cut(links.join(out, "at"))
    count = nodes.count()
    now = cut(nodes.select(F.col("node_id").alias("id")).join(out, F.col("id") == F.col("at"), "left").select("id", F.col("at").isNull().alias("idle"), F.lit(1.0 / max(1, count)).alias("score")))
    sums = lambda df, was: df.agg(F.sum(F.when(F.col("idle"), F.col("score"))).alias("idle"), F.sum(F.abs(F.col("score") - was)).alias("moved")).first()
    idle = sums(now, F.col("score"))["idle"] or 0.0
    for _ in range(steps):
        sent = links.join(now, F.col("at") == F.col("id")).groupBy("to").agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        score = (1 - damping) / max(1, count) + damping * (F.coalesce("got", F.lit(0.0)) + idle / max(1, count))
        now = cut(now.join(sent, F.col("id") == F.col("to"), "left").select("id", "idle", score.alias("score"), F.col("score").alias("was")))
        found = sums(now, F.col("was"))
        idle = found["idle"] or 0.0
        if (found["moved"] or 0.0) < count * near or not count:
            return now.select("id", "score")
    raise ValueError(f"PageRank did not converge in {steps} steps")


def pagerank(nodes: DataFrame, edges: DataFrame, n: int, steps: int = 100, damping: float = 0.85, near: float = 1e-6) -> DataFrame:
    """Top n by PageRank (see ``ranks``)."""
    return _top(nodes, ranks(nodes, edges, steps, damping, near), n)


def dependencies(nodes: DataFrame, edges: DataFrame, pivots: int = 100, seed: int = 0) -> DataFrame:
    """id, score: betweenness over the undirected graph, from all nodes or, where there are more, from ``pivots`` of them.

    All sources advance at once: a row is a source and a node it has reached,
    with the number of shortest ways. A level's neighbours lie in it, the one
    before or the next, so only those two are looked up. On the way back each
    level hands its dependencies to the one before. Sums are scaled to all
    sources and pairs.
    """
    links = cut(undirected(nodes, edges))
    count = nodes.count()
    ids = nodes.select(F.col("node_id").alias("id")).distinct()
    if count > pivots:
        ids = ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots)
    front = cut(ids.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("ways")))
    sources, levels = front.count(), [front]
    while True:
        reached = front.join(links, F.col("id") == F.col("at")).groupBy("s", F.col("to").alias("id")).agg(F.sum("ways").alias("ways"))
        for known in levels[-2:]:
            reached = reached.join(known.select("s", "id"), ["s", "id"], "left_anti")
        front = cut(reached)
        if front.isEmpty():
            break
        levels.append(front)
    below, out = None, None
    for level in reversed(levels[1:]):
        if below is None:
            own = level.withColumn("carried", F.lit(0.0))
        else:
            share = below.select("s", F.col("id").alias("w"), ((1 + F.col("carried")) / F.col("ways")).alias("share"))
            back = share.join(links, F.col("w") == F.col("at")).select("s", F.col("to").alias("id"), "share").groupBy("s", "id").agg(F.sum("share").alias("share"))
            own = level.join(back, ["s", "id"], "left").select("s", "id", "ways", (F.col("ways") * F.coalesce("share", F.lit(0.0))).alias("carried"))
        below = cut(own)
        sums = below.groupBy("id").agg(F.sum("carried").alias("carried"))
        out = sums if out is None else out.unionByName(sums)
    scale = count / sources / ((count - 1) * (count - 2)) if count > 2 and sources else 0.0
    if out is None:
        return ids.select("id", F.lit(0.0).alias("score"))
    return out.groupBy("id").agg((F.sum("carried") * scale).alias("score"))


def betweenness(nodes: DataFrame, edges: DataFrame, n: int, pivots: int = 100, seed: int = 0) -> DataFrame:
    """Top n by betweenness (see ``dependencies``)."""
    return _top(nodes, dependencies(nodes, edges, pivots, seed), n)


def _moved(links: DataFrame, held: DataFrame, resolution: float, whole: float, turn: int) -> DataFrame:
    """held (id, k, c) after the moves of half of its nodes, each with own (its community before), inside and square (its parts of the modularity before)."""
    total = held.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    beside = links.join(held.select(F.col("id").alias("to"), "c"), "to").groupBy(F.col("at").alias("id"), "c").agg(F.sum("w").alias("w"))
    beside = beside.unionByName(held.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
    told = beside.join(held.select("id", "k", F.col("c").alias("own")), "id").join(total, "c")
    mine = F.col("c") == F.col("own")
    gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(mine, F.col("k")).otherwise(0.0)) / whole, 9)
    ours = lambda x, name: F.max(F.when(mine, x)).alias(name)
    best = F.min(F.struct((-gain).alias("loss"), "c", "members")).alias("best")  # ties: the smallest name
    each = told.groupBy("id", "k", "own").agg(best, ours(gain, "stays"), ours(F.col("members"), "alone"), ours(F.col("w"), "inside"), ours(F.col("k") * F.col("total"), "square"))
    turns = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
    # Of two nodes alone in their communities one moves, to the smaller name; else they would swap.
    swaps = (F.col("alone") == 1) & (F.col("best.members") == 1) & (F.col("best.c") > F.col("own"))
    moves = turns & (-F.col("best.loss") > F.col("stays")) & ~swaps
    return each.select("id", "k", F.when(moves, F.col("best.c")).otherwise(F.col("own")).alias("c"), "own", "inside", "square")


def _level(links: DataFrame, points: DataFrame, resolution: float, whole: float, most: int) -> tuple[DataFrame, float]:
    """(id, c of the best partition found, its modularity) by moves of alternating halves. links: at, to, w; points: id, k, loop."""
    held = points.select("id", "k", F.col("id").alias("c"))
    loops = points.agg(F.sum("loop")).first()[0] or 0.0
    best, score, idle, still = held, float("-inf"), 0, 0
    for turn in range(most):
        new = cut(_moved(links, held, resolution, whole, turn))
        sums = new.agg(F.sum("inside"), F.sum("square"), F.sum((F.col("c") != F.col("own")).cast("long"))).first()
        now = ((sums[0] or 0.0) + loops) / whole - resolution * (sums[1] or 0.0) / (whole * whole)
        idle = 0 if now > score + LEAST_GAIN else idle + 1
        if now > score:
            best, score = held, now
        still = still + 1 if not sums[2] else 0
        if idle == 2 or still == 2:
            break
        held = new.select("id", "k", "c")
    return best.select("id", "c"), score


def partition(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 20, most: int = 40) -> DataFrame:
    """node_id, community_id (its smallest node_id): Louvain communities of the undirected graph of current edges.

    A level moves nodes to the community beside them that raises the modularity
    most, half of the nodes at a time, as joins on (node, community beside it);
    then communities become the nodes of a graph of summed weights. It ends
    where a level gains nothing. Nodes without edges are communities of their own.
    """
    links = cut(undirected(nodes, edges).withColumn("w", F.lit(1.0)))
    ids = nodes.select(F.col("node_id").alias("id")).distinct()
    whole = links.agg(F.sum("w")).first()[0] or 0.0
    named = ids.select("id", F.col("id").alias("c"))
    if whole:
        weight = links.groupBy(F.col("at").alias("id")).agg(F.sum("w").alias("k"))
        points = cut(weight.select("id", "k", F.lit(0.0).alias("loop")))
        score = float("-inf")
        for _ in range(levels):
            found, new = _level(links, points, resolution, whole, most)
            if new <= score + LEAST_GAIN:
                break
            score = new
            to = found.select("id", F.col("c").alias("next"))
            named = cut(named.join(to.withColumnRenamed("id", "c"), "c", "left").select("id", F.coalesce("next", "c").alias("c")))
            both = links.join(to.select(F.col("id").alias("at"), F.col("next").alias("a")), "at").join(to.select(F.col("id").alias("to"), F.col("next").alias("b")), "to")
            summed = cut(both.groupBy("a", "b").agg(F.sum("w").alias("w")))
            inner = summed.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("inner"))
            points = points.join(to, "id").groupBy(F.col("next").alias("id")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
            points = cut(points.join(inner, "id", "left").select("id", "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")))
            links = cut(summed.where("a <> b").toDF("at", "to", "w"))
            if links.isEmpty():
                break
    least = named.groupBy("c").agg(F.min("id").alias("community_id"))
    return named.join(least, "c").select(F.col("id").alias("node_id"), "community_id")


def modularity(nodes: DataFrame, edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (node_id, community_id) of the undirected graph of current edges; 0 without edges."""
    links = undirected(nodes, edges)
    a, b = (parts.select(F.col("node_id").alias(end), F.col("community_id").alias(c)) for end, c in (("at", "a"), ("to", "b")))
    told = links.join(a, "at").join(b, "to").groupBy("a").agg(F.count("*").alias("k"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("inside"))
    whole, inside, square = told.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k").cast("double") * F.col("k"))).first()
    return inside / whole - resolution * square / (whole * whole) if whole else 0.0


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, top: int = 20) -> DataFrame:
    """community_id, size, sample (five names) of the largest communities (see ``partition``)."""
    named = partition(nodes, edges, resolution).join(nodes.select("node_id", "name"), "node_id")
    sizes = named.groupBy("community_id").agg(F.count("*").alias("size"))
    best = sizes.orderBy(F.desc("size"), "community_id").limit(top).select("community_id", "size")
    # The five smallest of 1,024 slots' smallest names: a community may hold a third of all nodes.
    held = named.join(F.broadcast(best), "community_id")
    slots = held.groupBy("community_id", "size", F.pmod(F.xxhash64("node_id"), F.lit(1024)).alias("slot")).agg(F.min("name").alias("name"))
    sample = F.slice(F.sort_array(F.collect_list("name")), 1, 5).alias("sample")
    return slots.groupBy("community_id", "size").agg(sample).orderBy(F.desc("size"), "community_id")
