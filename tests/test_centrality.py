"""Graph analytics against plain forms on graphs that fit a dictionary."""

import random

import pytest

from quillon.operators import centrality


def tables(spark, ids, pairs):
    nodes = spark.createDataFrame([(v, "n", v.upper(), "{}") for v in ids], "node_id string, node_type string, name string, props string")
    edges = spark.createDataFrame([(s, d, "t", None) for s, d in pairs], "src_id string, dst_id string, edge_type string, effective_end date")
    return nodes, edges


def adjacency(ids, pairs):
    g = {v: set() for v in ids}
    for s, d in pairs:
        if s != d and s in g and d in g:
            g[s].add(d)
            g[d].add(s)
    return g


def brandes(g):
    total = dict.fromkeys(g, 0.0)
    for s in g:
        order, before, ways, far = [], {v: [] for v in g}, dict.fromkeys(g, 0.0), {s: 0}
        ways[s], queue = 1.0, [s]
        for v in queue:
            order.append(v)
            for w in g[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        carried = dict.fromkeys(g, 0.0)
        for w in reversed(order):
            for v in before[w]:
                carried[v] += ways[v] / ways[w] * (1 + carried[w])
            if w != s:
                total[w] += carried[w]
    return {v: x / ((len(g) - 1) * (len(g) - 2)) for v, x in total.items()}


def quality(g, of):
    m2 = sum(map(len, g.values()))
    weight = {}
    for v in g:
        weight[of[v]] = weight.get(of[v], 0) + len(g[v])
    return sum(of[v] == of[w] for v in g for w in g[v]) / m2 - sum(k * k for k in weight.values()) / m2**2


def louvain(g):
    """One node after the other, then communities as nodes, until nothing moves."""
    w = {v: dict.fromkeys(g[v], 1.0) for v in g}
    loop, name = dict.fromkeys(g, 0.0), {v: v for v in g}
    m2 = sum(map(len, g.values()))
    while True:
        k = {v: sum(w[v].values()) + loop[v] for v in w}
        of, weight = {v: v for v in w}, dict(k)
        moved, any_moved = True, False
        while moved:
            moved = False
            for v in sorted(w):
                own, links = of[v], {}
                weight[own] -= k[v]
                for x, c in w[v].items():
                    links[of[x]] = links.get(of[x], 0) + c
                gain = lambda c: links.get(c, 0) - weight[c] * k[v] / m2  # noqa: B023, E731
                best = max(sorted({own, *links}), key=lambda c: (gain(c) - 1e-12 * (c != own)))
                of[v] = best
                weight[best] += k[v]
                moved |= best != own
            any_moved |= moved
        if all(of[v] == v for v in w):
            return name
        name = {v: of[c] for v, c in name.items()}
        new, new_loop = {c: {} for c in of.values()}, dict.fromkeys(of.values(), 0.0)
        for v in w:
            new_loop[of[v]] += loop[v]
            for x, c in w[v].items():
                if of[x] == of[v]:
                    new_loop[of[v]] += c
                else:
                    new[of[v]][of[x]] = new[of[v]].get(of[x], 0) + c
        w, loop = new, new_loop


def random_graph(seed, groups=4, size=8):
    rng = random.Random(seed)
    ids = [f"v{g}_{k}" for g in range(groups) for k in range(size)] + ["alone"]
    pairs = [(a, b) for a in ids for b in ids if a < b and "alone" not in (a, b) and rng.random() < (0.5 if a[:2] == b[:2] else 0.03)]
    return ids, pairs + [(b, a) for a, b in pairs[:10]] + [("v0_0", "v0_0"), ("v0_0", "gone")]


def test_betweenness_is_that_of_brandes(spark):
    ids, pairs = random_graph(1, 3, 6)
    got = {r.node_id: r.score for r in centrality.betweenness(*tables(spark, ids, pairs), len(ids)).collect()}
    assert got == pytest.approx(brandes(adjacency(ids, pairs)), abs=2e-6)
    some = centrality.betweenness(*tables(spark, ids, pairs), 5, pivots=4).collect()
    assert len(some) == 5 and some[0].score >= some[-1].score


def test_communities_are_as_good_as_plain_ones(spark):
    ids, pairs = random_graph(2)
    nodes, edges = tables(spark, ids, pairs)
    parts = centrality.partition(nodes, edges)
    of = {r.node_id: r.community_id for r in parts.collect()}
    g = adjacency(ids, pairs)
    assert set(of) == set(ids) and of["alone"] == "alone"
    assert all(min(v for v in ids if of[v] == c) == c for c in set(of.values()))
    assert quality(g, of) >= 0.98 * quality(g, louvain(g)) > 0.3
    assert centrality.modularity(nodes, edges, parts) == pytest.approx(quality(g, of))


def test_a_star_a_ring_and_no_edges(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 6}") for k in range(6)]
    star = [("hub", f"s{k}") for k in range(12)]
    ids = sorted({x for p in ring + star for x in p})
    out = centrality.communities(*tables(spark, ids, ring + star)).collect()
    assert out[0].community_id == "hub" and out[0].size == 13 and len(out[0].sample) == 5
    assert sum(r.size for r in out) == len(ids)
    nodes, edges = tables(spark, ["a", "b"], [])
    assert [r.score for r in centrality.betweenness(nodes, edges, 5).collect()] == [0.0, 0.0]
    assert centrality.communities(nodes, edges).count() == 2
    assert centrality.communities(nodes.limit(0), edges).count() == 0 and centrality.betweenness(nodes.limit(0), edges, 3).count() == 0
