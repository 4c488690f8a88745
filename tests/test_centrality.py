"""Closeness and betweenness by blocks of pivots against plain versions."""

import heapq
import math
import random

import pytest

from shokuba.operators import flows as G


def graph(seed, n, m):
    r = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = r.sample(range(n - 1), 2)  # the last node is alone
        edges[a, b] = float(r.choice([1, 1, 2, 3]))
    return edges


def plain(edges, n):
    out, back = {}, {}
    for (a, b), w in edges.items():
        out.setdefault(a, []).append((b, w))
        back.setdefault(b, []).append((a, w))

    def distances(start, arcs):
        d, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            x, v = heapq.heappop(queue)
            for u, w in arcs.get(v, []):
                if x + w < d.get(u, math.inf):
                    d[u] = x + w
                    heapq.heappush(queue, (x + w, u))
        return d

    closeness = {}
    for v in range(n):
        d = distances(v, back)
        total = sum(d.values())
        closeness[v] = (len(d) - 1) / total * (len(d) - 1) / (n - 1) if total else 0.0
    between = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        d = distances(s, out)
        order = sorted(d, key=d.get)
        sigma, delta = {s: 1.0}, dict.fromkeys(d, 0.0)
        for v in order[1:]:
            sigma[v] = sum(sigma[a] for a, w in back.get(v, []) if a in d and d[a] + w == d[v])
        for v in reversed(order):
            for a, w in back.get(v, []):
                if a in d and d[a] + w == d[v]:
                    delta[a] += sigma[a] / sigma[v] * (1 + delta[v])
            if v != s:
                between[v] += delta[v]
    return closeness, {v: x / ((n - 1) * (n - 2)) for v, x in between.items()}


@pytest.mark.parametrize("cells", [100, None])
def test_blocks_give_the_whole_result_in_bounded_rows(spark, monkeypatch, cells):
    n, edges = 12, graph(1, 12, 30)
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    seen, paths = [], G.shortest_paths

    def watched(*args):
        out = paths(*args)
        seen.append((args[1].count(), out.count()))
        return out

    monkeypatch.setattr(G, "shortest_paths", watched)
    closeness, between = plain(edges, n)
    got = {r.node: r.closeness for r in G.closeness_centrality(e, nodes, cells).collect()}
    assert got.keys() == closeness.keys() and all(math.isclose(got[v], closeness[v], abs_tol=1e-12) for v in got)
    got = {r.node: r.betweenness for r in G.betweenness_centrality(e, nodes, None, cells).collect()}
    assert got.keys() == between.keys() and all(math.isclose(got[v], between[v], abs_tol=1e-12) for v in got)
    assert all(rows <= pivots * n for pivots, rows in seen) and sum(p for p, _ in seen) == 2 * n
    if cells:
        assert len(seen) == 4 and max(rows for _, rows in seen) < n * n


def test_sampled_pivots(spark):
    nodes = spark.createDataFrame([(i,) for i in range(400)], "node long")
    assert G.sample_pivots(nodes, 0.5, 0.1).count() == math.ceil(math.log(8000) / 0.5)
    assert G.sample_pivots(nodes, 0.01).count() == 400
    assert G.sample_pivots(nodes.limit(0)).count() == 0
