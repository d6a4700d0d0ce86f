"""Traversal of many queries next to a plain breadth-first search."""

import random

from srcloom.operators import graph


def _reached(start, links, depth):
    found, layer = {n: 0 for n in start}, set(start)
    for level in range(1, depth + 1):
        layer = {b for a, b in links if a in layer} - found.keys()
        found |= {n: level for n in layer}
    return found


def test_depths_and_sides_of_a_random_graph(spark):
    rng = random.Random(7)
    links = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)})
    asked = {q: rng.sample(range(60), 1 + q % 3) for q in range(12)}
    edges = spark.createDataFrame(links, "source long, target long")
    seeds = spark.createDataFrame([(q, n) for q, ns in asked.items() for n in ns], "query_id long, node long")
    for depth in (1, 2, 3):
        up = {q: _reached(ns, links, depth) for q, ns in asked.items()}
        down = {q: _reached(ns, [(b, a) for a, b in links], depth) for q, ns in asked.items()}
        wanted = set()
        for q in asked:
            for n in up[q].keys() | down[q].keys():
                u, d = up[q].get(n, 99), down[q].get(n, 99)
                wanted.add((q, n, min(u, d), "seed" if min(u, d) == 0 else "upstream" if u <= d else "downstream"))
        got = [tuple(r) for r in graph.traverse(seeds, edges, depth, "bidirectional").select("query_id", "node", "depth", "direction").collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_the_last_hop_is_shuffled_as_lists(spark):
    edges = spark.createDataFrame([(1, 2)], "source long, target long")
    seeds = spark.createDataFrame([(1, 1)], "query_id long, node long")
    plan = graph.traverse(seeds, edges, 1, "upstream")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")
