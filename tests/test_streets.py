"""Street graphs against a walk over small graphs."""

import random

import pytest

from pavement.operators import streets as G

SCHEMA = "city string, u long, v long, way string, length_m double"


def plain(edges):
    """Streets as (city, smaller end, larger end, length, edges), by walking; rings from their smallest node."""
    once = {}
    for city, u, v, way, length in edges:
        k = (city, min(u, v), max(u, v), way)
        once[k] = min(once.get(k, length), length)
    ends = {}
    for k in once:
        ends.setdefault((k[0], k[1]), []).append((k, k[2]))
        ends.setdefault((k[0], k[2]), []).append((k, k[1]))
    inside = {n for n, e in ends.items() if len(e) == 2 and len({x for _, x in e if x != n[1]}) == 2}
    used, out = set(), []

    def walk(node, edge, to):
        length, n = once[edge], 1
        used.add(edge)
        start = node
        while (edge[0], to) in inside and (edge[0], to) != start:
            edge, to = next((e, x) for e, x in ends[(edge[0], to)] if e != edge)
            used.add(edge)
            length, n = length + once[edge], n + 1
        out.append((edge[0], min(start[1], to), max(start[1], to), round(length, 6), n))

    for node in sorted(ends):
        if node not in inside:
            for edge, to in ends[node]:
                if edge not in used:
                    walk(node, edge, to)
    for node in sorted(ends):  # what is left are rings
        edge, to = ends[node][0]
        if edge not in used:
            walk(node, edge, to)
    return sorted(out)


def streets(spark, edges):
    found = G.street_graph(spark.createDataFrame(edges, SCHEMA))
    return sorted((r["city"], min(r["from_node"], r["to_node"]), max(r["from_node"], r["to_node"]), round(r["length_m"], 6), r["n_edges"])
                  for r in found.collect())


def path(city, nodes, way):
    return [(city, a, b, f"{way}{k}", 1.0 + k) for k, (a, b) in enumerate(zip(nodes, nodes[1:]))]


CASES = {
    "a long chain": path("a", list(range(60)), "c"),
    "a ring": path("a", [5, 9, 2, 7, 5], "r"),
    "a ring on a stalk": path("a", [1, 2, 3, 4, 5, 6, 3], "s"),
    "a loop": [("a", 1, 1, "l", 3.0), ("a", 1, 2, "m", 1.0)],
    "parallel ways": [("a", 1, 2, "p", 3.0), ("a", 1, 2, "q", 4.0), ("a", 2, 3, "t", 1.0)],
    "two ways there and back": [("a", 1, 2, "p", 3.0), ("a", 2, 1, "q", 4.0)],
    "tiles and directions": path("a", [1, 2, 3], "x") + [(c, v, u, w, m + 1) for c, u, v, w, m in path("a", [1, 2, 3], "x")],
    "the same nodes in two cities": path("a", [1, 2, 3], "x") + path("b", [3, 2, 1, 0], "x"),
    "a crossing": path("a", [1, 2, 3, 4, 5], "h") + path("a", [6, 7, 3, 8, 9], "v"),
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert streets(spark, CASES[name]) == plain(CASES[name])


def test_random_graphs(spark):
    draw = random.Random(7)
    edges = [(draw.choice("ab"), draw.randrange(150), draw.randrange(150), f"w{k}", float(draw.randrange(1, 50))) for k in range(300)]
    edges += path("c", [draw.randrange(1000, 9000) for _ in range(90)] , "long")
    assert streets(spark, edges) == plain(edges)


def test_counts(spark):
    counts = G.street_counts(G.street_graph(spark.createDataFrame(CASES["a crossing"] + [("a", 9, 9, "l", 1.0)], SCHEMA))).collect()
    assert {r["node"]: r["street_count"] for r in counts} == {1: 1, 5: 1, 6: 1, 3: 4, 9: 3}


def test_nulls_and_nothing(spark):
    assert streets(spark, []) == []
    assert streets(spark, [("a", None, 1, "x", 1.0), ("a", 1, None, "y", 1.0), ("a", 1, 2, None, None), (None, 1, 2, "z", 2.0)][:3]) == [("a", 1, 2, 0.0, 1)]
