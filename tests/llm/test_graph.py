"""Connected components against union-find, on paths, stars, cycles, repeated edges, loops and random graphs."""

import random

import pytest

from tabml.llm.graph import components
from tabml.llm.store import Scratch


def by_union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def graphs():
    r = random.Random(3)
    path = [(i, i + 1) for i in range(60)]
    zigzag = [(i, 99 - i) for i in range(50)] + [(99 - i, i + 1) for i in range(49)]
    star = [(7, i) for i in range(200, 400)] + [(7, 7), (200, 7)]
    chance = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    return {"path": path, "zigzag": zigzag, "star": star, "random": chance, "apart": [(-5, 9), (1, 2), (4, 3)], "none": []}


@pytest.mark.parametrize("name", list(graphs()))
def test_components(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(r) for r in components(Scratch(spark, "graph-test"), df).select("id", "component").collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == by_union_find(edges)
