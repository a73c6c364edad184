import random

import pytest

from tessera.operators.components import components_by_runs, connected_components


def _brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (200, 201)] + [(300, 300)]
    got = connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    want = {k: v for k, v in _brute([e for e in edges if e[0] != e[1]]).items()}
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src int, dst int")).count() == 0


@pytest.mark.parametrize("run", [1, 7, 1000])
def test_runs_give_the_same_components(spark, run):
    rng = random.Random(run)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randint(40, 160), rng.randint(40, 160)) for _ in range(60)] + [(200 + i, 40) for i in range(9)] + [(300, 300)]
    got = components_by_runs(spark.createDataFrame([*edges, (None, 5)], "src int, dst int"), run=run).collect()
    want = _brute([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
