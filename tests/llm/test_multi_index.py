import heapq

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import multi_index


def brute(ids, x, k=20):
    out = {}
    for q, v in zip(ids, x):
        if q % 20 == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in zip(ids, x) if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def run(spark, ids, x, **options):
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int").repartition(3)
    out = {}
    for r in multi_index.nearest(df, F.col("id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    x = (centres[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32).astype(float)
    want, got = brute(range(3000), x), run(spark, range(3000), x)
    assert got.keys() == want.keys() and all(len(v) == 20 and [r for _, _, r in v] == list(range(1, 21)) for v in got.values())
    hits = sum(len({i for i, _, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        for i, s, _ in found:
            assert s == float((x[q] * x[i]).sum())


def scored(x, share, queries):
    """Share of all query-vector products that cell_scores makes, blocks as in the operator, and the recall."""
    half = x.shape[1] // 2
    many = min(128, len(x) // 4, int(np.sqrt(len(x) / 4)))
    c1, c2 = multi_index.codebook(x[:10_000, :half], many), multi_index.codebook(x[:10_000, half:], many)
    cell = multi_index._nearest(x[:, :half], c1) * many + multi_index._nearest(x[:, half:], c2)
    order = np.lexsort((np.arange(len(x)), cell))
    v, counts, filled = x[order], np.bincount(cell, minlength=many * many), np.unique(cell)
    edges, q = np.concatenate(([0], np.cumsum(counts[filled]))), x[queries]
    place = lambda d: np.argsort(np.argsort(d, kind="stable"), kind="stable")
    visits = np.array([(place(b)[None, :] < multi_index.visit(a, b, counts.reshape(many, many), int(share * len(x)))[:, None]).reshape(-1)[filled] for a, b in zip(*multi_index.distances(q, c1, c2))])
    made, found = 0, np.full((len(q), len(x)), -np.inf)
    for c, rows, score in multi_index.cell_scores(q, v, edges, visits):
        made += score.size
        found[rows[:, None], order[edges[c] : edges[c + 1]][None, :]] = score
    true = q @ x.T
    true[np.arange(len(q)), queries] = found[np.arange(len(q)), queries] = -np.inf
    hits = sum(len(set(np.argsort(-a)[:20]) & set(np.argsort(-b)[:20])) for a, b in zip(true, found))
    return made / (len(q) * len(x)), hits / (20 * len(q))


def test_only_visited_cells_are_scored():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 64))
    x = centres[rng.integers(0, 100, 8000)] + 0.4 * rng.normal(size=(8000, 64))
    made, recall = scored(x, 0.1, np.arange(0, 8000, 80))
    assert made <= 0.2 and recall >= 0.9
    made, _ = scored(rng.normal(size=(8000, 64)), 0.3, np.arange(0, 8000, 80))
    assert 0.3 <= made <= 0.35


def test_budget_follows_structure(spark, monkeypatch):
    rng, asked = np.random.default_rng(6), []
    keep = multi_index.budget
    monkeypatch.setattr(multi_index, "budget", lambda *a: asked.append(keep(*a)) or asked[-1])
    centres = rng.normal(size=(50, 16))
    for x in (centres[rng.integers(0, 50, 2000)] + 0.3 * rng.normal(size=(2000, 16)), rng.normal(size=(2000, 16))):
        want, got = brute(range(2000), x), run(spark, range(2000), x.tolist())
        assert sum(len({i for i, _, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    assert asked[0] < 200 < asked[1] < 1500


def test_exact_where_all_cells_are_visited(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(multi_index, "QUERIES_EACH", 5)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (500, 7)).astype(float)
    x[100:300] = x[40]  # one very common vector, split over blocks
    ids = [i for i in range(500) if (x[i] != 0).any()]
    want = brute(ids, x[ids])
    got = run(spark, ids, x[ids], share=1.0)
    assert {q: [(i, s) for i, s, _ in v] for q, v in got.items()} == want


def test_visits_by_summed_distance():
    rng = np.random.default_rng(4)
    a, b, n = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 5, (9, 7))
    for enough in (1, 20, 60, 10_000):
        reach = multi_index.visit(a, b, n, enough)
        seen = {(i, j) for i in range(9) for j in np.argsort(b)[: reach[i]].tolist()}
        order, found, want = [(a[i] + b[j], i, j) for i in range(9) for j in range(7)], 0, set()
        heapq.heapify(order)
        while order and found < enough:
            _, i, j = heapq.heappop(order)
            found, want = found + n[i, j], want | {(i, j)}
        assert seen == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0, 0.5]), (1, [1.0, 1.0, 1.0]), (1, [1.0, 1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [3.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in multi_index.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.5), (0, 2, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0)]
    assert multi_index.nearest(df.where("vec_id is null"), F.col("id") % 20 == 0).count() == 0
    assert multi_index.nearest(df.where("vec_id = 1"), F.col("id") % 20 == 1).count() == 0


def test_repeated_ids_and_extra_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i, x[i].tolist(), "c", i, "v", 1) for i in range(200)]
    again = [(7, (x[7] + 1).tolist(), "c", 0, "v", 1), (7, x[7].tolist(), "d", 0, "v", 1), (40, (x[40] - 1).tolist(), "c", 0, "v", 1)]
    schema = "vec_id long, embedding array<float>, cell string, id long, vec string, n int"
    least = {r[0]: r[1] for r in rows}
    for i, v, *_ in again:
        least[i] = min(least[i], v)
    want = brute(np.array(list(least)), np.array(list(least.values()), np.float32))
    got = multi_index.nearest(spark.createDataFrame(rows + again, schema).repartition(3), F.col("id") % 20 == 0, share=1.0)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {int(q): [int(i) for i, _ in v] for q, v in want.items()} == found
