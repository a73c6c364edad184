"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own, so K + K centroids make K x K cells.
A query visits cells in the order of summed distance (the negative inner products of its halves
with the two centroids) by a heap over pairs, until the cells hold enough entries; only the entries
of visited cells are scored, and ranked by the exact inner product.

How many entries are enough is measured, since it depends on the vectors' structure: for a bounded
sample of queries the true neighbours are found by one pass over all vectors, and the budget is
what reaches the wanted share of them.

Vectors lie in blocks of neighbouring cells, a crowded cell over several blocks.  A query travels
to the blocks in which it visits a cell, with a bit for each cell there; a task holds one block and
streams its queries past it, cell by cell.  The driver sees the codebooks, fitted on a bounded
sample, the K x K counts and the sampled queries' neighbours, nothing that grows with the rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.skew import join_facts
from tessera.session import cut_lineage

#: Most centroids of a half; fewer where cells would hold less than four vectors on average.
CENTROIDS = 128
#: Vectors that the codebooks are fitted on.
SAMPLE_ROWS = 10_000
#: Queries whose true neighbours set the budget of all.
SAMPLE_QUERIES = 256
VECTOR_BLOCK = 4096
#: Queries scored together, and the most that meet one copy of a block.
QUERY_BLOCK, QUERIES_EACH = 256, 1 << 15


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec) of the vectors that take part, one for each id (the least of several)."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    kind = "array<float>" if vectors.schema[vector].dataType.elementType == T.FloatType() else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"))
    # Only ids are grouped; vectors move only where some id is there more than once.
    repeated = cut_lineage(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        return rows
    marked = join_facts(rows, repeated, "id", "left")
    return marked.where("n is null").select("id", "vec").unionByName(marked.where("n is not null").groupBy("id").agg(F.min("vec").alias("vec")))


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids from evenly spaced first rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """How many of the nearest second centroids are visited with each first centroid.

    ``first`` and ``second`` are the distances of the query's halves; ``counts`` the entries of each
    pair.  The heap holds, for each first centroid met so far, its next pair; a first centroid joins
    once the one before it in distance has been visited.
    """
    by_first, by_second = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    d1, d2 = first[by_first].tolist(), second[by_second].tolist()
    held = counts[np.ix_(by_first, by_second)].tolist()
    reach, found, heap = [0] * len(d1), 0, [(d1[0] + d2[0], 0, 0)]
    while heap and found < enough:
        _, i, j = heapq.heappop(heap)
        found += held[i][j]
        reach[i] = j + 1
        if j + 1 < len(d2):
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(d1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    out = np.zeros(len(d1), np.uint16)
    out[by_first] = reach
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _coder(c1: np.ndarray, c2: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                half = c1.shape[1]
                cell = _nearest(x[:, :half], c1) * len(c2) + _nearest(x[:, half:], c2)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell.astype(np.int32))], ["id", "vec", "cell"])

    return run


def distances(x: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of queries to the centroids of both halves, rounded: a product's last bits depend on its place in the matrix."""
    half = c1.shape[1]
    return -np.round(x[:, :half] @ c1.T, 9), -np.round(x[:, half:] @ c2.T, 9)


def _truth(ids: np.ndarray, q: np.ndarray, k: int):
    """Arrow function from coded vectors to each sampled query's best k of the task, by brute force."""

    def run(batches):
        score, cells, seen = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int32), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                own, cell = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
                new = q @ _matrix(batch.column("vec")).T
                new[ids[:, None] == own[None, :]] = -np.inf
                score, cells, seen = (np.concatenate((a, np.broadcast_to(b, new.shape)), axis=1) for a, b in ((score, new), (cells, cell), (seen, own)))
                if score.shape[1] > k:
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, cells, seen = (np.take_along_axis(a, best, 1) for a in (score, cells, seen))
        n, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(score[n, at]), pa.array(cells[n, at]), pa.array(seen[n, at])], ["n", "score", "cell", "id"])

    return run


def budget(coded: DataFrame, asked: DataFrame, c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, k: int, recall: float, sample_queries: int) -> int:
    """Entries to visit so that ``recall`` of the sampled queries' true neighbours are among them."""
    picked = asked.orderBy(F.xxhash64("id"), "id").limit(sample_queries).select("id", "vec").toArrow()
    if not picked.num_rows:
        return k
    q = _matrix(picked.column("vec").combine_chunks())
    best = Window.partitionBy("n").orderBy(F.desc("score"), "id")
    true = coded.mapInArrow(_truth(picked.column("id").to_numpy(), q, k), "n int, score double, cell int, id long")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("n", "cell").toArrow()
    before = []
    for n, (d1, d2) in enumerate(zip(*distances(q, c1, c2), strict=True)):
        order = np.argsort((d1[:, None] + d2[None, :]).reshape(-1), kind="stable")
        met = np.empty(len(order), np.int64)
        met[order] = np.cumsum(counts[order]) - counts[order]
        before.append(met[true.column("cell").to_numpy()[true.column("n").to_numpy() == n]])
    before = np.concatenate(before)
    return max(k, int(np.quantile(before, recall, method="higher")) + 1) if len(before) else k


def _asker(c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, bounds: np.ndarray, enough: int):
    """Arrow function from query vectors to one row for each block in which a query visits a cell.

    ``bounds`` has, for each block, the first and past-the-last of its cells among those that hold
    vectors; ``visits`` has a bit for each of them.
    """
    table, filled = counts.reshape(len(c1), -1), np.flatnonzero(counts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                met = np.empty((part.num_rows, len(filled)), bool)
                for r, (d1, d2) in enumerate(zip(*distances(_matrix(part.column("vec")), c1, c2), strict=True)):
                    place = np.empty(len(d2), np.int64)
                    place[np.argsort(d2, kind="stable")] = np.arange(len(d2))
                    met[r] = (place[None, :] < visit(d1, d2, table, enough)[:, None]).reshape(-1)[filled]
                for block, (a, b) in enumerate(bounds):
                    rows = np.flatnonzero(met[:, a:b].any(axis=1))
                    if len(rows):
                        held = part.take(pa.array(rows))
                        bits = [x.tobytes() for x in np.packbits(met[rows, a:b], axis=1)]
                        columns = [pa.array(np.full(len(rows), block, np.int32)), held.column("id"), held.column("cell"), held.column("vec"), pa.array(bits, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["block", "id", "cell", "vec", "visits"])

    return run


def cell_scores(q: np.ndarray, v: np.ndarray, edges: np.ndarray, visits: np.ndarray):
    """(cell, its visitors, their inner products with its entries) for each visited cell of a block."""
    for c in np.flatnonzero(visits.any(axis=0)).tolist():
        rows = np.flatnonzero(visits[:, c])
        yield c, rows, q[rows] @ v[edges[c] : edges[c + 1]].T


def _best(q_ids: np.ndarray, q: np.ndarray, visits: np.ndarray, ids: np.ndarray, edges: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k of a block's visited entries for each query."""
    met = np.flatnonzero(visits.any(axis=0))
    size = edges[met + 1] - edges[met]
    place = dict(zip(met.tolist(), (np.cumsum(size) - size).tolist(), strict=True))
    at = np.concatenate([np.arange(edges[c], edges[c + 1]) for c in met.tolist()])
    score = np.full((len(q), len(at)), -np.inf)
    for c, rows, found in cell_scores(q, v, edges, visits):
        score[rows, place[c] : place[c] + found.shape[1]] = found
    score[q_ids[:, None] == ids[at][None, :]] = -np.inf
    cut = max(0, score.shape[1] - k)
    least = np.partition(score, cut, axis=1)[:, cut]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        # A product's last bits depend on its place in the matrix; ties need them equal.
        near = at[np.flatnonzero((score[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]) if np.isfinite(least[i]) else 1.0)) & (score[i] > -np.inf))]
        exact = (v[near] * q[i][None, :]).sum(axis=1)
        best = np.lexsort((ids[near], -exact))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_v.append(ids[near][best])
        out_s.append(exact[best])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])


def _ranker(k: int):
    """Arrow function over rows by block: its vectors by cell, then the queries that visit it."""

    def run(batches):
        key, parts, held = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("block", "salt", "kind")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key != tuple(marks[:2, a]):
                    key, parts, held = tuple(marks[:2, a]), [], None
                run_of = batch.slice(a, b - a)
                if marks[2, a] == 0:
                    parts.append((run_of.column("id").to_numpy(), run_of.column("cell").to_numpy(), _matrix(run_of.column("vec"))))
                    continue
                if held is None and parts:
                    ids, cells, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                    held, parts = (ids, np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)])), v), []
                if held is None:  # a part of a split cell that no vector fell into
                    continue
                for at in range(0, run_of.num_rows, QUERY_BLOCK):
                    asked = run_of.slice(at, QUERY_BLOCK)
                    bits = np.frombuffer(b"".join(asked.column("visits").to_pylist()), np.uint8).reshape(asked.num_rows, -1)
                    visits = np.unpackbits(bits, axis=1)[:, : len(held[1]) - 1].astype(bool)
                    yield _best(asked.column("id").to_numpy(), _matrix(asked.column("vec")), visits, *held, k)

    return run


def nearest(vectors: DataFrame, is_query: F.Column, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.94, share: float | None = None, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, sample_queries: int = SAMPLE_QUERIES) -> DataFrame:
    """The ``k`` largest inner products found for each query among all other vectors.

    ``is_query`` is a condition on ``id``.  A query visits cells until they hold as many entries as
    gave ``sample_queries`` sampled queries ``recall`` of their true neighbours, or ``share`` of all
    vectors where that is given.  Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``
    (double precision on the original vectors), nearest first, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    rows without an id or vectors of another length than most (the least length of equally many).
    Rows that repeat an id count once, with the least vector.  No vectors, or no queries, give no
    rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = cut_lineage(usable(vectors, id_col, vector))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes["d"], sizes["n"]
    rows = rows.where(F.size("vec") == dim)
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toArrow().column("vec").combine_chunks())
    half, many = max(1, dim // 2), max(1, min(centroids, len(sample) // 4, int(np.sqrt(total / 4))))
    c1 = codebook(sample[:, :half], many)
    c2 = codebook(sample[:, half:], many) if dim > half else np.zeros((1, 0))

    kind = rows.schema["vec"].dataType.simpleString()
    coded = cut_lineage(rows.mapInArrow(_coder(c1, c2), f"id long, vec {kind}, cell int"))
    counts, n_queries = np.zeros(len(c1) * len(c2), np.int64), 0
    for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).collect():
        counts[r["cell"]], n_queries = r["n"], n_queries + r["asked"]
    asked = coded.where(is_query)
    enough = max(k, int(share * total)) if share is not None else budget(coded, asked, c1, c2, counts, k, recall, sample_queries)
    salts = max(1, -(-n_queries // QUERIES_EACH))

    filled = np.flatnonzero(counts)
    splits = np.maximum(1, -(-counts[filled] // VECTOR_BLOCK))
    bounds: list[list[int]] = []
    first, room = np.zeros(len(filled), np.int32), 0
    for i, c in enumerate(filled):  # neighbouring cells share blocks; a crowded one has its own
        if splits[i] == 1 and counts[c] <= room:
            bounds[-1][1], room = i + 1, room - counts[c]
            first[i] = len(bounds) - 1
            continue
        first[i] = len(bounds)
        bounds += [[i, i + 1]] * splits[i] if splits[i] > 1 else [[i, i + 1]]
        room = 0 if splits[i] > 1 else VECTOR_BLOCK - counts[c]
    # One row for each cell that holds vectors, centroids**2 at most.
    places = F.broadcast(spark.createDataFrame(pa.table({"cell": pa.array(filled.astype(np.int32)), "first": pa.array(first), "splits": pa.array(splits)})))
    stored = coded.join(places, "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "id", "cell", "vec", F.lit(None).cast("binary").alias("visits"))
    going = asked.mapInArrow(_asker(c1, c2, counts, np.array(bounds), enough), f"block int, id long, cell int, vec {kind}, visits binary")
    going = going.select("block", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "cell", "vec", "visits")
    met = stored.unionByName(going).repartition(min(20_000, 2 * len(bounds) * salts), "block", "salt").sortWithinPartitions("block", "salt", "kind", "cell", "id")
    found = met.mapInArrow(_ranker(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
