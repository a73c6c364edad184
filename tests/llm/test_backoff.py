"""Backoff scores against a recursive model over whole dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import backoff

SCHEMA = "doc_id long, text string, keep boolean"


def tokens(text):
    return [*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")), None]


class Model:
    def __init__(self, texts, order):
        self.counts = [None, *(defaultdict(Counter) for _ in range(order))]
        for text in texts:
            t = tokens(text)
            for i, w in enumerate(t):
                for k in range(1, order + 1):
                    self.counts[k][tuple(t[j] if j >= 0 else "<" for j in range(i - k + 1, i))][w] += 1
        self.rates = [None, *(backoff.discounts([sum(n == r for c in self.counts[k].values() for n in c.values()) for r in range(1, 7)]) for k in range(1, order + 1))]
        self.words, self.weight, self.kept = self.counts[1][()], {}, {}

    def p(self, w, h):
        k = len(h) + 1
        if h not in self.kept:
            own, rate = self.counts[k].get(h, Counter()), self.rates[k]
            total, held = sum(own.values()), sum((1 - rate[n]) * n for n in own.values() if n <= 5)
            base = total if held > 0 else total + 1
            self.kept[h] = own, {x: n * rate[min(n, 6)] for x, n in own.items()}, total, base, (held if held > 0 else 1) / base
        own, kept, total, base, left = self.kept[h]
        if not h:
            return kept[w] / base if w in own else left
        if not total:
            return self.p(w, h[1:])
        if w in own:
            return kept[w] / base
        if h not in self.weight:
            self.weight[h] = left / (1 - sum(self.p(x, h[1:]) for x in own))
        return self.weight[h] * self.p(w, h[1:])

    def score(self, text, order):
        t = tokens(text)
        return sum(math.log10(self.p(w, tuple(t[j] if j >= 0 else "<" for j in range(i - order + 1, i)))) for i, w in enumerate(t))


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "été", "É", "x\x00y", "\xa0", "日本", "z" * 50] + [f"w{i}" for i in range(25)]
    text = lambda: rng.choice([" ", "\n", "  "]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 30)))
    return [(i, rng.choice([None, "", " "]) if rng.random() < 0.05 else text(), rng.random() < 0.8) for i in range(n)]


def expected(rows, order):
    train = [t for _, t, keep in rows if keep]
    model, words = Model(train, order), Counter(w for t in train for w in tokens(t))
    total = sum(words.values())
    base = lambda t: sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in tokens(t))
    return sorted(((i is None, i or 0), bool(keep), len(tokens(t)), sum(w in words for w in tokens(t)), total, base(t), model.score(t, order)) for i, t, keep in rows)


def found(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect())


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("order, block, part, hot", [(1, 1 << 25, 1 << 24, 1 << 18), (2, 1 << 25, 1 << 24, 1 << 18), (2, 500, 300, 5), (3, 500, 300, 5)])
def test_equals_the_recursion(spark, monkeypatch, order, block, part, hot):
    for name, value in (("BLOCK_BYTES", block), ("PART_BYTES", part), ("HOT_CONTEXT", hot)):
        monkeypatch.setattr(backoff, name, value)
    rows = corpus(150, 3)
    rows += [*rows[:5], (None, "the of the", True), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS at", "3 AS score").repartition(3)
    same(found(backoff.scored(docs, ["doc_id"], F.col("keep"), order=order)), expected(rows, order))


@pytest.mark.parametrize("order", [2, 3])
def test_every_context_sums_to_one(order):
    rows = corpus(60, 9)
    model = Model([t for _, t, keep in rows if keep], order)
    for h in [*list(model.counts[order])[:40], *(("no", "such")[: order - 1],)]:
        assert math.isclose(sum(model.p(w, h) for w in [*model.words, "never seen"]), 1, rel_tol=1e-9)


def test_discounts_fit_odd_counts():
    for tally in ([0] * 6, [5, 0, 0, 0, 0, 0], [0, 7, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6], [100, 40, 20, 12, 8, 6]):
        rate = backoff.discounts(tally)
        assert all(0 < x < 1 for x in rate[1:6]) and rate[6] == 1
    assert math.isclose(rate[1], (2 * 40 / 100 - 6 * 6 / 100) / (1 - 6 * 6 / 100))


def test_no_training_texts_repeats_alone_and_empty_tables(spark):
    rows = [(1, "a b", False), (2, None, None)]
    same(found(backoff.scored(spark.createDataFrame(rows, SCHEMA), ["doc_id"], F.col("keep"))), expected(rows, 2))
    rows = [(i, "a a a a a a a a", True) for i in range(9)] + [(99, "b a c", False)]
    same(found(backoff.scored(spark.createDataFrame(rows, SCHEMA), ["doc_id"], F.col("keep"))), expected(rows, 2))
    assert backoff.scored(spark.createDataFrame([], SCHEMA), ["doc_id"], F.col("keep")).count() == 0


def test_a_long_text(spark):
    rows = [(1, " ".join(f"w{i % 997}" for i in range(300_000)), True), (2, "w1 w2 w3 w5", False)]
    got = found(backoff.scored(spark.createDataFrame(rows, SCHEMA), ["doc_id"], F.col("keep")))
    same(got, expected(rows, 2))
    assert got[1][6] > -20
