import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language

STEMS = {"aa": ["the", "and", "ing", "tion", "er", "of"], "bb": ["der", "und", "sch", "keit", "ä", "zu"], "cc": ["que", "la", "eau", "ment", "é", "les"], "dd": ["ción", "los", "ado", "ñ", "el", "por"]}


def corpus(n=240):
    rng, rows = random.Random(4), []
    for i in range(n):
        name = rng.choice(list(STEMS))
        words = [rng.choice(STEMS[name]) + rng.choice(["", rng.choice(STEMS[name])]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), name, "x"))
    return rows


SCHEMA = "doc_id long, text string, lang string, Score string"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 20, 60])
def test_codewords_correct_errors(n):
    code = language.codewords(n)
    assert (np.abs(code.sum(axis=0)) < n).all()  # every bit splits the languages
    between = (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(n, dtype=bool)]
    assert between.min() >= (1 if n == 2 else 2 if n == 3 else 3)


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    known = language.fit(docs.where(~language.held_out()), "lang", "text", F.col("doc_id").cast("string"))
    got = language.predict(docs.select("doc_id", "lang", language.held_out().alias("held_out"), "text"), known).collect()
    assert len(got) == 240 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_one_wrong_bit_is_outvoted():
    code = language.codewords(4)
    rng = np.random.default_rng(1)
    tables = rng.integers(0, 3, (4, len(language.SIZES), language.BUCKETS)).astype(float)
    known = language.model(list("abcd"), tables)
    for i in range(4):
        for bit in range(code.shape[1]):
            margins = code[i].astype(float)
            margins[bit] *= -1
            known.margins = lambda text, m=margins: m
            assert known.decide(b"", 6.0)[0] == "abcd"[i]


def test_windows_cover_each_ngram_once(monkeypatch):
    text = language._prepared("Ünïcode words, and 12 more " * 40)
    whole = [np.sort(x) for x in language.grams(text)]
    monkeypatch.setattr(language, "WINDOW", 64)
    parts = [[], [], []]
    for window, own in language._windows(text):
        for k, at in enumerate(language.grams(window)):
            parts[k].append(at[:own])
    for k in range(3):
        assert (np.sort(np.concatenate(parts[k])) == whole[k]).all()


def test_odd_rows(spark):
    rows = corpus(60) + [(900, None, "aa", None), (901, "", "bb", None), (902, "12 34 !?", None, None), (None, "the and tion of", None, "q"), (903, "the and tion of", "aa", None), (903, "the and tion of", "aa", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = language.fit(docs, "lang", "text", F.col("doc_id").cast("string"))
    got = language.predict(docs.select("doc_id", "text"), known).collect()
    assert len(got) == 66
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (900, 901, 902)] == [("und", 0.0)] * 3
    assert {r["lang_pred"] for r in got if r["doc_id"] in (903, None)} == {"aa"}
    kept = language.identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id between 900 and 902").count() == 0 and kept.count() == 63


def test_no_rows_no_labels_one_label(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identified(empty).count() == 0
    bare = spark.createDataFrame([(1, "text here", None, None)], SCHEMA)
    known = language.fit(bare, "lang", "text", F.col("doc_id").cast("string"))
    assert language.predict(bare.select("doc_id", "text"), known).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(1, "text here", "xx", None)], SCHEMA)
    known = language.fit(one, "lang", "text", F.col("doc_id").cast("string"))
    assert tuple(language.predict(one.select("doc_id", "text"), known).first()) == (1, "xx", 1.0, False)


def test_decisions_equal_a_plain_decoder():
    """Margins gram by gram, losses code by code, without arrays."""
    import math
    import random

    rng = random.Random(3)
    for n in (2, 3, 5, 9):
        tables = np.array([[[rng.choice([0, 0, 1, 9]) for _ in range(language.BUCKETS)] for _ in language.SIZES] for _ in range(n)], float)
        known = language.model([f"l{i}" for i in range(n)], tables)
        for _ in range(6):
            text = language._prepared("".join(rng.choice("abc d\u00e9") for _ in range(rng.randint(1, 60))))
            total, grams = [0.0] * known.code.shape[1], 0
            for k, size in enumerate(language.SIZES):
                for at in range(len(text) - size + 1):
                    value = text[at]
                    for c in text[at + 1 : at + size]:
                        value = (value * 0x01000193 & 0xFFFFFFFF) ^ c
                    bucket = (value * 0x9E3779B1 & 0xFFFFFFFF) >> 17
                    grams += 1
                    total = [t + float(known.odds[k, bucket, b]) for b, t in enumerate(total)]
            losses = [sum(float(known.weight[b]) * math.log1p(math.exp(-float(known.code[i, b]) * 6.0 * total[b] / max(grams, 1))) for b in range(len(total))) for i in range(n)]
            belief = [math.exp(min(losses) - x) for x in losses]
            order = sorted(range(n), key=lambda i: (-belief[i], i))
            name, score, lead = known.decide(text, 6.0)
            assert name == f"l{order[0]}" or math.isclose(belief[order[0]], belief[known.languages.index(name)], rel_tol=1e-4)
            assert math.isclose(score, belief[order[0]] / sum(belief), rel_tol=1e-3)
