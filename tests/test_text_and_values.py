import datetime as dt
import hashlib
import hmac
import random
import sys
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, values


def column(spark, values_, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values_], f"x {kind}").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("name", "given", "want"),
    [
        ("merge_title", "Ａ b-c！　「d」", "abcd"),
        ("identity_title", " A b-C﻿", "ab-c"),
        ("descriptive", "  A 　 b\tc ", "a b c"),
        ("match_title", "Name (Season 2) ・x", "namex"),
        ("ingest_title", "「A」 b_c–d", "a b c d"),
        ("merge_plan_title", "A 《b》~c", "abc"),
        ("duplicate_title", "A・b <c>", "abc"),
        ("summary", "A, b! ＋c", "abc"),
        ("identity_part", "A\u0007  b", "a b"),
        ("alnum_title", "A_b 1!", "ab1"),
        ("volume_title", "Name （12）", "name"),
        ("payload_title", "A-b （c）", "abc"),
    ],
)
def test_keys(spark, name, given, want):
    assert column(spark, [given, None, ""], lambda c: text.key(name, c)) == [want, "", ""]


def test_slugs_urls_and_lists(spark):
    assert column(spark, ["Crème  Brûlée!", "日本 2", "!!", None], text.slug) == ["creme-brulee", "日本-2", "item", "item"]
    assert column(spark, ["https://www.Ex.org/A/b/?q#f", "HTTP://ex.org:80", None], text.url_key) == ["ex.org/A/b", "ex.org", ""]
    assert column(spark, ["a; b|c,,\nd", None], text.split_list) == [["a", "b", "c", "d"], []]
    assert column(spark, ["x12y3", "v2", "10", None], text.natural_key) == ["x000000000012y000000000003", "v000000000002", "000000000010", ""]
    assert column(spark, ["in 1999.", "12345", "1799 2001"], text.year_of) == [1999, None, 2001]
    assert column(spark, ["漢字test", "abc"], text.has_cjk) == [True, False]
    assert column(spark, ["漢字学"], text.han_grams) == [["漢字", "字学", "漢字学"]]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abcdef"), ("abc", "abcdef"), ("ab", "bc"), ("", "a")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(text.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, round(4 / 6, 6), 0.5, round(1 / 3, 6), 0.0]


def test_fuzzy_dates(spark):
    got = [tuple(r) for r in column(spark, ["2018-10-05", "2015-04", "2015", "TBA", "2018-02-30", " 未定", None, "x"], values.fuzzy_date)]
    assert got == [("2018-10-05", "day", "2018-10-05"), ("2015-04-01", "month", "2015-04"), ("2015-01-01", "year", "2015"), (None, "unknown", "TBA"), (None, "unknown", "2018-02-30"), (None, "unknown", "未定"), (None, "unknown", ""), (None, "unknown", "x")]


def test_scalars(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 999500)
    assert column(spark, [at], lambda c: F.unix_millis(values.round_to_millis(c)), "timestamp") == [1704067201000]
    assert column(spark, [0.4, 40.0, None, -1.0], values.confidence, "double") == [0.4, 0.4, 0.0, 0.0]
    assert column(spark, [101.0, -3.0, 49.5], values.percent, "double") == [100, 0, 50]
    assert column(spark, ['{"b":1,"a":[2, {"d":1,"c":2}]}', "x", None], values.canonical_json) == ['{"a":[2,{"c":2,"d":1}],"b":1}', None, None]
    assert column(spark, ["1.2.3.4", "2001:db8::1", "no"], values.network_prefix) == ["1.2.3.0/24", "2001:db8::/64", None]
    assert column(spark, ["", "a"], values.fnv1a) == ["811c9dc5", "e40c292c"]
    assert column(spark, ["m"], lambda c: values.hmac_sha256(c, "k")) == [hmac.new(b"k", b"m", hashlib.sha256).hexdigest()]


def test_only_texts_that_composition_changes_go_to_python(spark):
    rng = random.Random(5)
    changed = ["é", "ﬁ", "가", "が", "Å", "ো", "①", "q̣̇", "힣", "x" * 9, "é", "日本", "ß", "ж", "😀", " "]
    texts = [None, "", *changed, *("".join(rng.choice(changed) for _ in range(6)) for _ in range(300)), *map(chr, range(0x80, 0x3400))]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert all(r.got == (r.t and unicodedata.normalize("NFKC", r.t)) for r in rows.select("t", text.nfkc(F.col("t")).alias("got")).collect())
    sent = rows.where(F.col("t").rlike(text._changeable()))
    assert not {"é", "日本", "ß", "ж", "😀", "힣"} & {r.t for r in sent.collect()}


def test_the_search_for_changeable_characters_does_not_try_every_range(spark):
    """4 million characters of Latin text; a class that tries its ranges one by one takes ten times as long."""
    rows = spark.range(40).select(F.expr("repeat(concat('plain words, caf', char(233), ' and so on; '), 3500)").alias("t")).coalesce(1).cache()
    rows.count()

    def seconds(pattern):
        best = 9e9
        for _ in range(2):
            start = time.perf_counter()
            assert rows.where(F.col("t").rlike(pattern)).count() == 0
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(text._changeable()) < 5 * seconds(r"[\x{3400}-\x{3401}]") + 1


def test_changeable_characters_are_those_of_unicode(spark):
    alone = [chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    found = {r.t for r in spark.createDataFrame([(x,) for x in alone], "t string").where(F.col("t").rlike(text._changeable())).collect()}
    assert all(x in found for x in alone if unicodedata.normalize("NFKC", x) != x or unicodedata.combining(x))
    seconds = {chr(int(parts[1], 16)) for x in alone if len(parts := unicodedata.decomposition(x).split()) == 2 and parts[0][0] != "<"}
    assert not {x for x in found if unicodedata.normalize("NFKC", x) == x and not unicodedata.combining(x)} - seconds - set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
