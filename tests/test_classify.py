import random

from pyspark.sql import functions as F

from tessera.operators import classify, entity, matching, survivorship


def test_page_categories(spark):
    rows = [
        ("Main", "Page", "ann", "漢" * 130, False, 0),
        ("XWiki", "ann", "ann", "short", False, 0),
        ("Sandbox", "X", "ann", "buy casino http://a http://b", False, 0),
        ("Main", "BlogClass", "ann", "x" * 900, False, 0),
        ("Main", "Y", "guest1", "hi", False, 0),
        ("Main", "Z", "ann", None, None, None),
        ("Main", "W", "ann", "hi", False, 2),
    ]
    df = spark.createDataFrame(rows, "web string, name string, author string, content string, hidden boolean, attachments int")
    got = classify.page_category(df, system_spaces=("Admin",), system_pages=("WebHome",), spam_words=("casino",), home="XWiki").collect()
    assert [r["category"] for r in got] == ["candidate_user_content", "candidate_system_page", "candidate_spam_or_junk", "candidate_system_page", "candidate_spam_or_junk", "needs_review", "candidate_user_content"]
    assert got[2]["reasons"] == ["spam_keywords:casino"] and got[3]["reasons"] == ["system_page_name", "long_content"]


def test_parents_tags_and_series(spark):
    df = spark.createDataFrame([("Name vol. 3",), ("Name 第2巻",), ("Name",), ("",)], "t string")
    assert [r[0] for r in df.select(classify.parent_title(F.col("t"))).collect()] == ["Name", "Name", "", ""]
    df = spark.createDataFrame([(["x"], ["k", "z"]), (None, None)], "e array<string>, c array<string>")
    assert [r[0] for r in df.select(classify.tags(F.col("e"), F.col("c"), {"k": ["y", "x"]})).collect()] == [["x", "y"], []]
    df = spark.createDataFrame([("Name Season 2 OVA",), ("OVA",), (None,)], "t string")
    assert [r[0] for r in df.select(survivorship.series_base(F.col("t"), [r"(?i)\s*ova$", r"(?i)\s*season \d+$"])).collect()] == ["Name", "OVA", ""]


def test_zipped_and_matches(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, k string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "n int, k string")
    assert [r["aligned"] for r in matching.zipped(a, b, "n", "k").orderBy("n").collect()] == [True, False, False]
