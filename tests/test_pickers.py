"""Pickers of source records, and pages of a creator's works in a locale's order."""

import json

from pyspark.sql import functions as F

from tessera import file_queries
from tessera.operators import creators
from tessera.sources import pickers


def test_fields_of_each_source(spark):
    records = [
        ("bangumi", {"name_cn": " ", "name": "N  1", "id": 7, "aliases": "a; b|a", "date": "2001-02", "staff": [{"name": "S"}, "T"], "url": "https://bgm.tv/subject/9"}),
        ("bangumi", {"subject": {"name_cn": "C", "id": "12"}, "names": ["x", {"value": "y"}], "links": ["see https://bgm.tv/subject/9"]}),
        ("bangumi", {"subject": {"name": "only"}, "note": "https://chii.in/subject/44"}),
        ("anilist", {"title": {"romaji": "R", "native": "日本"}, "media.id": 5, "startDate": {"year": 2010, "month": 3, "day": None}, "author": "A"}),
        ("anilist", {"title.english": "flat", "startDate": {"year": 2011, "month": 4, "day": 5}, "synonyms": []}),
        ("vndb", {"title": "T", "vid": "17", "original": "O", "developers": ["D", "D"]}),
        ("other", {"label": "L", "external_id": "e", "year": 1999}),
        ("other", "text"),
        (None, None),
    ]
    rows = [(i, s, json.dumps(r) if isinstance(r, dict) else r) for i, (s, r) in enumerate(records)]
    got = pickers.picked(spark.createDataFrame(rows, "i int, source string, doc string"), "doc", "source").orderBy("i").collect()
    assert [r["title"] for r in got] == ["N 1", "C", "only", "R", "flat", "T", "L", None, None]
    assert [r["source_id"] for r in got] == ["7", "12", "44", "5", None, "v17", "e", None, None]
    assert [r["aliases"] for r in got] == [["a", "b"], ["x", "y"], [], ["日本"], [], ["O"], [], [], []]
    assert [r["release_date"] for r in got] == ["2001-02", None, None, "2010-03", "2011-04-05", None, "1999", None, None]
    assert [r["creators"] for r in got] == [["S", "T"], [], [], ["A"], [], ["D"], [], [], []]
    assert [r["source_url"] for r in got][:2] == ["https://bgm.tv/subject/9", None]


def test_pages_follow_the_locale(spark):
    works = [(1, "2001", "中", "1"), (1, "2001", "阿", "2"), (1, "2001", "b", "3"), (1, "2001", "B", "4"), (1, "2002-05", "z", "5"), (1, None, "a", "6"), (1, "2002-07", "y", "7"), (2, None, "q", "10"), (2, None, "q", "9")]
    df = spark.createDataFrame(works, "creator int, date string, title string, id string").repartition(3)
    page = lambda **o: [(r["creator"], r["place"], r["id"], r["total"], r["all_total"], r["years"]) for r in creators.creator_page(df, "creator", F.col("date"), F.col("title"), F.col("id"), **o).orderBy("creator", "place").collect()]
    assert [x[2] for x in page() if x[0] == 1] == ["7", "5", "2", "1", "3", "4", "6"]  # Han by sound, before Latin
    assert page(year="2001", offset=1, limit=2) == [(1, 2, "1", 4, 7, ["2002", "2001", "unknown"]), (1, 3, "3", 4, 7, ["2002", "2001", "unknown"])]
    assert [(x[1], x[2], x[3]) for x in page(year="unknown") if x[0] == 2] == [(1, "9", 2), (2, "10", 2)]
    assert page(year="1900") == []


def test_a_large_row_group_is_picked_by_several_tasks(spark, tmp_path):
    k = F.col("id")
    part = spark.range(60_000).select(k.alias("p_partkey"), F.lit("a  b").alias("p_name"), F.lit("Brand").alias("p_brand"), F.lit("TYPE").alias("p_type"), (k % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = file_queries.picked_sources(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    assert found.count() == 60_000
