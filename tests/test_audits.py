"""Audits, overlays and parts of texts by hand."""

from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.operators import audits


def test_plain_text(spark):
    cases = {
        "<p>a&amp;b</p><script type=x>\nvar s</script><div>c <b>d</b><br/>e</div>": "a&b\nc d\ne",
        "&#65;&#x42; &#x1F600;&#xD800;&#0;&#99999999;": "AB \U0001f600&#xD800;&#0;&#99999999;",
        "&lt;i&gt; &quot;x&quot; &#39;y&apos;&nbsp;z": "<i> \"x\" 'y' z",
        "": "",
        None: "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "html string, want string").select("want", audits.plain_text(F.col("html")).alias("got")).collect()
    for r in rows:
        assert r.got == r.want


def test_rich_text(spark):
    cases = {'{"root":{"children":[{"text":"a"},{"children":[{"text":"b"},{"text":""}]},5]}}': "a\nb", '"s"': "s", "{": "", None: "", '["x",["y"]]': "x\ny"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "doc string, want string").select("want", audits.rich_text(F.col("doc")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_workflow_artifacts(spark):
    rows = spark.createDataFrame([("p/x.json", None, "", " "), ("p/x.json", "t", None, None), ("p/y.json", None, None, None), (None, None, None, None)], "p string, t string, i string, u string")
    found = rows.select(audits.workflow_artifact(F.col("p"), F.col("t"), F.col("i"), F.col("u"), "p/x.json").alias("is")).collect()
    assert [r["is"] for r in found] == [True, False, False, False]


def test_empty_tables_and_nulls(spark):
    works = spark.createDataFrame([(1, None, None, None, None, None, None), (2, None, None, "", [], [], None)], "id long, media_group string, media_type string, primary string, titles array<string>, source_keys array<string>, score int")
    assert audits.duplicate_groups(works, "id", ["iso"]).count() == 0
    refs = spark.createDataFrame([(1, None, None), (2, ["k"], "n")], "r long, keys array<string>, name string")
    entries = spark.createDataFrame([], "e long, keys array<string>, name string")
    assert {r.matched_by for r in audits.reference_links(refs, entries, "r", "e").collect()} == {"missing"}


def test_fingerprints_count_repeats(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b string")
    same = lambda x, y: audits.same_contents(frame(x), frame(y), ["a", "b"]).first()["same"]
    assert same([(1, "x"), (2, None)], [(2, None), (1, "x")]) and same([], [])
    assert not same([(1, "x"), (1, "x")], [(1, "x")]) and not same([(1, None)], [(1, "")])
    assert not same([(1, "x"), (1, "x"), (2, "y")], [(1, "x"), (2, "y"), (2, "y")])


def test_badly_decoded(spark):
    rows = spark.createDataFrame([("Ã©tÃ© Ã ",), ("été à la plage",), (None,), ("",)], "t string")
    assert [r.g for r in rows.select(keys.badly_decoded(F.col("t")).alias("g")).collect()] == [True, False, False, False]


def test_duplicate_groups_deals_works_before_their_claims(spark):
    k = F.col("id")
    works = spark.range(0, 60_000, 1, 1).select("id", F.lit("m").alias("media_group"), F.lit("").alias("media_type"), F.lit("").alias("primary"), F.array().cast("array<string>").alias("titles"), F.array(F.concat(F.lit("iso:"), F.floor(k / 2).cast("string"))).alias("source_keys"), F.lit(0).alias("score"))
    found = audits.duplicate_groups(works, "id", ["iso"])
    assert "hashpartitioning(id" in (plan := found._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan
    assert found.count() == 30_000
