import random

from pyspark.sql import functions as F

from tessera.operators.survivorship import series_base
from tessera.operators.validation import anchors


def test_anchors_of_very_many_lengths(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc ") for _ in range(n)).strip() for n in range(1, 700)} - {""})
    titles = [(i, rng.choice(["", "x ", "aa"]) + rng.choice(names) + rng.choice(["", " y", "bb"])) for i in range(300)] + [(900, None), (901, "")]
    got = anchors(spark.createDataFrame(titles, "id int, t string"), spark.createDataFrame([(n, n) for n in names + names[:5]], "a string, n string"), "id", F.col("t"), "a", "n").collect()
    want = {}
    for i, t in titles:
        met = [n for n in names if t and (n == t or len(n) >= 5 and n in t)]
        if met:
            want[i] = (max(map(len, met)), len(met), t in met)
    assert {r["id"]: (len(r["anchor"]), r["n"], r["equal"]) for r in got} == want
    assert len({len(n) for n in names}) > 400


def test_suffixes_go_until_none_is_left(spark):
    title = "Tale" + " II" * 9 + ": side" * 3
    row = spark.range(1).select(series_base(F.lit(title), [r" II$", r" side$"]).alias("a"), series_base(F.lit(" II"), [r"II$"]).alias("b"), series_base(F.lit(None).cast("string"), [r"x$"]).alias("c")).first()
    assert tuple(row) == ("Tale", "II", "")


def test_anchors_broadcast_nothing_that_grows(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("large title "), (F.col("id") % 3).cast("string")).alias("t"))
    got = anchors(rows, spark.createDataFrame([("large", "large"), ("title", "title"), ("tit", "tit")], "a string, n string"), "id", F.col("t"), "a", "n")
    assert {(r["anchor"] in ("large", "title"), r["n"], r["equal"]) for r in got.collect()} == {(True, 2, False)} and got.count() == 300
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
