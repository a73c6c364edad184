from pyspark.sql import functions as F

from tessera.operators.skew import join_facts


def test_same_rows_as_a_plain_join(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5, "x") for i in range(200)], "i long, k long, Hash_Of_Key string")
    facts = rows.where("k <> 3").groupBy("k").agg(F.sum("i").alias("total"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = join_facts(rows, facts, "k", how), rows.join(facts, "k", how)
        assert set(got.columns) == set(want.columns)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_an_aggregate_does_not_pin_the_key(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_facts(rows, rows.groupBy("k").agg(F.count("*").alias("n")), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(hash_of_key") == 2


def test_pairs_are_cut_by_their_number(spark):
    from tessera.operators import matching
    from tessera.operators.skew import join_by_work

    left = spark.createDataFrame([(i, "hot" if i < 300 else f"k{i}") for i in range(320)], "a int, k string")
    right = spark.createDataFrame([(i, "hot" if i < 40 else f"k{i + 260}") for i in range(60)], "b int, k string")
    for x, y in ((left, right), (right, left)):
        met = join_by_work(x, y, ["k"], most=500)
        assert sorted(tuple(r) for r in met.select("a", "b").collect()) == sorted((a, b) for a, k in left.collect() for b, m in right.collect() if k == m)
        sizes = met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) == 25 and max(sizes) < 4000  # one task had all 12000 pairs of the hot key
    both = spark.createDataFrame([(1, ["x", "y", None, ""]), (2, ["y"]), (2, ["x"])], "a int, k array<string>")
    other = spark.createDataFrame([(7, ["y", "x"]), (8, ["", None])], "b int, k array<string>")
    assert sorted(tuple(r) for r in matching.any_key_matches(both, other, "a", "b", F.col("k"), F.col("k")).collect()) == [(1, 7), (2, 7)]
