import duckdb
import pandas as pd
import pytest

from tessera.llm import mixture, queries

SCHEMA = "doc_id long, text string, source string, Size int, times string"


def documents():
    rows = []
    for i in range(400):
        source = ["alpha", "beta", "é", "Zed", None, "", "gamma", "delta"][i % 8]
        rows.append((i, " ".join(["w"] * (1 + i * 37 % 90)) if i % 11 else "\t\n ", source, 1, "t"))
    rows += [(1000, "word " * 3000, "alpha", 1, "t"), (1001, None, "nul", 1, "t"), (1002, "", "nul", 1, "t"), (None, "a b c", "beta", 1, "t"), (None, "a b c d", "beta", 1, "t")]
    rows += [(2000 + i, "x y z", "tiny", 1, "t") for i in range(3)] + [(7, "again w", "beta", 1, "t"), (7, "again w", "beta", 1, "t")]
    return rows


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@pytest.fixture(scope="module")
def mix(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    return docs, mixture.mixture(docs, ["doc_id", "source"]).toPandas()


def test_targets_and_totals(mix):
    got = mix[1]
    assert len(got) == len(documents())
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    per = {}
    for s, size, total, target, taken in zip(got["source"], got["size"], got["source_size"], got["target"], got["taken"]):
        a = per.setdefault(s, [0, total, target, 0])
        a[0], a[3] = a[0] + size, a[3] + taken
    want = filled({s: a[0] for s, a in per.items()})
    for s, (size, total, target, taken) in per.items():
        assert size == total and target == pytest.approx(want[s])
        assert abs(taken - target) <= 0.02 * target + 3, s
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["times"] * got["size"]).all()
    assert got.loc[got["size"] == 0, "taken"].eq(0).all()


def test_sql_gives_the_same_rows(spark, mix, tmp_path):
    mix[0].drop("times").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.SQL["op1_mixture"]).df()
    got = queries.op1_mixture(spark, str(tmp_path)).toPandas()
    order = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want[got.columns].sort_values(order).reset_index(drop=True), check_dtype=False, rtol=1e-12)


def test_rows_repeat_as_often_as_taken(mix):
    docs, want = mix
    got = mixture.mixed(docs)
    assert got.columns == docs.columns
    times = want.loc[want["doc_id"] != 7].groupby("doc_id")["times"].sum()
    have = got.where("doc_id <> 7").groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert have.to_dict() == times[times > 0].to_dict()


def test_buckets_only_refine(spark, monkeypatch, mix):
    """Few bits a bucket, so that every level has work, give the same thresholds."""
    monkeypatch.setattr(mixture, "BITS", 2)
    again = mixture.mixture(mix[0], ["doc_id", "source"]).toPandas()
    order = ["doc_id", "source", "size"]
    pd.testing.assert_frame_equal(again.sort_values(order).reset_index(drop=True), mix[1].sort_values(order).reset_index(drop=True))


def test_sizes_of_many_tasks_are_kept_in_few_files(spark, monkeypatch, mix):
    cut, parts = mixture.cut_lineage, []

    def counted(df):
        parts.append((out := cut(df)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(mixture, "cut_lineage", counted)
    got = mixture.mixed(spark.createDataFrame(documents(), SCHEMA).repartition(40))
    assert max(parts) < 10
    assert sorted(map(str, got.collect())) == sorted(map(str, mixture.mixed(mix[0]).collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixture.mixture(empty, ["doc_id"]).count() == 0 and mixture.mixed(empty).count() == 0
