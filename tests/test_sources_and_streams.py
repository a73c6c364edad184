import datetime as dt
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, rules
from tessera.plans import release
from tessera.sources import readers, writers
from tessera.streaming import intake


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n{"id": 2}\n', encoding="utf-8")
    good, bad = readers.jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert sorted((r["id"], r["t"]) for r in good.collect()) == [(1, "x"), (2, None)]
    assert [r["line"] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id long, t string").collect()
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": 3}\n')
    assert readers.jsonl(spark, str(tmp_path / "b.jsonl.gz"), "id long").first()["id"] == 3


def test_csv_containers_and_integrity(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a ""q"", b",\nc,"d\ne"\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "a.csv")).collect()] == [('a "q", b', ""), ("c", "d\ne")]
    docs = spark.createDataFrame([(1, '{"rows": [{"a": 1}, {"a": 2}]}'), (2, "[3]"), (3, '{"a": 9}')], "id int, body string")
    assert [(r["id"], r["row_index"], r["body"]) for r in readers.unwrapped(docs, "body").orderBy("id", "row_index").collect()] == [(1, 0, '{"a":1}'), (1, 1, '{"a":2}'), (2, 0, "3"), (3, 0, '{"a":9}')]
    body = (tmp_path / "a.csv").read_bytes()
    assert tuple(readers.integrity(spark, str(tmp_path / "a.csv")).first()) == ("a.csv", len(body), 4, hashlib.sha256(body).hexdigest())
    assert [r["path"].rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path)).collect()] == ["a.csv"]


def test_sql_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- x\nCREATE TABLE t (a int);\nINSERT INTO `t` VALUES (1,'a''b\\n(c), d',NULL),(2,'e',3.5);\ninsert into u (q) values ('z');\nINSERT INTO v VALUES (1);\n", encoding="utf-8")
    got = readers.sql_dump(spark, str(tmp_path / "d.sql"), {"t": ["a", "b", "c"], "u": ["q"]}).collect()
    assert sorted((r["table"], r["row_index"], r["values"]) for r in got) == [("t", 0, {"a": "1", "b": "a'b\n(c), d"}), ("t", 1, {"a": "2", "b": "e", "c": "3.5"}), ("u", 0, {"q": "z"})]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, items array<string>")
    writers.write_jsonl(df, str(tmp_path / "j"), gzip=True)
    assert readers.jsonl(spark, str(tmp_path / "j"), "id int, items array<string>").count() == 2
    assert [tuple(r) for r in writers.children(df, "id", "items").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert "| 1 |" in writers.report({"ids": df.select("id")}, "Report")
    writers.write_split(df, str(tmp_path / "s"), F.when(F.size("items") > 0, "some").otherwise("none"))
    assert sorted(p.name for p in (tmp_path / "s").glob("part=*")) == ["part=none", "part=some"]


START = dt.datetime(2024, 1, 1)


def events():
    return [(i, f"u{i % 3}", START + dt.timedelta(minutes=7 * i), f"h{i % 5}") for i in range(60)]


def stream(spark, tmp_path, rows, schema):
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


SCHEMA = "event_id long, user string, ts timestamp, hash string"


def test_admission_stream_equals_batch(spark, tmp_path):
    df = stream(spark, tmp_path, events(), SCHEMA)
    got = {r["tie_of"]: r["admitted"] for r in run(intake.admitted_stream(df, "user", "ts", "event_id", 2), "admitted")}
    batch = intake.capped(spark.createDataFrame(events(), SCHEMA), "ts", "event_id", [intake.Cap(2, ("user",), "hour")])
    assert got == {r["event_id"]: r["admitted"] for r in batch.collect()}


def test_duplicates_within_the_horizon_go(spark, tmp_path):
    df = stream(spark, tmp_path, events(), SCHEMA)
    got = {r["event_id"] for r in run(intake.deduplicated_stream(df, ["hash"], "ts", "30 days"), "deduplicated")}
    assert got == {0, 1, 2, 3, 4}
    batch = intake.first_within(spark.createDataFrame(events(), SCHEMA), ["hash"], "ts", "event_id", "30 DAYS")
    assert {r["event_id"] for r in batch.collect()} == got


def simulated(rows, caps, horizon=None):
    """One event at a time against a list of what was accepted. rows: (id, time, keys, closed)."""
    held, out = [], {}
    for i, t, keys, closed in sorted(rows, key=lambda r: (r[1], r[0])):
        reason = "closed" if closed else None
        for cap in caps:
            same = [x for x, k in held if all(k[c] == keys[c] for c in cap.keys)]
            if cap.unit:
                same = [x for x in same if x.date() == t.date() and (cap.unit == "day" or x.hour == t.hour)]
            else:
                same = [x for x in same if x >= t - dt.timedelta(hours=int(cap.span.split()[0]))]
            if reason is None and len(same) >= cap.limit:
                reason = cap.reason
        if reason is None:
            held.append((t, keys))
        out[i] = reason
    return out


def test_refused_attempts_count_nowhere(spark):
    rng = random.Random(4)
    rows = [(i, START + dt.timedelta(minutes=rng.randint(0, 3000)), {"ip": rng.randint(0, 6), "net": rng.randint(0, 2), "hash": rng.randint(0, 40)}, rng.random() < 0.05) for i in range(400)]
    caps = [intake.Cap(1, ("hash",), span="9 HOURS", name="duplicate"), intake.Cap(2, ("ip",), "hour"), intake.Cap(3, ("net",), "hour"), intake.Cap(60, (), "day"), intake.Cap(50, (), span="24 HOURS", name="stored")]
    df = spark.createDataFrame([(i, t, k["ip"], k["net"], k["hash"], c) for i, t, k, c in rows], "row long, ts timestamp, ip int, net int, hash int, closed boolean").repartition(3)
    got = {r["row"]: (r["reason"], r["admitted"]) for r in intake.capped(df, "ts", "row", caps, F.col("closed")).collect()}
    want = simulated(rows, caps)
    assert got == {i: (r, r is None) for i, r in want.items()} and len({r for r in want.values()}) >= 5
    three = spark.createDataFrame([(1, START, "a", "n"), (2, START, "a", "n"), (3, START, "b", "n")], "id int, ts timestamp, ip string, net string")
    small = intake.capped(three, "ts", "id", [intake.Cap(1, ("ip",), "hour"), intake.Cap(2, ("net",), "hour")])
    assert {r["id"] for r in small.where("admitted").collect()} == {1, 3}
    assert intake.capped(three.limit(0), "ts", "id", caps[1:2]).count() == 0


def test_refused_repeats_extend_no_horizon(spark):
    hours = [(i, "k", START + dt.timedelta(hours=i)) for i in range(7)]
    got = intake.first_within(spark.createDataFrame(hours, "id int, key string, ts timestamp"), ["key"], "ts", "id", "2 HOURS")
    assert {r["id"] for r in got.collect()} == {0, 3, 6}
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), START + dt.timedelta(minutes=rng.randint(0, 900))) for i in range(300)]
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t > last[k] + dt.timedelta(minutes=25):
            want.add(i)
            last[k] = t
    got = intake.first_within(spark.createDataFrame(rows, "id int, key string, ts timestamp").repartition(3), ["key"], "ts", "id", "25 MINUTES")
    assert {r["id"] for r in got.collect()} == want and got.columns == ["id", "key", "ts"]


def test_kill_switch(spark):
    e = spark.createDataFrame([(i, START + dt.timedelta(hours=11 * i)) for i in range(10)], "id int, ts timestamp")
    s = spark.createDataFrame([(100, START + dt.timedelta(hours=20), True), (101, START + dt.timedelta(hours=77), False)], "id int, ts timestamp, disabled boolean")
    got = {r["id"]: r["closed"] for r in intake.switched_off(e, s, "ts", "id").collect()}
    assert got == {i: 20 <= 11 * i < 77 for i in range(10)}


def test_inbox_in_batch_and_stream_equals_the_simulation(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "y"]), f"u{rng.randint(0, 4)}", START + dt.timedelta(minutes=13 * i), f"h{rng.randint(0, 30)}") for i in range(300)]
    schema = "event_id long, inbox string, user string, ts timestamp, hash string"
    rule = intake.Inbox(20, 24, 5, "30 hours")
    caps = [intake.Cap(1, ("hash",), span="30 HOURS", name="duplicate"), intake.Cap(20, (), "day", name="daily_capacity"), intake.Cap(24, (), span="30 HOURS", name="daily_capacity"), intake.Cap(5, ("user",), "day", name="rate_limited")]
    want = {}
    for inbox in "xy":
        want |= simulated([(i, t, {"user": u, "hash": h}, False) for i, x, u, t, h in rows if x == inbox], caps)
    want = {i: r or "accepted" for i, r in want.items()}
    assert set(want.values()) == {"accepted", "duplicate", "daily_capacity", "rate_limited"}
    names = ("inbox", "ts", "event_id", "user", "hash")
    batch = intake.inbox_verdicts(spark.createDataFrame(rows, schema).repartition(3), rule, *names)
    assert {r["tie_of"]: r["verdict"] for r in batch.collect()} == want
    got = {r["tie_of"]: r["verdict"] for r in run(intake.inbox_stream(stream(spark, tmp_path, rows, schema), rule, *names), "inbox")}
    assert got == want


def test_reservations(spark):
    rows = [(1, "k", START, "reserve"), (2, "k", START + dt.timedelta(minutes=5), "commit"), (3, "k", START + dt.timedelta(minutes=50), "commit"), (4, "z", START, "commit")]
    got = intake.reservations(spark.createDataFrame(rows, "id int, key string, ts timestamp, action string"), "key", "ts", "id", "action", "10 MINUTES")
    assert {r["id"]: r["status"] for r in got.collect()} == {2: "committed", 3: "expired", 4: "unknown"}


def test_delta_that_does_not_fit_is_rejected(spark):
    base = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, v string, h string")
    delta = spark.createDataFrame([(1, "c", "n", "h1"), (2, "d", "n", "old")], "id int, v string, h string, want string")
    with pytest.raises(release.RejectedDelta, match="stale: 1"):
        release.apply_delta(base, delta, "id", "h", "want")
    assert sorted(r["v"] for r in release.apply_delta(base, delta.where("id = 1"), "id", "h", "want").collect()) == ["b", "c"]
    with pytest.raises(release.RejectedDelta):
        release.insert_only(base, base, ["id"])
    assert release.verify(base, base.where("id = 1"), "id", ["v"]).collect()[0]["missing"]


def test_the_two_normalisers_disagree_where_they_should(spark):
    rows = [("AA", "", "", "", "fixed_grade"), ("S", "A", "B", "C", "bounded_range"), ("A", "A", "A", "A", "bounded_range"), ("A", "A", "A", "A", "fixed_grade")]
    df = spark.createDataFrame([(*r, False, 0, 0, False, "", False) for r in rows], "core string, best string, likely string, worst string, mode string, blocked boolean, labels int, unresolved int, review boolean, queue string, insufficient boolean")
    loose = [(r["conclusion_mode"], r["issues"]) for r in rules.conclusions(df).collect()]
    assert loose == [("labels_only", ["incomplete_fixed_grade_range"]), ("bounded_range", ["core_likely_mismatch"]), ("labels_only", ["bounded_range_not_distinct"]), ("fixed_grade", [])]
    assert [r["reason"] for r in rules.strict_conclusions(df).collect()] == ["no_core_grade", "core_not_likely", None, None]


def test_pages_and_numbers(spark):
    assert ranking.page_bounds(None, None) == (30, 0) and ranking.page_bounds(500, 5_000_000) == (100, 1_000_000) and ranking.page_bounds("7", -1) == (30, 0)
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    assert {r["k"]: r["n"] for r in ranking.numbered(df, ["k"]).collect()} == {k: k + 1 for k in range(101)}


def test_silent_inboxes_empty_by_themselves(spark, tmp_path):
    """Two days of one inbox, then only another's events: a timer empties the first."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(i, "x", f"u{i % 3}", START + dt.timedelta(hours=2 * i), f"h{i}") for i in range(20)]
        rows += [(100 + i, "y", "u", START + dt.timedelta(days=4 + 3 * i), f"h{i}") for i in range(40)]
        schema = "event_id long, inbox string, user string, ts timestamp, hash string"
        rule = intake.Inbox(20, 24, 15, "30 hours")
        names = ("inbox", "ts", "event_id", "user", "hash")
        got = run(intake.expiring_inbox_stream(stream(spark, tmp_path, rows, schema), rule, *names), "expiring")
        want = {r["tie_of"]: r["verdict"] for r in intake.inbox_verdicts(spark.createDataFrame(rows, schema), rule, *names).collect()}
        assert {r["tie_of"]: r["verdict"] for r in got if r["tie_of"] is not None} == want
        emptied = [r["n_held"] for r in got if r["tie_of"] is None and r["inbox_of"] == "x"]
        assert emptied and emptied[-1] == 0 and all(r["verdict"] == "expired" for r in got if r["tie_of"] is None)
    finally:
        spark.conf.set(provider, before)


def test_a_chain_of_dependent_events_takes_few_rounds(spark, monkeypatch):
    """Each event shares a key with the one before and one with the next, so every verdict depends on the last."""
    calls = []
    real = intake._counted
    monkeypatch.setattr(intake, "_counted", lambda *a: calls.append(1) or real(*a))
    rows = [(i, START + dt.timedelta(seconds=i), {"ip": (i + 1) // 2, "net": -(i // 2) - 1, "hash": i}, False) for i in range(1000)]
    rng = random.Random(8)
    rows += [(2000 + i, START + dt.timedelta(minutes=rng.randint(0, 3000)), {"ip": 10_000 + rng.randint(0, 3), "net": rng.randint(0, 1), "hash": rng.randint(0, 90)}, False) for i in range(200)]
    caps = [intake.Cap(1, ("ip",), "day"), intake.Cap(1, ("net",), "day"), intake.Cap(1, ("hash",), span="9 HOURS", name="duplicate")]
    df = spark.createDataFrame([(i, t, k["ip"], k["net"], k["hash"]) for i, t, k, _ in rows], "event_id long, ts timestamp, ip long, net long, hash long").repartition(3)
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["event_id"]: (r["admitted"], r["reason"]) for r in intake.capped(df, "ts", "event_id", caps).collect()}
    want = simulated(rows, caps)
    assert {i: v[0] for i, v in got.items()} == {i: r is None for i, r in want.items()}
    assert len(calls) <= 20
