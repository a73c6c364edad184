import duckdb

from tessera.llm import perspectives, queries

SCHEMA = "conv_id long, turn long, role string, text string, Part string"


def rows():
    out = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi é"), (1, 2, "bob", "Hello\nthere"), (1, 3, "cid", ""), (1, 4, "ann", "Bye"), (1, 4, "ann", "Bye"), (2, 0, "system", "alone"), (3, None, "ann", "when?"), (3, 0, None, None), (None, 1, "ann", "x"), (None, 1, "bob", "y")]
    out += [(9, i, ["ann", "bob"][i % 2], f"t{i}") for i in range(600)]
    return [(*r, "p") for r in out]


def brute(data, length=None):
    talks = {}
    for c, t, s, x, _ in data:
        talks.setdefault(c, []).append((t, s or "unknown", x or ""))
    out = set()
    for c, said in talks.items():
        for who in {s for _, s, _ in said} - {"system"}:
            parts = {}
            for t, s, x in sorted(said, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2])):
                if length and s == "system":
                    for p in {u // length for u, _, _ in said if u is not None} - {None if t is None else t // length}:
                        if t is None or p > t // length:
                            parts.setdefault(p, []).append((s, x))
                parts.setdefault(0 if not length else None if t is None else t // length, []).append((s, x))
            for part, messages in parts.items():
                text, mask = "", []
                for s, x in messages:
                    text += "<|system|>\n" if s == "system" else "<|assistant|>\n" if s == who else f"<|user {s}|>\n"
                    if s == who:
                        mask.append(f"{len(text)}:{len(text) + len(x)}")
                    text += x + "<|end|>\n"
                out.add((c, who, part, len(messages), text, ",".join(mask)))
    return out


def test_matches_brute_force_and_sql(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).drop("Part").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in queries.op8_perspectives(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert set(con.execute(queries.SQL["op8_perspectives"]).fetchall()) == set(got)


def test_parts_begin_with_the_system_turns(spark):
    data = [(9, -1, "system", "Rule", "p"), (9, 300, "system", "New rule", "p"), *rows()]
    got = perspectives.perspectives(spark.createDataFrame(data, SCHEMA), length=100).collect()
    masks = lambda r: ",".join(f"{m['start']}:{m['end']}" for m in r["mask"])
    assert {(r["conv_id"], r["perspective"], r["part"], r["n_messages"], r["rendered"], masks(r)) for r in got} == brute(data, 100)
    assert all(r["messages"][0]["role"] == "system" for r in got if r["conv_id"] == 9)


def test_long_dialogues_stay_whole(spark):
    got = perspectives.perspectives(spark.createDataFrame([(*r, "p") for r in [(9, i, ["ann", "bob"][i % 2], f"t{i}") for i in range(5000)]], SCHEMA)).collect()
    assert [r["n_messages"] for r in got] == [5000, 5000] and all(r["rendered"].count("<|end|>") == 5000 and len(r["mask"]) == 2500 for r in got)


def test_messages_and_masks_agree(spark):
    for r in perspectives.perspectives(spark.createDataFrame(rows(), SCHEMA)).collect():
        own = [m["content"] for m in r["messages"] if m["loss"]]
        assert [r["rendered"][s["start"] : s["end"]] for s in r["mask"]] == own
        assert all(m["role"] == ("assistant" if m["loss"] else m["role"]) and (m["name"] is not None) == (m["role"] == "user") for m in r["messages"])


def test_empty_table(spark):
    assert perspectives.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
