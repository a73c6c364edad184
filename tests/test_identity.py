"""Merge plans, tiers, candidates, series and upkeep on small odd tables."""

import random

from pyspark.sql import functions as F

from tessera.operators import identity, upkeep


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_merge_plan_equals_all_pairs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(i, [rng.choice(["", None, f"s{rng.randint(0, 200)}"])], [rng.choice(["", f"t{rng.randint(0, 25)}"]) for _ in range(2)], [rng.choice([None, 2000, 2001, 2002]) for _ in range(rng.choice([0, 1, 1, 2]))]) for i in range(120)]
        links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and {x for x in a[1] if x} & {x for x in b[1] if x}]
        titles = {}
        for r in rows:
            for t in {t for t in r[2] if t}:
                titles.setdefault(t, []).append(r)
        for group in titles.values():
            if 2 <= len(group) <= 8:
                for a in group:
                    for b in group:
                        years = [y for y in a[3] + b[3] if y]
                        if a[0] < b[0] and (len(years) < 2 or len(set(years)) == 1):
                            links.append((a[0], b[0]))
        df = spark.createDataFrame(rows, "id int, strong array<string>, titles array<string>, years array<int>").repartition(3)
        got = identity.merge_plan(df, "id", F.col("strong"), F.col("titles"), F.col("years"), most=8)
        assert {r["id"]: r["component"] for r in got.collect()} == union_find([r[0] for r in rows], links)


def test_tiers_of_blank_keys_and_repeats(spark):
    records = spark.createDataFrame([(1, "a", ["x", "x", None]), (2, "", []), (3, None, None), (4, "b", ["y"])], "r int, s string, e array<string>")
    works = spark.createDataFrame([(10, "a", ["z"]), (11, "c", ["x"]), (12, "", [""]), (13, "b", ["y"]), (13, "b", ["y"])], "w int, s string, e array<string>")
    found = identity.tier_matches(records, works, "r", "w", {"site": (F.array("s"), F.array("s")), "external": (F.col("e"), F.col("e"))})
    assert sorted(tuple(r) for r in found.collect()) == [(1, 10, "site", "primary"), (1, 11, "external", "conflict"), (4, 13, "site", "primary")]
    plan = identity.tier_plan(records, found, "r", "w", exact=("site",))
    assert sorted((r["r"], r["action"], r["w"], r["blockers"]) for r in plan.collect()) == [(1, "blocked", 10, ["identity_tier_conflict"]), (2, "create", None, []), (3, "create", None, []), (4, "update", 13, [])]


def test_candidates_need_two_entities(spark):
    rows = [
        ("e1", "source_id", "s", "anime", "a", None, None, None), ("e1", "source_id", "s", "anime", "a", None, None, None), ("e2", "source_id", "s", None, "b", None, None, None), ("e3", "source_id", "alone", None, None, None, None, None),
        ("e1", "normalized_title", "ab", "anime", None, None, None, None), ("e2", "normalized_title", "ab", "anime", None, None, None, None), ("e3", "normalized_title", "ab", "", None, None, None, None),
        ("e1", "graph_edge", None, None, None, "possible_duplicate_of", "e1", "e2"), ("e1", "graph_edge", None, None, None, "other", "e1", "nobody"), (None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "entity string, kind string, value string, media string, scope string, edge_type string, source string, target string")
    groups, members = identity.identity_candidates(df)
    got = sorted((r["candidate_type"], r["group_key"], r["members"], r["score"], r["band"], r["class"]) for r in groups.collect())
    assert got == [("graph_possible_duplicate", "possible_duplicate_of:e1->e2", 2, 20, "0-29", "identity_conflict"), ("same_source_id", "s", 2, 75, "60-89", "review_match_candidate"), ("title_match", "ab||anime", 2, 25, "0-29", "weak_title_only_candidate")]
    assert members.count() == 6


def test_series(spark):
    rows = [(1, "Moon OVA!", []), (2, "Moon 第2季", ["mini Moonlight"]), (3, "", []), (4, None, [None]), (5, "Moon", ["みにabc", "迷你Star Days SP"]), (6, "OVA", [])]
    df = spark.createDataFrame(rows, "id int, t string, names array<string>")
    got = {r["id"]: (r["series"], r["source"], r["confidence"]) for r in identity.series_groups(df, "id", "t", F.concat(F.array("t"), F.col("names"))).collect()}
    assert got == {1: ("Moon", "title_heuristic", "title_variant"), 2: ("Moonlight", "alias_heuristic", "title_variant"), 5: ("Star Days", "alias_heuristic", "title_variant"), 6: ("OVA", "title_heuristic", "title_base")}


def test_policies_and_elections_of_empty_tables(spark):
    parts = spark.createDataFrame([], "id int, component int")
    assert identity.policy_changes(parts, parts, "id").count() == 0
    works = spark.createDataFrame([], "id int, component int, p string, s string, m string, g string, t string")
    row = identity.merge_counts(works, "component", provider=F.col("p"), site=F.col("s"), media=F.col("m"), grade=F.col("g"), state=F.col("t"), blocking=("x",)).first()
    assert (row["source_works"], row["visible_works"], row["largest"]) == (0, 0, 0)
    rows = spark.createDataFrame([("g", 1, None, 3), ("g", 2, 5, None), ("g", 3, 5, 1), ("h", 4, None, None)], "g string, id int, rich int, o int")
    stable = spark.createDataFrame([("h", 99), ("g", 1)], "g string, id int")
    elected = lambda *x: sorted((r["g"], r["id"], r["is_stable"]) for r in upkeep.elect_primary(rows, "g", "id", F.col("rich"), F.col("o"), *x).collect())
    assert elected() == [("g", 3, False), ("h", 4, False)] and elected(stable) == [("g", 1, True), ("h", 4, False)]
    urls = [(" https://a.itch.io/x ",), ("javascript:x",), (None,), ("http://u@h/",), ("https://",)]
    got = [r["r"] for r in spark.createDataFrame(urls, "u string").select(upkeep.reference(F.col("u")).alias("r")).collect()]
    assert got[0]["url"] == "https://a.itch.io/x" and got[1:] == [None] * 4


def test_suffixes_are_looked_for_once_each(spark, capsys):
    title = F.concat(F.col("id").cast("string"), F.lit(" OVA"))
    df = spark.range(3).select("id", title.alias("t"))
    out = identity.series_groups(df, "id", "t", F.array("t"))
    assert sorted((r["id"], r["series"]) for r in out.collect()) == [(0, "0"), (1, "1"), (2, "2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 100  # thousands where every suffix repeats the text so far


def test_tiers_equal_all_pairs_by_brute_force(spark):
    rng = random.Random(5)
    side = lambda n: [(i, [rng.choice("abc") for _ in range(rng.randint(0, 2))], [rng.choice("uvwx") for _ in range(rng.randint(0, 3))], rng.choice("pqrs"), rng.randint(0, 9)) for i in range(n)]
    records, works = side(40), side(30)
    for weak in ({"one": "one_weak"}, {"three": "three_weak"}, {"two": "two_weak", "three": "three_weak"}):
        names = ["one", "two", "three"]
        labels = [*names, *weak.values()]
        want, met = set(), {}
        for r in records:
            for w in works:
                keys = [set(r[1]) & set(w[1]), set(r[2]) & set(w[2]), {r[3]} & {w[3]}]
                got = [labels.index(weak[t]) if t in weak and abs(r[4] - w[4]) > 3 else i for i, t in enumerate(names) if keys[i]]
                if got:
                    met.setdefault(r[0], {})[w[0]] = min(got)
        for r, of in met.items():
            want |= {(r, w, labels[t], "weak" if t >= 3 else "primary" if t == min(of.values()) else "conflict") for w, t in of.items()}
        schema = "{0} int, a array<string>, b array<string>, c string, f int"
        x, y = spark.createDataFrame(records, schema.format("r")), spark.createDataFrame(works, schema.format("w"))
        tiers = {"one": (F.col("a"), F.col("a")), "two": (F.col("b"), F.col("b")), "three": (F.array("c"), F.array("c"))}
        near = {t: (name, lambda p, q: F.abs(p - q) <= 3) for t, name in weak.items()}
        found = identity.tier_matches(x, y, "r", "w", tiers, facts=(F.col("f"), F.col("f")), weak=near)
        rows = [tuple(z) for z in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert "HashAggregate" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == len(want)
