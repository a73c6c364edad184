"""Curation operators by hand: rejected parents, attachments, reuse, credits, empty tables."""

from tessera.operators import curation


def test_parents(spark):
    schema = "parent string, volume_like boolean, boundary string, boundary_reason string, action string, reason string, confidence string, matched array<string>, extra int"
    rows = [
        (" 12 ", True, "child_candidate", "volume_like_title", "link_to_parent_work_candidate", "r", "high", ["w"], 1),
        ("a", None, "child_candidate", "parent_title_inferred", "link", "r", "high", ["w"], 2),
        ("「あ」", False, "work_candidate", "x", "link", "r", "high", ["w"], 3),
        ("ab", True, "child_candidate", "x", "link", "r", "high", ["w"], 4),
        (None, None, None, None, None, None, None, None, 5),
        ("3", True, None, None, None, None, None, None, 6),
    ]
    got = {r.extra: r for r in curation.retarget_parents(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].action, got[1].matched, got[1].rejected_reason, got[1].changed_action) == ("create_child_entity_needs_policy", [], "numeric_parent_candidate", True)
    assert (got[2].boundary, got[2].action, got[2].confidence, got[2].rejected_parent) == ("work_candidate", "create_new_work_needs_review", "low", "a")
    assert (got[3].action, got[3].matched, got[3].rejected_reason, got[3].changed_action) == ("link", ["w"], "too_short_parent_candidate", False)
    assert got[4].parent == "ab" and got[4].rejected_parent is None and got[5].rejected_parent is None
    assert (got[6].action, got[6].boundary_reason, got[6].changed_action) == (None, "volume_like_title_without_useful_parent", False)


def test_seeds(spark):
    schema = "{} long, titles array<string>, keys array<string>"
    groups = spark.createDataFrame([(1, ["a", "b"], ["k1", "row-1"]), (2, ["b", None], ["k1", "k2"]), (3, None, None)], schema.format("g"))
    seeds = spark.createDataFrame([(1, ["x", "a"], ["k2"]), (2, ["b"], ["k2"]), (3, [], ["k1"]), (4, [""], ["k2"]), (5, None, ["ROW-1", "row-1"]), (6, None, None), (7, [None], [None])], schema.format("s"))
    groups = groups.union(spark.createDataFrame([(1, None, ["ROW-1"])], schema.format("g")))
    decided = curation.attach_seeds(seeds, groups, "s", "g")
    got = {r.s: (r.g, r.method, r.matched_by) for r in decided.collect()}
    assert got[1] == (1, "exact_title", "title:a") and got[4] == (2, "strong_key", "key:k2")
    assert all(got[s] == (None, "none", None) for s in (2, 3, 5, 6, 7))
    reviews = sorted((r.s, r.kind, r.key, r.other) for r in curation.seed_reviews(seeds, groups, decided, "s", "g").collect())
    assert reviews == [(1, "strong", "k2", 2), (2, "title", "b", 1), (2, "title", "b", 2), (3, "strong", "k1", 1), (3, "strong", "k1", 2), (5, "weak", "ROW-1", 1), (5, "weak", "row-1", 1)]
    assert {r.reason for r in curation.attach_seeds(seeds, groups.limit(0), "s", "g").collect()} == {"no exact title or key"}


def test_credits_keep_the_first_spelling(spark):
    entries = spark.createDataFrame([(1, 1, "作者", "b; B／ C"), (1, 0, "作者", "B"), (1, 2, "製作", "X委員会（a、 b，A）"), (2, 0, "none", "x"), (3, 0, "作者", None), (3, 1, None, "x")], "id long, at int, key string, value string")
    got = sorted((r.role, r.name, r.member_of) for r in curation.infobox_credits(entries, "id").collect())
    assert got == [("committee", "X委員会", None), ("committee_member", "a", "X委員会"), ("committee_member", "b", "X委員会"), ("original_creator", "B", None), ("original_creator", "b; B／ C".split("; ")[1], None)]


def test_reuse_and_empty_tables(spark):
    schema = "id long, work_id string, site_id string, marks array<string>, coverage double, evidence_status string, summary string, grade string, rule_codes array<string>, source_urls array<string>, file string"
    rows = [(1, "w", "s", None, 0.5, "ok", "t", "A", None, ["u", "u", ""], "v0.6-resolutions.jsonl"), (2, "w", "s", ["Wrong summary"], 0.5, "ok", "t", "A", None, None, None), (3, "w", "s", None, 34.0, "ok", "t", "A", None, None, ""), (4, *[None] * 10), (5, "w", "s", [None], 90.0, "ok", "t", "", [" "], None, "x")]
    got = {r.id: (r.refusal, r.score) for r in curation.reusable_evidence(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, 571), 2: ("identity_blocked", None), 3: ("coverage_too_low", None), 4: ("identity_missing", None), 5: ("assessment_signal_missing", None)}
    items = spark.createDataFrame([], "c string, v string")
    assert [tuple(r) for r in curation.index_header(items, "c", "v").collect()] == [(0, {}, {})]
    works, objects = spark.createDataFrame([(1, None, None), (2, "{broken", "x")], "work_id long, document string, audit_run_ref string"), spark.createDataFrame([], "object_ref string, object_kind string")
    stats = curation.lineage_stats(works, objects).first()
    assert (stats.formal_rows, stats.binding_rows, stats.open_selection_rows, stats.broken_audit_refs) == (2, 0, 2, 2)


def test_lexical_tokens(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as keys

    cases = {"漫画の東西南北": ["東西南北"], "少女ABC ab カタカナ": ["abc", "カタカナ"], "春夏秋冬東": ["冬東", "夏秋", "夏秋冬", "夏秋冬東", "春夏", "春夏秋", "春夏秋冬", "春夏秋冬東", "秋冬", "秋冬東"], "": [], None: []}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want array<string>").select("want", F.array_sort(keys.lexical_tokens(F.col("t"))).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_packing_streams_in_order(spark):
    from tessera.operators import ranking

    rows = spark.createDataFrame([("b", 2, 2), ("a", 5, 1), ("c", 9, 3), ("d", None, 4), ("e", 1, 5)], "f string, n long, o long")
    got = [(r.f, r.n, r.batch) for r in ranking.packed(rows, "f", "n", "o", 7).collect()]
    assert got == [("a", 5, 1), ("b", 2, 1), ("c", 9, 2), ("d", 0, 3), ("e", 1, 3)]
    assert ranking.packed(rows.limit(0), "f", "n", "o", 7).count() == 0
