"""Registered queries of repairs and audits, of small functions, and of files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.functions import values
from tessera.operators import classify, curation, diff, entity, graph, matching, ranking, rules
from tessera.plans import catalog, incremental, release
from tessera.queries import _graded, query
from tessera.session import shared_folder, table
from tessera.sources import readers, writers


def _pick(options, k):
    return F.element_at(F.array(*[F.lit(x) for x in options]), (k + 1).cast("int"))


def _word(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


# -- repairs and audits -------------------------------------------------------------------------


@query("""
WITH r AS (SELECT p_partkey, [CAST(p_size AS VARCHAR), 'x', '', p_name, ' q! '][CAST(p_partkey % 5 AS INTEGER) + 1] AS parent, p_partkey % 5 IN (0, 1, 4) AS noisy, p_partkey % 3 = 0 AS volume, p_partkey % 2 = 0 AS linked, p_partkey % 7 < 4 AS child FROM part)
SELECT p_partkey, CASE WHEN noisy THEN '' ELSE parent END AS parent,
  CASE WHEN NOT child OR noisy AND NOT volume THEN 'work_candidate' ELSE 'child_candidate' END AS boundary,
  CASE WHEN noisy AND volume THEN 'volume_like_title_without_useful_parent' WHEN noisy THEN 'parent_title_inference_rejected' ELSE 'parent_title_inferred' END AS boundary_reason,
  CASE WHEN noisy AND volume AND linked THEN 'create_child_entity_needs_policy' WHEN noisy AND NOT volume AND child THEN 'create_new_work_needs_review' WHEN linked THEN 'link_to_parent_work_candidate' ELSE 'keep' END AS action,
  CASE WHEN NOT noisy THEN 'r' WHEN volume AND linked THEN 'rejected_noisy_parent_candidate_from_parent_link' WHEN volume THEN 'volume_like_row_no_useful_parent_candidate' ELSE 'parent_title_inference_rejected_noisy_parent' END AS reason,
  CASE WHEN noisy AND (volume AND linked OR NOT volume AND child) THEN 0 ELSE 1 END AS matched,
  CASE WHEN noisy THEN parent END AS rejected_parent, CASE WHEN noisy THEN CASE WHEN p_partkey % 5 = 0 THEN 'numeric_parent_candidate' ELSE 'too_short_parent_candidate' END END AS rejected_reason,
  noisy AND (volume AND linked OR NOT volume AND child) AS changed_action FROM r""")
def retargeted_parents(spark, d):
    k = F.col("p_partkey")
    parent = F.when(k % 5 == 0, F.col("p_size").cast("string")).when(k % 5 == 1, "x").when(k % 5 == 2, "").when(k % 5 == 3, F.col("p_name")).otherwise(" q! ")
    rows = table(spark, d, "part").select(
        k, parent.alias("parent"), (k % 3 == 0).alias("volume_like"), F.when(k % 7 < 4, "child_candidate").otherwise("work_candidate").alias("boundary"), F.lit("parent_title_inferred").alias("boundary_reason"),
        F.when(k % 2 == 0, "link_to_parent_work_candidate").otherwise("keep").alias("action"), F.lit("r").alias("reason"), F.lit("high").alias("confidence"), F.array(k).alias("matched"),
    )
    return curation.retarget_parents(rows).drop("volume_like", "confidence").withColumn("matched", F.size("matched"))


_SEEDS = """
g AS (SELECT s_suppkey AS g, 't' || (s_suppkey // CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END) AS t, 'k' || (s_suppkey // CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 1 END) AS strong, 'ROW-' || s_suppkey AS weak FROM supplier),
s AS (SELECT p_partkey AS s, ['t' || (p_partkey * 3), CASE WHEN p_partkey % 4 = 0 THEN 't' || (p_size + 2) ELSE '' END] AS titles, ['k' || p_size, 'ROW-' || (p_partkey + 3)] AS keys FROM part),
tg AS (SELECT t AS key, 'title' AS kind, g FROM g UNION ALL SELECT strong, 'strong', g FROM g UNION ALL SELECT weak, 'weak', g FROM g),
sk AS (SELECT s, unnest(titles) AS key, 'title' AS kind, unnest([0, 1]) AS nth FROM s UNION ALL SELECT s, keys[1], 'strong', 0 FROM s UNION ALL SELECT s, keys[2], 'weak', 1 FROM s),
h AS (SELECT sk.*, g FROM sk JOIN tg USING (kind, key)),
n AS (SELECT s, count(DISTINCT g) FILTER (kind = 'title') AS nt, count(DISTINCT g) FILTER (kind = 'strong') AS ns, count(DISTINCT g) FILTER (kind = 'weak') AS nw, min(g) FILTER (kind = 'title') AS gt, min(g) FILTER (kind = 'strong') AS gs,
  arg_min(key, nth) FILTER (kind = 'title') AS kt, arg_min(key, nth) FILTER (kind = 'strong') AS ks FROM h GROUP BY s)"""


def _seeds(spark, d):
    k, size, g = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    seeds = table(spark, d, "part").select(k, F.array(_word("t", k * 3), F.when(k % 4 == 0, _word("t", size + 2)).otherwise("")).alias("titles"), F.array(_word("k", size), _word("ROW-", k + 3)).alias("keys"))
    groups = table(spark, d, "supplier").select(g, F.array(_word("t", F.floor(g / F.when(g % 3 == 0, 2).otherwise(1)))).alias("titles"), F.array(_word("k", F.floor(g / F.when(g % 2 == 0, 4).otherwise(1))), _word("ROW-", g)).alias("keys"))
    return seeds, groups


@query(f"""
WITH {_SEEDS}
SELECT s AS p_partkey, CASE WHEN nt = 1 THEN gt WHEN coalesce(nt, 0) = 0 AND ns = 1 THEN gs END AS s_suppkey, CASE WHEN nt = 1 THEN 'exact_title' WHEN coalesce(nt, 0) = 0 AND ns = 1 THEN 'strong_key' ELSE 'none' END AS method,
  CASE WHEN nt = 1 THEN 'title:' || kt WHEN coalesce(nt, 0) = 0 AND ns = 1 THEN 'key:' || ks END AS matched_by,
  CASE WHEN nt = 1 THEN 'unique exact title' WHEN nt > 1 THEN 'ambiguous exact titles' WHEN ns = 1 THEN 'unique strong key, no exact title' WHEN ns > 1 THEN 'ambiguous strong keys, no exact title' WHEN nw > 0 THEN 'weak key only, no exact title' ELSE 'no exact title or key' END AS reason
FROM s LEFT JOIN n USING (s)""")
def seed_attachments(spark, d):
    seeds, groups = _seeds(spark, d)
    return curation.attach_seeds(seeds, groups, "p_partkey", "s_suppkey")


@query(f"""
WITH {_SEEDS}
SELECT s AS p_partkey, kind, key, nth AS at, g AS other FROM h JOIN n USING (s)
WHERE nt = 1 AND kind <> 'title' AND g <> gt OR nt > 1 AND kind = 'title' OR nt = 0 AND ns > 1 AND kind = 'strong' OR nt = 0 AND ns = 0 AND kind = 'weak'""")
def seed_review_list(spark, d):
    seeds, groups = _seeds(spark, d)
    return curation.seed_reviews(seeds, groups, curation.attach_seeds(seeds, groups, "p_partkey", "s_suppkey"), "p_partkey", "s_suppkey")


_REUSE = """
r AS (SELECT o_orderkey AS id, o_custkey AS w, o_orderkey % 11 = 0 AS unnamed, o_orderkey % 7 = 0 AS doubtful, o_custkey % 101 AS pct, ['verified', 'unknown', 'partial', ''][CAST(o_custkey % 4 AS INTEGER) + 1] AS ev, o_orderkey % 9 <> 1 AS told, o_orderkey % 4 = 0 AS graded, o_orderkey % 5 = 0 AS coded,
  o_orderkey % 3 AS urls, [500, 450, 400, 300][CAST(o_orderkey % 4 AS INTEGER) + 1] AS worth FROM orders),
s AS (SELECT *, CASE WHEN unnamed THEN 'identity_missing' WHEN doubtful THEN 'identity_blocked' WHEN pct < 35 AND pct > 1 OR pct = 0 THEN 'coverage_too_low' WHEN ev IN ('', 'unknown') THEN 'evidence_too_weak' WHEN NOT told THEN 'source_summary_missing' WHEN NOT graded AND NOT coded THEN 'assessment_signal_missing' END AS refusal,
  worth + (CASE WHEN pct > 1 THEN pct ELSE pct * 100 END) + CASE WHEN graded THEN 20 ELSE 0 END + CASE WHEN urls = 0 THEN 0 WHEN urls = 1 THEN 1 ELSE 2 END AS points FROM r)"""


def _reusable(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k, c.cast("string").alias("work_id"), F.when(k % 11 != 0, "s").alias("site_id"), F.when(k % 7 == 0, F.array(F.lit("series identity conflict"))).alias("marks"), (c % 101).cast("double").alias("coverage"),
        _pick(["verified", "unknown", "partial", ""], c % 4).alias("evidence_status"), F.when(k % 9 != 1, "told").alias("summary"), F.when(k % 4 == 0, "A").otherwise(" ").alias("grade"), F.when(k % 5 == 0, F.array(F.lit("R1"))).alias("rule_codes"),
        F.when(k % 3 == 1, F.array(F.lit("u"), F.lit("u"), F.lit(""))).when(k % 3 == 2, F.array(F.lit("u"), F.lit("v"))).alias("source_urls"), _pick(["v0.6-resolutions.jsonl", "v0.5-resolutions.jsonl", "ai-resolved.jsonl", "chunk.jsonl"], k % 4).alias("file"),
    )


@query(f"WITH {_REUSE} SELECT id AS o_orderkey, refusal, CASE WHEN refusal IS NULL THEN points END AS score FROM s")
def reusable_assessments(spark, d):
    return curation.reusable_evidence(_reusable(spark, d)).select("o_orderkey", "refusal", "score")


@query(f"WITH {_REUSE} SELECT CAST(w AS VARCHAR) AS work_id, max(points) AS score, arg_max(id, points * 1000000000 - id) AS o_orderkey, count(*) AS n FROM s WHERE refusal IS NULL GROUP BY w")
def best_assessments(spark, d):
    return curation.best_reusable(_reusable(spark, d), "o_orderkey")


_LADDER = """
g AS (SELECT l_orderkey, l_linenumber, upper(['S','a','B','C','AA','','F','Q'][CAST(l_partkey % 8 AS INTEGER) + 1]) AS c0, ['S','a','B','C','AA','','F','Q'][CAST(l_suppkey % 8 AS INTEGER) + 1] AS b0, ['S','a','B','C','AA','','F','Q'][CAST((l_suppkey + l_linenumber % 2) % 8 AS INTEGER) + 1] AS k0, ['S','a','B','C','AA','','F','Q'][CAST((l_suppkey + l_linenumber % 3) % 8 AS INTEGER) + 1] AS w0,
  ['fixed_grade','bounded_range','','labels_only'][CAST(l_orderkey % 4 AS INTEGER) + 1] AS mode, l_partkey, l_suppkey, l_quantity FROM lineitem)"""


@query(f"""
WITH {_LADDER},
f AS (SELECT *, coalesce(list_position(['S','A','B','C','D','E','F','X'], CASE upper(b0) WHEN 'AA' THEN 'S' ELSE upper(b0) END), 0) AS b, coalesce(list_position(['S','A','B','C','D','E','F','X'], CASE upper(k0) WHEN 'AA' THEN 'S' ELSE upper(k0) END), 0) AS k,
  coalesce(list_position(['S','A','B','C','D','E','F','X'], CASE upper(w0) WHEN 'AA' THEN 'S' ELSE upper(w0) END), 0) AS w, coalesce(list_position(['S','A','B','C','D','E','F','X'], CASE c0 WHEN 'AA' THEN 'S' ELSE c0 END), 0) AS c FROM g),
h AS (SELECT *, b > 0 AND k > 0 AND w > 0 AND b <= k AND k <= w AS legal FROM f)
SELECT count(*) AS total, count(*) FILTER (legal AND b = w) AS fixed_ranges, count(*) FILTER (legal AND b <> w) AS bounded_ranges, count(*) FILTER ((b0 <> '' OR k0 <> '' OR w0 <> '') AND NOT legal) AS malformed_ranges,
  count(*) FILTER (b0 = '' OR k0 = '' OR w0 = '') AS rows_with_missing_fields, count(*) FILTER (c > 0 AND k > 0 AND c <> k) AS core_likely_mismatch, count(*) FILTER (legal AND b <> w AND l_partkey % 3 = 0) AS unclear_bounded_ranges,
  count(*) FILTER (l_orderkey % 13 = 0) AS mode_blocked FROM h""")
def rating_counts(spark, d):
    rows = _graded(spark, d).withColumn("rule", F.lit("R")).withColumn("classes", F.when(F.col("labels") == 0, F.array(F.lit("x"), F.lit(" d-unclear ")))).withColumn("has_tag", F.lit(False))
    out = curation.rating_audit(rows)
    return out.select("total", "fixed_ranges", "bounded_ranges", "malformed_ranges", "rows_with_missing_fields", "core_likely_mismatch", "unclear_bounded_ranges", "mode_blocked")


@query(f"""
WITH {_LADDER},
f AS (SELECT *, list_position(['S','A','B','C','D','E','F','X'], upper(b0)) AS b, list_position(['S','A','B','C','D','E','F','X'], upper(k0)) AS k, list_position(['S','A','B','C','D','E','F','X'], upper(w0)) AS w, list_position(['S','A','B','C','D','E','F','X'], c0) AS c FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN mode NOT IN ('fixed_grade', 'bounded_range') THEN 'unknown_mode' WHEN c IS NULL THEN 'no_core_grade'
  WHEN mode = 'fixed_grade' THEN CASE WHEN b IS NOT NULL AND k IS NOT NULL AND w IS NOT NULL AND NOT (b = k AND k = w) THEN 'range_not_fixed' END
  WHEN NOT coalesce(b <= k AND k <= w, false) THEN 'range_invalid' WHEN c <> k THEN 'core_not_likely' END AS reason FROM f""")
def strict_ranges(spark, d):
    return rules.strict_conclusions(_graded(spark, d)).select("l_orderkey", "l_linenumber", "reason")


@query("""
SELECT (SELECT count(*) FROM customer) AS formal_rows, (SELECT count(*) FROM orders) AS binding_rows, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS unique_binding_ids, (SELECT count(DISTINCT o_orderkey % 50) FROM orders) AS unique_provider_keys,
  count(*) FILTER (c_custkey % 3 = 0) AS partial_identity_rows, count(*) FILTER (c_custkey % 4 = 0) AS legacy_rows, count(*) FILTER (c_custkey % 5 = 0) AS research_rows, count(*) FILTER (c_custkey % 6 = 0) AS assessment_rows, CAST(0 AS BIGINT) AS candidate_rows, count(*) FILTER (c_custkey % 7 = 0) AS published_rows, CAST(0 AS BIGINT) AS human_rows,
  count(*) FILTER (c_custkey % 2 = 1) AS open_selection_rows, (SELECT count(*) FROM supplier) AS provenance_objects, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS provenance_observations, count(*) FILTER (c_custkey NOT IN (SELECT s_suppkey FROM supplier)) AS broken_audit_refs FROM customer""")
def lineage_counts(spark, d):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    binding = F.struct(k.cast("string").alias("bindingId"), F.struct((k % 50).cast("string").alias("providerIdentityKey")).alias("externalIdentity"))
    bound = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(binding).alias("bindings"))
    observed = lambda x: F.struct(F.struct(x.alias("state")).alias("observation"))
    some = lambda name, n: F.struct(F.when(c % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias(name))
    document = F.to_json(F.struct(
        F.struct("bindings", F.struct(F.when(c % 3 == 0, "partial").otherwise("exact").alias("state")).alias("observation")).alias("identities"), F.when(c % 4 == 0, F.struct(F.lit(1).alias("v"))).alias("legacy"),
        observed(F.when(c % 5 == 0, "done").otherwise("not_observed")).alias("research"), some("attempts", 6).alias("assessment"), F.struct(F.array().cast("array<string>").alias("records")).alias("candidate"), some("entries", 7).alias("published"),
        F.struct(F.struct(F.struct(F.when(c % 2 == 0, True).alias("failClosed")).alias("selection")).alias("ai")).alias("effectiveState"),
    ))
    works = table(spark, d, "customer").join(bound, "c_custkey", "left").select(c.alias("work_id"), document.alias("document"), c.alias("audit_run_ref"))
    s = F.col("s_suppkey")
    return curation.lineage_stats(works, table(spark, d, "supplier").select(s.alias("object_ref"), F.when(s % 2 == 0, "observation").otherwise("run").alias("object_kind")))


@query("""
WITH e AS (SELECT s_suppkey, s_suppkey % 4 AS k, s_name AS n, s_nationkey AS x FROM supplier)
SELECT s_suppkey, 'creator' AS kind, 'original_creator' AS role, n AS name, '原作' AS original_role, NULL::VARCHAR AS member_of FROM e WHERE k = 0 UNION ALL SELECT s_suppkey, 'creator', 'original_creator', 'B' || x, '原作', NULL FROM e WHERE k = 0
UNION ALL SELECT s_suppkey, 'organization', 'committee', n, '製作', NULL FROM e WHERE k = 1 UNION ALL SELECT s_suppkey, 'organization', 'committee_member', 'm' || x, '製作', n FROM e WHERE k = 1 UNION ALL SELECT s_suppkey, 'organization', 'committee_member', 'z', '製作', n FROM e WHERE k = 1
UNION ALL SELECT s_suppkey, 'organization', 'platform', 'p' || x, '平台', NULL FROM e WHERE k = 2""")
def infobox_roles(spark, d):
    k, x = F.col("s_suppkey") % 4, F.col("s_nationkey")
    value = F.when(k == 0, F.concat("s_name", _word(" / B", x), F.lit("、"), _word("b", x))).when(k == 1, F.concat("s_name", _word("（m", x), F.lit(", z）"))).otherwise(_word("p", x))
    entries = table(spark, d, "supplier").select("s_suppkey", F.lit(0).alias("at"), _pick(["原作", "製作", "平台", "備考"], k).alias("key"), value.alias("value"))
    return curation.infobox_credits(entries, "s_suppkey")


@query("""
WITH c AS (SELECT o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS total, (SELECT string_agg(c || '=' || n, ',' ORDER BY c) FROM c) AS counts, (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM v) AS visibility_counts""")
def index_counts(spark, d):
    head = curation.index_header(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "O")
    listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(m)
    return head.select("total", listed("counts"), listed("visibility_counts"))


# -- small functions ----------------------------------------------------------------------------


@query("""
SELECT o_orderkey, string_agg(x, ',' ORDER BY p) AS kept FROM (SELECT o_orderkey, x, min(p) AS p FROM (SELECT o_orderkey, unnest(['a' || (o_custkey % 3), 'a' || (o_orderkey % 3), o_orderstatus, 'a1', o_orderstatus]) AS x, unnest([1, 2, 3, 4, 5]) AS p FROM orders) GROUP BY 1, 2) GROUP BY 1""")
def first_wins_items(spark, d):
    items = F.array(_word("a", F.col("o_custkey") % 3), _word("a", F.col("o_orderkey") % 3), F.col("o_orderstatus"), F.lit("a1"), F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(entity.first_wins(items), ",").alias("kept"))


@query("""
WITH a AS (SELECT p_partkey AS n, p_brand AS k FROM part), b AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE p_brand END AS k FROM part WHERE p_partkey % 17 <> 0)
SELECT a.n, a.k AS left_key, b.k AS right_key, a.k IS NOT DISTINCT FROM b.k AS aligned FROM a FULL JOIN b USING (n)""")
def positional_zip(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    left = part.select(k.alias("n"), F.col("p_brand").alias("k"))
    right = part.where(k % 17 != 0).select(k.alias("n"), F.when(k % 9 == 0, "other").otherwise(F.col("p_brand")).alias("k"))
    return matching.zipped(left, right, "n", "k").select("n", "left_key", "right_key", "aligned")


@query("SELECT l_partkey AS work_id, l_orderkey FROM lineitem")
def inverted_lists(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("work_ids"))
    return catalog.exploded_groups(lists)


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 10 = 0")
def inserted_rows(spark, d):
    base = table(spark, d, "orders").select("o_orderkey")
    return release.insert_only(base, base.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey")), ["o_orderkey"])


@query("""
SELECT o_orderkey, o_orderkey % 40 = 0 AS missing, CASE WHEN o_orderkey % 40 = 0 THEN CASE WHEN o_orderpriority IS NULL THEN 'o_orderstatus' ELSE 'o_orderstatus,o_orderpriority' END ELSE 'o_orderstatus' END AS changed FROM orders WHERE o_orderkey % 40 = 0 OR o_orderkey % 9 = 0""")
def readback(spark, d):
    want = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    have = want.where("o_orderkey % 40 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "?").otherwise(F.col("o_orderstatus")))
    return release.verify(want, have, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).withColumn("changed", F.array_join("changed", ","))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def resume_rows(spark, d):
    return incremental.unprocessed(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""
SELECT o_orderkey, array_to_string(list_filter(['a' || (o_orderkey % 2), 'b', 'a' || (o_custkey % 5)], lambda x: NOT list_contains(['a1', 'a3'], x)), ',') AS less FROM orders""")
def array_difference(spark, d):
    items = F.array(_word("a", F.col("o_orderkey") % 2), F.lit("b"), _word("a", F.col("o_custkey") % 5))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(diff.array_less(items, F.array(F.lit("a1"), F.lit("a3"))), ",").alias("less"))


@query("""
SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS tags FROM (
  SELECT p_partkey, ['own' || (p_partkey % 3)] || CASE WHEN p_size % 4 = 0 THEN ['own0', 'long'] WHEN p_size % 4 = 1 THEN ['short'] ELSE [] END AS raw, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS list_distinct_in_order FROM part)""")
def derived_tags(spark, d):
    classes = F.array(_word("c", F.col("p_size") % 4), F.lit("nothing"))
    return table(spark, d, "part").select("p_partkey", F.array_join(classify.tags(F.array(_word("own", F.col("p_partkey") % 3)), classes, {"c0": ["own0", "long"], "c1": ["short"]}), ",").alias("tags"))


@query("""
WITH t AS (SELECT p_partkey, substr('春夏秋冬東西南北', CAST(p_size % 5 AS INTEGER) + 1, CAST(p_partkey % 4 AS INTEGER) + 1) AS r FROM part),
g AS (SELECT DISTINCT p_partkey, substr(r, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS g FROM t, range(1, 5) a(i), range(2, 5) b(n) WHERE i + n - 1 <= length(r))
SELECT p_partkey, coalesce(string_agg(g, ',' ORDER BY g), '') AS grams FROM t LEFT JOIN g USING (p_partkey) GROUP BY 1""")
def han_ngrams(spark, d):
    run = F.expr("substr('春夏秋冬東西南北', cast(p_size % 5 as int) + 1, cast(p_partkey % 4 as int) + 1)")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(keys.han_grams(F.concat(F.lit("x "), run, F.lit(" y")))), ",").alias("grams"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN '{"a":' || c_custkey || ',"b":{"x":"' || c_mktsegment || '","y":[1,2]}}' END AS canonical FROM customer""")
def canonical_documents(spark, d):
    text = F.when(F.col("c_custkey") % 7 == 0, "{broken").otherwise(F.concat(F.lit('{ "b": {"y": [1, 2], "x": "'), "c_mktsegment", F.lit('"}, "a": '), F.col("c_custkey").cast("string"), F.lit("}")))
    return table(spark, d, "customer").select("c_custkey", values.canonical_json(text).alias("canonical"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '10.' || (c_custkey % 256) || '.7.0/24' WHEN 1 THEN '2001:db8:' || printf('%x', 1 + c_custkey % 60000) || '::/64' END AS net FROM customer""")
def network_prefixes(spark, d):
    c = F.col("c_custkey")
    address = F.when(c % 3 == 0, F.concat(_word(" 10.", c % 256), F.lit(".7."), (c % 200).cast("string"))).when(c % 3 == 1, F.concat(F.lit("2001:DB8:"), F.hex(1 + c % 60000), F.lit("::5"))).otherwise("300.1.1.1")
    return table(spark, d, "customer").select("c_custkey", values.network_prefix(address).alias("net"))


@query("SELECT p_partkey, printf('%08x', list_reduce([2166136261] || list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)) AS h FROM part")
def short_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", values.fnv1a(F.col("p_name")).alias("h"))


@query("""
SELECT o_orderkey, CAST(least(100, greatest(0, o_custkey % 150 - 20)) AS INTEGER) AS percent, CASE WHEN o_orderkey % 6 = 0 THEN 0.25 WHEN o_custkey % 150 - 20 > 1 THEN least(1.0, (o_custkey % 150 - 20) / 100.0::DOUBLE) ELSE greatest(0.0, o_custkey % 150 - 20) END AS confidence FROM orders""")
def clamped_shares(spark, d):
    v = F.col("o_custkey") % 150 - 20
    return table(spark, d, "orders").select("o_orderkey", values.percent(v).alias("percent"), values.confidence(F.when(F.col("o_orderkey") % 6 != 0, v), 0.25).alias("confidence"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'excluded' WHEN p_size > 40 THEN 'blocked' WHEN p_size > 20 THEN 'maybe' ELSE 'eligible' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 'missing_title' WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' END AS reason FROM part""")
def eligible_rows(spark, d):
    size = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).otherwise(" ").alias("title"))
    return readers.eligibility(rows, "title", {"large": ("blocked", size > 40), "medium": ("maybe", size > 20)}).select("p_partkey", "status", "reason")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name END AS picked FROM part")
def picked_paths(spark, d):
    k = F.col("p_partkey") % 3
    document = F.to_json(F.struct(F.struct(F.when(k == 0, F.col("p_brand")).otherwise(" ").alias("brand")).alias("a"), F.when(k < 2, F.col("p_name")).alias("name")))
    return table(spark, d, "part").select("p_partkey", readers.pick(document, "a.brand", "name").alias("picked"))


# -- comparisons, plans and pages ---------------------------------------------------------------


@query("SELECT unnest(['o_orderstatus', 'o_custkey']) AS field, count(*) FILTER (o_orderkey % 5 <> 0) AS compared, unnest([count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0), count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0)]) AS differing FROM orders")
def field_mismatches(spark, d):
    before, k = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), F.col("o_orderkey")
    after = before.where(k % 5 != 0).select(k, F.when(k % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_custkey") + F.when(k % 4 == 0, 1).otherwise(0)).alias("o_custkey"))
    return diff.mismatch_counts(before, after, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing_right' WHEN o_orderkey % 7 = 0 THEN 'repeated' WHEN o_orderkey % 4 = 0 THEN 'identity_differs' ELSE 'matched' END AS status FROM orders
UNION ALL SELECT o_orderkey + 1000000000, 'missing_left' FROM orders WHERE o_orderkey % 13 = 0""")
def asserted_join(spark, d):
    left, k = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey")
    right = left.where(k % 10 != 0).withColumn("o_custkey", F.when(k % 4 != 0, F.col("o_custkey")))
    more = left.where(k % 13 == 0).withColumn("o_orderkey", k + 1000000000)
    return matching.asserted(left, right.union(right.where(k % 7 == 0)).union(more), "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("""
WITH r AS (SELECT o_orderkey, o_custkey % 4 AS h, o_orderkey % 3 AS p, o_orderkey % 11 = 0 AS rv, o_orderkey % 5 AS sg, o_orderkey % 7 AS rs, o_orderkey % 2 AS st FROM orders),
n AS (SELECT *, ['', 'AA', 'B', 'unknown'][CAST(h AS INTEGER) + 1] AS hg, CASE WHEN st = 0 THEN 'C' ELSE 'unknown' END AS sto FROM r)
SELECT o_orderkey, CASE WHEN h > 0 AND p > 0 THEN hg WHEN rv THEN sto WHEN sg = 0 THEN 'AA' WHEN rs = 0 THEN 'unknown' ELSE sto END AS grade,
  CASE WHEN h > 0 AND p > 0 OR rv THEN 'human' WHEN sg = 0 THEN 'ai' WHEN rs = 0 THEN 'research' WHEN st = 0 THEN 'ai_legacy' ELSE 'unassessed' END AS source, h > 0 AND p > 0 OR rv AS reviewed FROM n""")
def effective_grades(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k, _pick([" ", "s", "B", "?"], F.col("o_custkey") % 4).alias("human_grade"), F.when(k % 3 == 0, "pending").alias("human_status"), F.when(k % 11 == 0, "reviewed").alias("review_status"), F.lit(None).cast("string").alias("notice"),
        F.when(k % 2 == 0, "c").otherwise("Q").alias("stored"), F.when(k % 5 == 0, "AA").alias("suggested"), F.when(k % 7 == 0, "E").alias("researched"),
    )
    return rules.effective_grade(rows).select("o_orderkey", "grade", "source", "reviewed")


@query("""
WITH t AS (SELECT p_partkey, unnest(['magical', 'ab12345', lower(p_brand) || 'x']) AS raw FROM part), w AS (SELECT p_partkey, unnest(regexp_extract_all(raw, '[a-z][a-z0-9]{5,}')) AS word FROM t)
SELECT p_partkey, string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM w GROUP BY 1""")
def title_word_lists(spark, d):
    title = F.concat(F.lit("Magical GIRLS story ＡＢ12345 abc "), "p_brand", F.lit("x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(keys.title_words(title)), ",").alias("words"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'abc,チョコ,東西' || CASE WHEN p_size % 2 = 0 THEN '南' ELSE '' END WHEN 1 THEN 'abc,チョコ,春夏,春夏秋,春夏秋冬,春夏秋冬東,夏秋,夏秋冬,夏秋冬東,秋冬,秋冬東,冬東' ELSE 'abc,チョコ' END AS tokens FROM part""")
def lexical_token_lists(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("東西"), F.when(F.col("p_size") % 2 == 0, "南").otherwise(""))).when(k == 1, "春夏秋冬東").otherwise("学園")
    tokens = keys.lexical_tokens(F.concat(F.lit("ABC ドラマ チョコ xy "), text))
    order = F.array(*[F.lit(x) for x in ("abc", "チョコ", "東西", "東西南", "春夏", "春夏秋", "春夏秋冬", "春夏秋冬東", "夏秋", "夏秋冬", "夏秋冬東", "秋冬", "秋冬東", "冬東")])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.concat(F.array_intersect(order, tokens), F.array_except(tokens, order)), ",").alias("tokens"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 20 = 0 AS missing, o_orderkey % 6 = 0 AS stale, o_orderkey % 5 = 0 AS strange, o_orderstatus <> 'F' AS differs FROM orders)
SELECT o_orderkey, CASE WHEN missing OR strange OR stale AND differs THEN 'blocked' WHEN differs THEN 'would_update' ELSE 'already_current' END AS status, concat_ws(',', CASE WHEN missing THEN 'missing_target' END, CASE WHEN NOT missing AND stale AND differs THEN 'stale_snapshot' END, CASE WHEN strange THEN 'unexpected_field:owner' END) AS blockers,
  CASE WHEN NOT missing AND differs THEN 'o_orderstatus' ELSE '' END AS changed FROM c""")
def patch_dry_run(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    snapshot = values.fingerprint(F.col("o_orderstatus"), F.col("o_orderpriority"))
    patch = F.map_concat(F.create_map(F.lit("o_orderstatus"), F.lit("F")), F.when(k % 5 == 0, F.create_map(F.lit("owner"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    patches = rows.select(k, patch.alias("patch"), F.when(k % 6 != 0, snapshot).alias("expected"))
    out = release.patch_plan(rows.where(k % 20 != 0), patches, "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], snapshot)
    return out.select("o_orderkey", "status", F.array_join("blockers", ",").alias("blockers"), F.array_join("changed", ",").alias("changed"))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT CAST((n - 1) // 100 + 1 AS BIGINT) AS wave, CAST((n - 1) // 25 % 4 + 1 AS BIGINT) AS chunk, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, max(n) AS upto FROM o GROUP BY 1, 2""")
def chunk_boundaries(spark, d):
    rows = ranking.waves(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 25, 4)
    return ranking.chunk_ends(rows, ["wave", "chunk"], "ordinal", "o_orderkey")


@query("""
WITH f AS (SELECT * FROM customer WHERE CAST(c_custkey AS VARCHAR) = '7' OR contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) SELECT c_custkey, (SELECT count(*) FROM f) AS total FROM f ORDER BY c_custkey LIMIT 10 OFFSET 5""")
def counted_search(spark, d):
    page = catalog.counted_page(table(spark, d, "customer"), " 7 ", "c_custkey", [F.col("c_name"), F.col("c_mktsegment")], [F.col("c_custkey")], 10, 5)
    return page.select("c_custkey", "total")


@query("""
WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, 'supplies' AS kind, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS note FROM lineitem UNION ALL SELECT s_suppkey, s_nationkey, 'in', s_suppkey, 'N' FROM supplier)
SELECT 'e-' || substr(sha1(kind || '|' || s || '|' || p), 1, 16) AS edge_id, kind, s AS source_id, p AS target_id, arg_min(note, {'at': seq, 'first': note}) AS note FROM e GROUP BY kind, s, p""")
def work_edges(spark, d):
    def edges(df, kind, source, target, seq, note):
        rows = df.select(F.lit(kind).alias("kind"), F.col(source).alias("source_id"), F.col(target).cast("long").alias("target_id"), F.struct(seq.alias("at"), note.alias("first")).alias("seq"), note.alias("note"))
        return rows.withColumn("edge_id", graph.short_id("e", F.col("kind"), F.col("source_id"), F.col("target_id")))

    lines = edges(table(spark, d, "lineitem"), "supplies", "l_suppkey", "l_partkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_returnflag"))
    places = edges(table(spark, d, "supplier"), "in", "s_suppkey", "s_nationkey", F.col("s_suppkey"), F.lit("N"))
    return graph.nodes(lines, places, key="edge_id").select("edge_id", "kind", "source_id", "target_id", "note")


# -- files, written to the shared folder and read back ------------------------------------------


def _new_folder(spark):
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def jsonl_scan(spark, d):
    path = _new_folder(spark)
    writers.write_jsonl(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, gzip=True)
    return readers.jsonl(spark, path, "o_orderkey long, o_orderstatus string, o_orderpriority string")


@query("SELECT count(*) FILTER (o_orderkey % 9 <> 0) AS good, count(*) FILTER (o_orderkey % 9 = 0) AS bad, CAST(sum(CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END) AS BIGINT) AS keys FROM orders")
def lenient_scan(spark, d):
    path, k = _new_folder(spark), F.col("o_orderkey")
    line = F.when(k % 9 == 0, _word("{broken ", k)).when(k % 9 == 1, F.concat(F.lit('﻿{"k":'), k.cast("string"), F.lit("}\n   "))).otherwise(F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}")))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    good, bad = readers.jsonl_lenient(spark, path, "k long")
    return good.agg(F.count("*").alias("good"), F.sum("k").alias("keys")).join(F.broadcast(bad.agg(F.count("*").alias("bad"))))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'a \"q\", ' || p_name || chr(10) || 'b' END AS title FROM part")
def csv_scan(spark, d):
    path = _new_folder(spark)
    title = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit('a "q", '), "p_name", F.lit("\nb")))
    writers.write_csv(table(spark, d, "part").select("p_partkey", title.alias("title")), path)
    return readers.csv_rows(spark, path)


@query("SELECT part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'third' ELSE 'rest' END AS part FROM orders) GROUP BY 1 UNION ALL SELECT 'third', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0")
def split_and_appended_files(spark, d):
    path, log = _new_folder(spark), _new_folder(spark)
    orders = table(spark, d, "orders").select("o_orderkey")
    writers.write_split(orders, path, F.when(F.col("o_orderkey") % 3 == 0, "third").otherwise("rest"))
    for rest in (0, 3):
        writers.append_log(orders.where(F.col("o_orderkey") % 6 == rest), log)
    both = spark.read.schema("o_orderkey long, part string").json(path), readers.jsonl(spark, log, "o_orderkey long").withColumn("part", F.lit("third"))
    counted = [df.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")) for df in both]
    return counted[0].unionByName(counted[1])


@query("SELECT s_suppkey, 0 AS row_index, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'it''s (' || s_nationkey || ', \\)' END AS note FROM supplier UNION ALL SELECT s_suppkey, 1, 'second', '' FROM supplier")
def dump_scan(spark, d):
    path, k = _new_folder(spark), F.col("s_suppkey").cast("string")
    note = F.when(F.col("s_suppkey") % 4 == 0, "NULL").otherwise(F.concat(_word("'it''s (", F.col("s_nationkey")), F.lit(", \\\\)'")))
    statement = F.concat(F.lit("INSERT INTO `s` VALUES ("), k, F.lit(",'"), "s_name", F.lit("',"), note, F.lit("),("), k, F.lit(",'second','');"))
    table(spark, d, "supplier").select(statement.alias("value")).write.text(path)
    v = F.col("values")
    return readers.sql_dump(spark, path, {"s": ["id", "name", "note"]}).select(v["id"].cast("long").alias("s_suppkey"), "row_index", v["name"].alias("name"), v["note"].alias("note"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def unwrapped_rows(spark, d):
    packed = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 97).alias("k")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    text = F.when(F.col("k") % 3 == 0, F.col("rows")).when(F.col("k") % 3 == 1, F.concat(F.lit('{"works":'), "rows", F.lit(',"n":1}'))).otherwise(F.concat(F.lit('{"x":[],"items":'), "rows", F.lit("}")))
    each = readers.unwrapped(packed.select(text.alias("document")), "document")
    return each.select(F.from_json("document", "o_orderkey long, o_orderstatus string").alias("r")).select("r.*")


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM orders")
def file_receipts(spark, d):
    path = _new_folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return readers.integrity(spark, path).agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
