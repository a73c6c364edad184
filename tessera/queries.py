"""Registered queries of the catalog operators over the standard tables, each with its SQL.

The tables stand in for a catalog: documents, parts, orders and events play works, titles, claims
and submissions.  Arrays leave as delimited text, counts as longs, amounts rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.functions import values
from tessera.operators import aggregates, audits, classify, creators, diff, entity, folding, graph, matching, published, ranking, rules, survivorship, validation
from tessera.plans import catalog, incremental, release
from tessera.session import table
from tessera.sources import writers
from tessera.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its own name with the SQL for its rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- aggregation --------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(trim(event_type), ''), 'missing') AS event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_missing(spark, d):
    return aggregates.count_by(table(spark, d, "events"), "event_type")


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag,
  CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS l_linestatus, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())""")
def multi_dim_counts(spark, d):
    a, b = "l_returnflag", "l_linestatus"
    return aggregates.count_sets(table(spark, d, "lineitem"), [a], [b], [a, b], [])


@query("""
WITH k AS (SELECT user_id, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM k GROUP BY user_id""")
def entity_rollup(spark, d):
    return aggregates.histograms(table(spark, d, "events"), "user_id", "event_type")


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value >= 50) AS large,
  count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def conditional_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") >= 50).alias("large"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT count(*) AS n, md5(string_agg(CAST(n_nationkey AS VARCHAR), chr(10) ORDER BY CAST(n_nationkey AS VARCHAR))) AS digest FROM nation")
def ordered_digest(spark, d):
    return aggregates.ordered_digest(table(spark, d, "nation"), "n_nationkey")


@query("SELECT count(*) AS n, md5(string_agg(s_name, chr(10) ORDER BY length(s_name), s_name)) AS digest FROM supplier")
def ordered_digest_by_length(spark, d):
    return aggregates.ordered_digest(table(spark, d, "supplier"), "s_name", by_length=True)


@query("""
WITH c AS (SELECT user_id, event_type AS tag, count(*) AS n FROM events GROUP BY ALL),
w(tag, weight) AS (VALUES ('purchase', 5), ('click', 1), ('view', 2))
SELECT user_id, CAST(sum(n * weight) AS BIGINT) AS score, max(n * weight) AS best, round(least(1.0::DOUBLE, sum(n * weight) / 100.0::DOUBLE), 6) AS share
FROM c JOIN w USING (tag) GROUP BY user_id""")
def weighted_tag_score(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("tag")).agg(F.count("*").alias("n"))
    weights = spark.createDataFrame([("purchase", 5), ("click", 1), ("view", 2)], "tag string, weight long")
    return aggregates.weighted_score(c, "user_id", "tag", "n", weights).withColumn("share", F.round("share", 6))


_FAMILY = "SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS token FROM conversations"


@query(f"WITH t AS ({_FAMILY}) SELECT conv_id, token, count(*) AS members FROM t GROUP BY ALL HAVING count(*) >= 2")
def family_tokens(spark, d):
    return aggregates.shared_tokens(table(spark, d, "conversations"), "conv_id", "turn", keys.latin_tokens(F.col("text")))


@query(f"""
WITH t AS ({_FAMILY}), s AS (SELECT conv_id, token FROM t GROUP BY ALL HAVING count(*) >= 2),
linked AS (SELECT DISTINCT conv_id, turn FROM t JOIN s USING (conv_id, token)),
big AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) > 1)
SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM big)
  AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.conv_id = conversations.conv_id AND l.turn = conversations.turn)""")
def family_outliers(spark, d):
    return aggregates.without_shared_token(table(spark, d, "conversations"), "conv_id", "turn", keys.latin_tokens(F.col("text")))


@query("""
SELECT o_custkey, count(*) AS n, max(9 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS rank,
  arg_max(o_orderkey, {'r': 9 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 'k': -o_orderkey}) AS o_orderkey
FROM orders GROUP BY o_custkey""")
def worst_of_group(spark, d):
    o = table(spark, d, "orders")
    return aggregates.worst_of(o, "o_custkey", F.lit(9) - F.substring("o_orderpriority", 1, 1).cast("int"), [F.col("o_orderkey")], "o_orderkey")


@query("""
WITH f AS (SELECT l_orderkey, 'flag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linestatus FROM lineitem),
g AS (SELECT l_orderkey, field, count(DISTINCT value) AS n, min(value) AS v, string_agg(DISTINCT value, '|' ORDER BY value) AS vs FROM f GROUP BY ALL)
SELECT l_orderkey, field, CASE WHEN n = 1 THEN v END AS value, n > 1 AS conflict, vs AS "values" FROM g""")
def merged_external_values(spark, d):
    li = table(spark, d, "lineitem")
    long = li.select("l_orderkey", F.explode(F.array(F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value")), F.struct(F.lit("status").alias("field"), F.col("l_linestatus").alias("value")))).alias("f")).select("l_orderkey", "f.*")
    return aggregates.merged_values(long, "l_orderkey", "field", "value")


@query("""
SELECT page_id, (CASE WHEN trim(url) <> '' THEN 2 ELSE 0 END + CASE WHEN trim(html) <> '' THEN 3 ELSE 0 END)::DOUBLE AS score FROM pages""")
def completeness_score(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", aggregates.completeness(p, {"url": 2.0, "html": 3.0}).alias("score"))


@query("SELECT CAST(sum(n) AS BIGINT) AS total, (SELECT count(*) FROM orders) AS universe, sum(n) = (SELECT count(*) FROM orders) AS conserved FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def conservation(spark, d):
    o = table(spark, d, "orders")
    return aggregates.conserved(o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "o_orderstatus", "n", o.count())


# -- joins --------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, c_name, n_name, r_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS building_balance
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_enrich3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    base = matching.enrich(matching.enrich(matching.enrich(o, "c_custkey", c), "n_nationkey", n), "r_regionkey", table(spark, d, "region"))
    detail = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("building_balance"))
    return matching.enrich_if_same(base, detail, "c_custkey", "c_mktsegment", ["building_balance"]).select("o_orderkey", "c_name", "n_name", "r_name", "building_balance")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_orphans(spark, d):
    return matching.orphans(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_known(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""
WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 2), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT coalesce(s.k, c.k) AS k, CASE WHEN c.k IS NULL THEN 'only_left' WHEN s.k IS NULL THEN 'only_right' WHEN s.n = c.n THEN 'same' ELSE 'changed' END AS status, s.n AS n_left, c.n AS n_right
FROM s FULL JOIN c ON s.k = c.k""")
def full_outer_reconcile(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).where("n > 2")
    c = table(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return matching.reconcile(s, c, "k", ["n"])


def _halves(spark, d):
    p = table(spark, d, "part")
    return p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0")


@query("""
WITH r AS (SELECT * FROM part WHERE p_partkey % 2 = 1), w AS (SELECT * FROM part WHERE p_partkey % 2 = 0),
t0 AS (SELECT p_name || '|' || p_brand || '|' || p_type AS k, count(DISTINCT p_partkey) AS n, min(p_partkey) AS f FROM w GROUP BY 1),
t1 AS (SELECT p_name || '|' || p_brand AS k, count(DISTINCT p_partkey) AS n, min(p_partkey) AS f FROM w GROUP BY 1),
t2 AS (SELECT p_name AS k, count(DISTINCT p_partkey) AS n, min(p_partkey) AS f FROM w GROUP BY 1),
j AS (SELECT r.p_partkey, t0.n AS n0, t1.n AS n1, t2.n AS n2, t0.f AS f0, t1.f AS f1, t2.f AS f2 FROM r
  LEFT JOIN t0 ON t0.k = r.p_name || '|' || r.p_brand || '|' || r.p_type LEFT JOIN t1 ON t1.k = r.p_name || '|' || r.p_brand LEFT JOIN t2 ON t2.k = r.p_name),
m AS (SELECT p_partkey, CASE WHEN n0 IS NOT NULL THEN 'name_brand_type' WHEN n1 IS NOT NULL THEN 'name_brand' WHEN n2 IS NOT NULL THEN 'name' ELSE 'none' END AS tier, coalesce(n0, n1, n2, 0) AS n_matches, coalesce(f0, f1, f2) AS f FROM j)
SELECT p_partkey, CASE n_matches WHEN 0 THEN 'new' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, tier, n_matches, CASE WHEN n_matches = 1 THEN f END AS work FROM m""")
def cardinality_cascade(spark, d):
    records, works = _halves(spark, d)
    key = lambda *c: F.concat_ws("|", *c)
    tiers = [("name_brand_type", key("p_name", "p_brand", "p_type"), key("p_name", "p_brand", "p_type")), ("name_brand", key("p_name", "p_brand"), key("p_name", "p_brand")), ("name", F.col("p_name"), F.col("p_name"))]
    return matching.cascade(records, works, "p_partkey", "p_partkey", tiers).drop("works")


@query("""
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_orderkey AS a, CASE WHEN l_partkey % 5 = 0 THEN l_orderkey + 1 WHEN l_partkey % 7 = 0 THEN -1 ELSE l_orderkey END AS b FROM lineitem),
w AS (SELECT o_orderkey AS w, o_orderkey AS a, o_orderkey AS b FROM orders)
SELECT r.line, CASE WHEN x.w IS NULL AND y.w IS NULL THEN 'missing' WHEN x.w IS NULL OR y.w IS NULL THEN 'partial' WHEN x.w <> y.w THEN 'conflict' ELSE 'bound' END AS status,
  CASE WHEN x.w = y.w THEN x.w END AS work FROM r LEFT JOIN w x ON r.a = x.a LEFT JOIN w y ON r.b = y.b""")
def two_key_binding(spark, d):
    li = table(spark, d, "lineitem")
    other = F.when(F.col("l_partkey") % 5 == 0, F.col("l_orderkey") + 1).when(F.col("l_partkey") % 7 == 0, F.lit(-1)).otherwise(F.col("l_orderkey"))
    records = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_orderkey").alias("a"), other.alias("b"))
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_orderkey").alias("a"), F.col("o_orderkey").alias("b"))
    return matching.bind_exact(records, works, "line", "a", "b", "work")


@query("""
WITH g AS (SELECT doc_id, count(*) AS n, min(quality) AS q FROM labels GROUP BY 1), a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(a.doc_id, g.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'unknown' WHEN g.n IS NULL THEN 'missing' WHEN g.n > 1 THEN 'duplicate' ELSE 'accepted' END AS status,
  coalesce(g.n, 0) AS n_received, CASE WHEN a.doc_id IS NOT NULL AND g.n = 1 THEN q END AS quality FROM a FULL JOIN g ON a.doc_id = g.doc_id""")
def response_merge(spark, d):
    expected = table(spark, d, "documents").where("doc_id % 3 <> 0")  # requests went out for these
    return matching.merge_responses(expected, table(spark, d, "labels"), "doc_id", ["quality"])


@query("""
WITH t AS (SELECT DISTINCT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS token FROM benchmark),
rare AS (SELECT token FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12), k AS (SELECT * FROM t JOIN rare USING (token))
SELECT x.id AS a, y.id AS b, string_agg(token, ',' ORDER BY token) AS tokens, count(*) AS n FROM k x JOIN k y USING (token) WHERE x.id < y.id GROUP BY ALL""")
def rare_token_pairs(spark, d):
    return matching.token_pairs(table(spark, d, "benchmark"), "item_id", keys.latin_tokens(F.col("text")))


@query("""
WITH k AS (SELECT s_suppkey, unnest([s_nationkey || '|' || CAST(floor(s_acctbal / 500) AS BIGINT) || 'n', CAST(floor(s_acctbal / 20) AS BIGINT) || 'b']) AS k FROM supplier),
c AS (SELECT c_custkey, unnest([c_nationkey || '|' || CAST(floor(c_acctbal / 500) AS BIGINT) || 'n', CAST(floor(c_acctbal / 20) AS BIGINT) || 'b']) AS k FROM customer)
SELECT DISTINCT s_suppkey, c_custkey FROM k JOIN c USING (k)""")
def multi_key_matches(spark, d):
    """Suppliers and customers that agree in nation and coarse balance, or in fine balance."""
    floor = lambda c, n: F.floor(F.col(c) / n).cast("string")
    both = lambda p: F.array(F.concat(F.col(f"{p}_nationkey").cast("string"), F.lit("|"), floor(f"{p}_acctbal", 500), F.lit("n")), F.concat(floor(f"{p}_acctbal", 20), F.lit("b")))
    return matching.any_key_matches(table(spark, d, "supplier"), table(spark, d, "customer"), "s_suppkey", "c_custkey", both("s"), both("c"))


# -- order and windows --------------------------------------------------------------------------


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders)
SELECT o_orderkey, ordinal, CAST(floor((ordinal - 1) / 250) + 1 AS BIGINT) AS wave, CAST(floor((ordinal - 1) / 25) AS BIGINT) % 10 + 1 AS chunk FROM n""")
def wave_chunks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ranking.waves(o, ["o_orderdate", "o_orderkey"], 25, 10).select("o_orderkey", "ordinal", "wave", "chunk")


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type FROM events GROUP BY user_id")
def latest_event(spark, d):
    return ranking.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
WITH g AS (SELECT user_id, max({'v': CAST(round(value * 100) AS BIGINT), 'e': event_id}) FILTER (WHERE event_type <> 'error') AS good, max({'v': CAST(round(value * 100) AS BIGINT), 'e': event_id}) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT user_id, bad IS NOT NULL AND (good IS NULL OR bad >= good) AS blocked, CASE WHEN NOT (bad IS NOT NULL AND (good IS NULL OR bad >= good)) THEN good.e END AS event_id FROM g""")
def best_valid_or_blocked(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return ranking.best_unless_blocked(e, ["user_id"], [F.col("v"), F.col("event_id")], F.col("event_type") != "error").select("user_id", "blocked", "event_id")


@query("""
WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events)
SELECT event_id, event_type FROM n WHERE (event_type = 'click' AND k <= 50) OR (event_type = 'purchase' AND k <= 20) OR event_type NOT IN ('click', 'purchase')""")
def quota_select(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return ranking.quota(e, "event_type", {"click": 50, "purchase": 20}, [F.desc("value"), F.col("event_id")]).select("event_id", "event_type")


@query("""
WITH s AS (SELECT event_id, event_type = 'error' AS r, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS retries, count(*) FILTER (WHERE event_type <> 'error') AS fresh FROM events),
q AS (SELECT greatest(least(30, retries), least(retries, 100 - fresh)) AS n FROM c)
SELECT event_id, r AS retry FROM s, q WHERE CASE WHEN r THEN k <= n ELSE k <= 100 - n END""")
def reserve_select(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", (F.col("event_type") == "error").alias("retry"))
    return ranking.reserve(e, F.col("retry"), 100, 30, [F.col("ts"), F.col("event_id")]).select("event_id", "retry")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM part)
SELECT p_name, p_brand, p_partkey FROM n WHERE k = 1""")
def elect_primary(spark, d):
    p = table(spark, d, "part")
    return ranking.elect(p, ["p_name", "p_brand"], [F.desc("p_retailprice"), F.col("p_size"), F.col("p_partkey")]).select("p_name", "p_brand", "p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 50")
def keyset_page(spark, d):
    return ranking.keyset_page(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 50)


@query("""
WITH RECURSIVE f AS (SELECT s_nationkey AS k, count(*) AS n, row_number() OVER (ORDER BY s_nationkey) AS i FROM supplier GROUP BY 1),
p(i, k, n, room, batch) AS (
  SELECT i, k, n, n, CAST(1 AS BIGINT) FROM f WHERE i = 1
  UNION ALL SELECT f.i, f.k, f.n, CASE WHEN room + f.n > 12 THEN f.n ELSE room + f.n END, batch + CASE WHEN room + f.n > 12 THEN 1 ELSE 0 END FROM p JOIN f ON f.i = p.i + 1)
SELECT k, n, batch FROM p""")
def family_packing(spark, d):
    f = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return ranking.packed(f.withColumn("o", F.col("k")), "k", "n", "o", 12)


@query("""
WITH t AS (SELECT s_suppkey, s_name, CAST(CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS digits FROM supplier)
SELECT s_suppkey, regexp_replace(s_name, '[0-9]+', lpad(digits, 12, '0')) AS sort_key FROM t""")
def natural_order(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", keys.natural_key(F.col("s_name")).alias("sort_key"))


# -- differences --------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders),
x AS (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b), g AS (SELECT o_custkey, o_orderstatus, sum(d) AS d FROM x GROUP BY ALL)
SELECT o_custkey, o_orderstatus, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(d) AS BIGINT) AS n FROM g WHERE d <> 0""")
def bag_diff(spark, d):
    o = table(spark, d, "orders")
    return diff.bag_difference(o.select("o_custkey", "o_orderstatus"), o.select("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")))


def _perturbed(li):
    """The same lines after an update of some quantities and flags."""
    return li.withColumns({"l_quantity": F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")), "l_returnflag": F.when(F.col("l_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_returnflag"))})


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 7 = 0 AS q, l_partkey % 11 = 0 AND l_returnflag IS NOT NULL AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q AND f THEN 'l_quantity,l_returnflag' WHEN q THEN 'l_quantity' ELSE 'l_returnflag' END AS changed FROM c WHERE (q OR f)
  AND (l_orderkey, l_linenumber, l_partkey, l_suppkey) IN (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) = 1)""")
def changed_fields(spark, d):
    li = table(spark, d, "lineitem")
    once = li.groupBy(*_LINE_KEYS).agg(F.count("*").alias("c")).where("c = 1").drop("c")
    li = li.join(once, _LINE_KEYS, "left_semi")
    out = diff.changed_fields(li, _perturbed(li), _LINE_KEYS, ["l_quantity", "l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", F.array_join("changed", ",").alias("changed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN 'removed' ELSE 'changed' END AS problem FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey % 77 = 0")
def immutability_check(spark, d):
    o = table(spark, d, "orders")
    after = o.where("o_orderkey % 500 <> 0").withColumns({"o_orderstatus": F.lit("Z"), "o_custkey": F.when(F.col("o_orderkey") % 77 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))})
    return diff.immutable_but(o, after, ["o_orderkey"], ["o_orderstatus"])


# -- entity resolution --------------------------------------------------------------------------

_CHARS = "list_distinct(list_filter(string_split({t}, ''), lambda c: c <> ''))"


@query("""
WITH t AS (SELECT p_brand AS b, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY ALL),
p AS (SELECT x.b, x.t AS t1, y.t AS t2, x.first AS id1, y.first AS id2 FROM t x JOIN t y ON x.b = y.b AND x.t < y.t),
s AS (SELECT *, CASE WHEN length(t1) <= length(t2) THEN t1 ELSE t2 END AS sh, CASE WHEN length(t1) <= length(t2) THEN t2 ELSE t1 END AS lo FROM p),
r AS (SELECT *, CASE WHEN contains(lo, sh) AND length(sh) >= 4 THEN length(sh) / length(lo)::DOUBLE ELSE jaccard(t1, t2) END AS score FROM s)
SELECT b, id1, id2, round(score, 6) AS score FROM r WHERE score >= 0.8""")
def title_similarity(spark, d):
    p = table(spark, d, "part")
    title = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    return entity.similar_pairs(p, "p_partkey", "p_brand", title, 0.8).select("b", "id1", "id2", F.round("score", 6).alias("score"))


@query("""
WITH r AS (SELECT p_partkey, p_brand AS b, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t FROM part),
t AS (SELECT b, t, min(p_partkey) AS first, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT x.first, y.n, x.t AS t1, y.t AS t2, CASE WHEN length(x.t) <= length(y.t) THEN x.t ELSE y.t END AS sh, CASE WHEN length(x.t) <= length(y.t) THEN y.t ELSE x.t END AS lo FROM t x JOIN t y ON x.b = y.b AND x.t <> y.t),
l AS (SELECT first, sum(n) AS near FROM p WHERE CASE WHEN contains(lo, sh) AND length(sh) >= 4 THEN length(sh) / length(lo)::DOUBLE ELSE jaccard(t1, t2) END >= 0.8 GROUP BY first)
SELECT p_partkey, r.b, t.first, CAST(t.n - 1 + coalesce(near, 0) AS BIGINT) AS links FROM r JOIN t ON r.b = t.b AND r.t = t.t LEFT JOIN l ON l.first = t.first""")
def title_members(spark, d):
    """Every part's class in title_similarity, whose pairs name classes by their least ids."""
    title = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    return entity.similar_members(table(spark, d, "part"), "p_partkey", "p_brand", title, 0.8).select(F.col("id").alias("p_partkey"), "b", "first", "links")


@query(r"""
WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[\s\p{Z}\p{P}\p{S}]+', '', 'g') AS k FROM documents),
g AS (SELECT k, min(doc_id) AS first_id, count(*) AS n FROM k WHERE length(k) >= 80 GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, first_id, n FROM k JOIN g USING (k)""")
def dup_text_groups(spark, d):
    return entity.long_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("""
WITH RECURSIVE k AS (SELECT c_custkey AS id, unnest(['n' || c_nationkey || '|' || c_mktsegment || '|' || CAST(floor(c_acctbal / 20) AS BIGINT), 'b' || CAST(floor(c_acctbal * 10) AS BIGINT)]) AS k FROM customer),
f AS (SELECT k, min(id) AS f FROM k GROUP BY 1), e AS (SELECT DISTINCT id, f FROM k JOIN f USING (k) WHERE id <> f),
b AS (SELECT id AS x, f AS y FROM e UNION SELECT f, id FROM e),
r(id, c) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT b.y, r.c FROM r JOIN b ON r.id = b.x)
SELECT id AS c_custkey, min(c) AS component FROM r GROUP BY 1""")
def strong_key_components(spark, d):
    c = table(spark, d, "customer")
    floor = lambda x: F.floor(x).cast("string")
    first = F.concat_ws("|", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_mktsegment", floor(F.col("c_acctbal") / 20))
    return entity.strong_components(c, "c_custkey", first, F.concat(F.lit("b"), floor(F.col("c_acctbal") * 10)))


@query("""
WITH p AS (SELECT p_name AS k, p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY ALL) SELECT k, max(n) AS identities FROM p GROUP BY 1 HAVING max(n) > 1""")
def ambiguous_keys(spark, d):
    return entity.ambiguous_keys(table(spark, d, "part").withColumn("k", F.col("p_name")), "k", "p_brand", "p_size")


@query("""
WITH m AS (SELECT doc_id, text, lang, source, md5(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS g FROM documents)
SELECT g, count(*) AS members, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang, arg_max(doc_id, {'l': length(text), 'd': -doc_id}) AS longest, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM m GROUP BY g""")
def golden_record(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.char_length("text").alias("len"), F.md5(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("g"))
    out = entity.golden_records(docs, "g", [F.col("doc_id")], {"first_doc": ("min", F.col("doc_id")), "lang": ("first", None), "sources": ("all", F.col("source")), "longest": ("max", F.struct("len", (-F.col("doc_id")).alias("d")))})
    return out.select("g", "members", "first_doc", "lang", (-F.col("longest.d")).alias("longest"), F.array_join("sources", ",").alias("sources"))


@query(None)
def constrained_merge(spark, d):
    """Parts as works: name as title, brand as provider, size as the provider's id; tested by brute force."""
    p = table(spark, d, "part")
    works = p.select(F.col("p_partkey").alias("work_id"), F.col("p_partkey").alias("ordinal"), F.concat_ws("|", F.lower("p_brand"), F.col("p_retailprice").cast("string")).alias("exact_identity"), F.col("p_brand").alias("provider"), F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("site_id"), F.col("p_type").alias("bucket"), F.array(F.concat_ws(" ", "p_name", F.floor(F.col("p_retailprice") / 10).cast("string"))).alias("titles"))
    return entity.constrained_merge(works, compose=False)


@query("""
WITH c AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || CAST(p_size % 4 AS VARCHAR) AS t, p_type AS media, 1990 + p_size % 3 AS y, p_brand || CAST(p_size AS VARCHAR) AS s FROM part),
f AS (SELECT t, min(id) AS first FROM c GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, a.s = b.s AS same_site, a.media = b.media AS m FROM f JOIN c a ON a.id = f.first JOIN c b ON b.t = f.t AND b.id <> f.first)
SELECT a, b, CASE WHEN same_site OR m THEN 'merge' ELSE 'conflict' END AS action,
  CASE WHEN same_site THEN 'exact_site_id' WHEN m THEN 'exact_original_title' ELSE 'same_title_different_media' END AS confidence FROM p""")
def pair_decisions(spark, d):
    p = table(spark, d, "part")
    title = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", ""), (F.col("p_size") % 4).cast("string"))
    c = p.select(F.col("p_partkey").alias("id"), title.alias("t"), F.struct(F.concat("p_brand", F.col("p_size").cast("string")).alias("site_id"), title.alias("original_title"), F.array(title).alias("titles"), F.array("p_name").alias("names"), F.col("p_type").alias("media"), (1990 + F.col("p_size") % 3).alias("year"), F.lit("").alias("provider_id"), F.create_map().cast("map<string,string>").alias("external_ids")).alias("c"))
    # Each part against the first of its title: one pair a row, however common a title is.
    first = c.groupBy("t").agg(F.min_by(F.struct("id", "c"), "id").alias("f")).select("t", F.col("f.id").alias("a"), F.col("f.c").alias("left"))
    pairs = first.join(c.select("t", F.col("id").alias("b"), F.col("c").alias("right")), "t").where("a <> b")
    return entity.decide_pairs(pairs, "left", "right").select("a", "b", "action", "confidence")


@query("""
WITH c AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || CAST(p_size % 4 AS VARCHAR) AS t, p_type AS media, 1990 + p_size % 3 AS y, p_brand || CAST(p_size AS VARCHAR) AS s FROM part),
k AS (SELECT *, min(id) OVER (PARTITION BY t, media, y) AS rep, count(*) OVER (PARTITION BY t, media, y) AS n, min(id) OVER (PARTITION BY t, s) AS same FROM c),
r AS (SELECT DISTINCT t, media, rep, n FROM k)
SELECT 'classes' AS kind, x.rep AS a, y.rep AS b, CASE WHEN x.media = y.media THEN 'merge' ELSE 'conflict' END AS action, CASE WHEN x.media = y.media THEN 'exact_original_title' ELSE 'same_title_different_media' END AS confidence
FROM r x JOIN r y ON x.t = y.t AND (x.rep < y.rep OR x.rep = y.rep AND x.n > 1)
UNION ALL SELECT 'member', rep, id, NULL, NULL FROM k UNION ALL SELECT 'site', same, id, 'merge', 'exact_site_id' FROM k WHERE id <> same""")
def all_pair_decisions(spark, d):
    """The candidates of pair_decisions, each against every other of its title, by classes."""
    title = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", ""), (F.col("p_size") % 4).cast("string"))
    c = F.struct(F.concat("p_brand", F.col("p_size").cast("string")).alias("site_id"), title.alias("original_title"), F.array(title).alias("titles"), F.array("p_name").alias("names"), F.col("p_type").alias("media"), (1990 + F.col("p_size") % 3).alias("year"), F.lit("").alias("provider_id"), F.create_map().cast("map<string,string>").alias("external_ids"))
    return entity.block_decisions(table(spark, d, "part").select("p_partkey", title.alias("t"), c.alias("c")), "p_partkey", "t")


@query("""
WITH r AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'no_orders' END,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'household' END], lambda x: x IS NOT NULL) AS r FROM customer)
SELECT c_custkey, array_to_string(r, ',') AS reasons FROM r WHERE len(r) > 0""")
def exclusion_ledger(spark, d):
    c = table(spark, d, "customer")
    bought = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("bought", F.lit(True))
    joined = c.join(bought, "c_custkey", "left")
    out = matching.with_reasons(joined, {"negative_balance": F.col("c_acctbal") < 0, "no_orders": F.col("bought").isNull(), "household": F.col("c_mktsegment") == "HOUSEHOLD"})
    return out.where(F.size("reasons") > 0).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


# -- graph --------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS entity, unnest([{'k': 'name', 'v': s_name}, {'k': 'nation', 'v': CAST(s_nationkey AS VARCHAR)}]) AS e FROM supplier)
SELECT entity, e.k AS kind, e.v AS value, 'node' AS level, 'ev-' || substr(sha1(entity || '|' || e.k || '|' || e.v), 1, 16) AS evidence_id FROM e""")
def evidence_fanout(spark, d):
    return graph.evidence(table(spark, d, "supplier"), "s_suppkey", {"name": F.col("s_name"), "nation": F.col("s_nationkey")})


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def nodes_lacking_edge(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "large_return").otherwise("other").alias("edge_type"))
    return graph.lacking(table(spark, d, "supplier"), edges, "large_return", node="s_suppkey").select("s_suppkey")


@query("""
WITH e AS (SELECT l_suppkey AS s, l_partkey % 100 AS t, l_returnflag AS k FROM lineitem), n AS (SELECT s_suppkey AS i FROM supplier)
SELECT 'self_link' AS problem, count(*) AS n FROM e WHERE s = t
UNION ALL SELECT 'orphan_endpoint', count(*) FROM (SELECT s AS x FROM e UNION ALL SELECT t FROM e) WHERE x NOT IN (SELECT i FROM n)
UNION ALL SELECT 'duplicate_edge', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM e GROUP BY s, t, k)""")
def graph_audit(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 100).alias("target_id"), F.col("l_returnflag").alias("edge_type"))
    return graph.audit(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), edges)


@query("""
WITH p AS (SELECT l_suppkey, l_partkey, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, max(q) AS best, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS members, count(*) AS n,
  CASE WHEN max(q) >= 50 THEN 'strong' WHEN max(q) >= 48 THEN 'medium' ELSE 'none' END AS band FROM p GROUP BY 1""")
def candidate_groups(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return graph.grouped_candidates(pairs, "l_suppkey", "l_partkey", "q").withColumn("band", graph.band(F.col("best"), {"strong": 50, "medium": 48}))


# -- rules --------------------------------------------------------------------------------------


def _graded(spark, d):
    letter = lambda c: F.element_at(F.array(*[F.lit(g) for g in ("S", "a", "B", "C", "AA", "", "F", "Q")]), (c % 8 + 1).cast("int"))
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", letter(F.col("l_partkey")).alias("core"), letter(F.col("l_suppkey")).alias("best"), letter(F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("likely"), letter(F.col("l_suppkey") + F.col("l_linenumber") % 3).alias("worst"), F.element_at(F.array(F.lit("fixed_grade"), F.lit("bounded_range"), F.lit(""), F.lit("labels_only")), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("mode"), (F.col("l_orderkey") % 13 == 0).alias("blocked"), (F.col("l_partkey") % 3).alias("labels"), (F.col("l_suppkey") % 2).alias("unresolved"), (F.col("l_quantity") > 40).alias("review"), F.lit("").alias("queue"), F.lit(False).alias("insufficient"))


_LETTER = "['S','A','B','C','S','','F',''][CAST(({x}) % 8 AS INTEGER) + 1]"
_RAW = "['S','a','B','C','AA','','F','Q'][CAST(({x}) % 8 AS INTEGER) + 1]"
_RANK = "list_position(['S','A','B','C','D','E','F','X'], {x})"


@query(f"""
WITH g AS (SELECT l_orderkey, l_linenumber, {_LETTER.format(x='l_partkey')} AS core, {_LETTER.format(x='l_suppkey')} AS best, {_LETTER.format(x='l_suppkey + l_linenumber % 2')} AS likely, {_LETTER.format(x='l_suppkey + l_linenumber % 3')} AS worst,
  {_RAW.format(x='l_suppkey')} AS r1, {_RAW.format(x='l_suppkey + l_linenumber % 2')} AS r2, {_RAW.format(x='l_suppkey + l_linenumber % 3')} AS r3,
  ['fixed_grade','bounded_range','','labels_only'][CAST(l_orderkey % 4 AS INTEGER) + 1] AS mode, l_orderkey % 13 = 0 AS blocked, l_partkey % 3 AS labels, l_suppkey % 2 AS unresolved, l_quantity > 40 AS review FROM lineitem),
f AS (SELECT *, best <> '' AND likely <> '' AND worst <> '' AS complete, (r1 <> '')::INT + (r2 <> '')::INT + (r3 <> '')::INT AS given, (best <> '')::INT + (likely <> '')::INT + (worst <> '')::INT AS legal,
  coalesce(best <> '' AND likely <> '' AND worst <> '' AND {_RANK.format(x='best')} <= {_RANK.format(x='likely')} AND {_RANK.format(x='likely')} <= {_RANK.format(x='worst')}, false) AS ordered, core <> '' AND core <> likely AS mismatch FROM g),
h AS (SELECT *, ordered AND best = worst AS equal FROM f),
m AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN mode = 'labels_only' THEN 'labels_only'
    WHEN mode = 'bounded_range' THEN CASE WHEN ordered AND NOT equal THEN 'bounded_range' ELSE 'labels_only' END
    WHEN mode = 'fixed_grade' THEN CASE WHEN core <> '' AND given = 3 AND equal AND NOT mismatch THEN 'fixed_grade' ELSE 'labels_only' END
    WHEN given > 0 AND NOT complete THEN 'labels_only' WHEN complete AND NOT ordered THEN 'labels_only' WHEN ordered AND NOT equal THEN 'bounded_range'
    WHEN equal THEN CASE WHEN mismatch THEN 'labels_only' ELSE 'fixed_grade' END WHEN core <> '' THEN 'fixed_grade' WHEN labels > 0 OR unresolved > 0 THEN 'labels_only' ELSE 'unscanned' END AS conclusion_mode FROM h)
SELECT l_orderkey, l_linenumber, conclusion_mode, CASE WHEN conclusion_mode <> 'fixed_grade' THEN '' WHEN mode = 'fixed_grade' OR NOT equal THEN core ELSE likely END AS fixed_grade,
  array_to_string(list_filter([
    CASE WHEN conclusion_mode = 'bounded_range' AND mismatch THEN 'core_likely_mismatch' END,
    CASE WHEN NOT blocked AND mode = 'bounded_range' AND conclusion_mode = 'labels_only' THEN CASE WHEN complete THEN 'bounded_range_not_distinct' ELSE 'invalid_bounded_range' END END,
    CASE WHEN NOT blocked AND mode = 'fixed_grade' AND conclusion_mode = 'labels_only' THEN CASE WHEN core = '' THEN 'invalid_fixed_grade' WHEN given <> 3 OR NOT complete THEN 'incomplete_fixed_grade_range' ELSE 'fixed_grade_conflict' END END,
    CASE WHEN NOT blocked AND mode = '' AND given > 0 AND NOT complete THEN 'missing_range_grade' END,
    CASE WHEN NOT blocked AND mode = '' AND given > 0 AND NOT complete AND legal <> given THEN 'invalid_range_grade' END,
    CASE WHEN NOT blocked AND mode = '' AND complete AND NOT ordered THEN 'range_order_invalid' END,
    CASE WHEN NOT blocked AND mode = '' AND equal AND mismatch THEN 'fixed_grade_conflict' END], lambda x: x IS NOT NULL), ',') AS issues,
  array_to_string(list_filter([CASE WHEN conclusion_mode = 'bounded_range' THEN 'bounded_range' END, CASE WHEN review THEN 'requires_human_review' END, CASE WHEN unresolved > 0 THEN 'unresolved_dimensions' END], lambda x: x IS NOT NULL), ',') AS pending FROM m""")
def conclusion_machine(spark, d):
    out = rules.conclusions(_graded(spark, d))
    return out.select("l_orderkey", "l_linenumber", "conclusion_mode", "fixed_grade", F.array_join("issues", ",").alias("issues"), F.array_join("pending", ",").alias("pending"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'human' WHEN o_totalprice > 250000 AND o_orderstatus = 'F' THEN 'published' WHEN o_orderpriority = '1-URGENT' THEN 'candidate' WHEN o_custkey % 2 = 0 THEN 'research' ELSE 'unassessed' END AS layer,
  CASE WHEN o_orderkey % 5 = 0 THEN 'h' WHEN o_totalprice > 250000 AND o_orderstatus = 'F' THEN o_orderstatus WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS value,
  CASE WHEN o_orderkey % 5 = 0 THEN 'human' WHEN o_totalprice > 250000 THEN CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'blocked_published' END WHEN o_custkey % 2 = 0 THEN 'research' ELSE 'unassessed' END AS bucket FROM orders""")
def authority_precedence(spark, d):
    o = table(spark, d, "orders")
    large, final, even = F.col("o_totalprice") > 250000, F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0
    human = F.col("o_orderkey") % 5 == 0
    out = rules.authority(o, [("human", human, F.lit("h")), ("published", large & final, F.col("o_orderstatus")), ("candidate", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")), ("research", even, F.col("o_custkey"))])
    return rules.presence_first(out, [("human", human, F.lit(True)), ("published", large, final), ("research", even, F.lit(True))]).select("o_orderkey", "layer", "value", "bucket")


@query("""
WITH r AS (SELECT l_orderkey, l_returnflag || l_linestatus || (l_partkey % 3) AS code, ['S','A','C','E','F'][CAST(l_partkey % 5 AS INTEGER) + 1] AS grade, [0,1,3,5,6][CAST(l_partkey % 5 AS INTEGER) + 1] AS rank, l_discount * 10 AS conf FROM lineitem WHERE l_discount * 10 >= 0.5),
f AS (SELECT l_orderkey, min({'s': -rank, 'c': -conf, 'k': code, 'g': grade}) AS first FROM r GROUP BY 1),
o AS (SELECT o_orderkey, (o_custkey % 10) / 10.0::DOUBLE AS cov FROM orders),
j AS (SELECT o.*, f.first, CASE WHEN f.first IS NULL OR (f.first.g IN ('S', 'A') AND cov < 0.5) THEN true ELSE false END AS fell FROM o LEFT JOIN f ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN fell THEN 'D-UNCLEAR' ELSE first.k END AS decisive_code, CASE WHEN fell THEN 'D' ELSE first.g END AS decisive_grade FROM j""")
def rule_resolution(spark, d):
    li = table(spark, d, "lineitem")
    grade = F.element_at(F.array(*[F.lit(g) for g in "SACEF"]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rule = F.struct(F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).cast("string")).alias("code"), grade.alias("grade"), F.lit(True).alias("matched"), (F.col("l_discount") * 10).alias("confidence"), F.lit("weak").alias("status"))
    matched = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(rule).alias("rules"))
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10 / F.lit(10.0)).alias("evidence_coverage"), F.lit("weak").alias("evidence_status"), F.lit(False).alias("protected")).join(matched, "o_orderkey", "left")
    out = rules.resolve(rows, severity=("X", "F", "E", "D", "C", "B", "A", "S"), positive=("S", "A"), strong=("official",), contradictions={})
    return out.select("o_orderkey", "decisive_code", "decisive_grade")


# -- plans --------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'skip_protected' WHEN o_orderkey % 5 = 0 THEN 'research_new' WHEN o_orderkey % 7 = 0 THEN 'research_refresh_catalog_changed'
  WHEN o_custkey % 6 = 0 THEN 'research_retry_identity_review' WHEN o_custkey % 6 = 1 THEN 'research_retry_ai_qa_deferred' WHEN o_custkey % 4 = 3 THEN 'reassess_policy_changed'
  WHEN o_custkey % 6 = 2 THEN 'skip_completed_unchanged' WHEN o_custkey % 6 = 3 THEN 'reassess_legacy_assessment' WHEN o_custkey % 6 = 4 THEN 'assess_existing_research' ELSE 'research_retry_incomplete' END AS action FROM orders""")
def incremental_decide(spark, d):
    o = table(spark, d, "orders")
    print_of = values.fingerprint(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    rows = o.select("o_orderkey", print_of.alias("fingerprint"), (F.col("o_orderkey") % 17 == 0).alias("protected"))
    r = F.col("o_custkey") % 6
    ledger = o.where("o_orderkey % 5 <> 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "old").otherwise(print_of).alias("old_fingerprint"),
        F.when(r == 0, "identity_review").when(r == 4, "ready_for_ai_assessment").otherwise("").alias("research_status"),
        F.when(F.col("o_custkey") % 4 == 3, "p1").otherwise("p2").alias("policy_version"), F.lit(None).cast("string").alias("profile_id"),
        F.when(r == 1, "ai_qa_deferred").when(r == 2, "ai_qa_passed").when(r == 3, "legacy_assessed").alias("qa_status"),
    )
    return incremental.decide(rows, ledger, "o_orderkey", policy="p2").select("o_orderkey", "action")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'ready_create' WHEN o_orderkey % 13 = 0 THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'ready_update' ELSE 'already_current' END AS status,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 3 = 0 THEN 'o_orderstatus' ELSE '' END AS changed FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)
UNION ALL SELECT o_orderkey, 'blocked', '' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 = 0
UNION ALL SELECT -n_nationkey - 1, 'outside_release', '' FROM nation""")
def upsert_plan(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    current = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus")))
    extra = table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("o_orderkey"), F.lit("-").alias("o_orderstatus"), F.lit(0).cast("long").alias("o_custkey"))
    plan = release.plan_upserts(o, current.unionByName(extra), "o_orderkey", ["o_orderstatus", "o_custkey"], F.col("o_orderkey") % 13 == 0)
    return plan.select("o_orderkey", "status", F.array_join("changed", ",").alias("changed"))


@query("""
WITH b AS (SELECT o_orderkey, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 9 = 0 THEN 'duplicate' WHEN b.h IS NULL THEN 'missing' WHEN o.o_orderkey % 4 = 0 THEN 'stale' ELSE 'ready' END AS status FROM orders o LEFT JOIN b ON o.o_orderkey = b.o_orderkey""")
def cas_check(spark, d):
    o = table(spark, d, "orders").withColumn("h", F.md5("o_orderstatus"))
    delta = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "stale").otherwise(F.col("h")).alias("want"))
    delta = delta.unionByName(delta.where("o_orderkey % 9 = 0"))
    return release.check_delta(o.where("o_orderkey % 5 <> 0"), delta, "o_orderkey", "h", "want")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def cas_apply(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.md5("o_orderstatus").alias("h"))
    delta = o.where("o_orderkey % 8 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), "h", F.col("h").alias("want"))
    return release.apply_delta(o, delta, "o_orderkey", "h", "want").select("o_orderkey", "o_orderstatus")


# -- catalog, scalars, intake -------------------------------------------------------------------


@query("""
WITH h AS (SELECT p_partkey, lower(p_name || chr(10) || p_brand || chr(10) || p_type) AS h, p_size, p_brand FROM part)
SELECT p_partkey FROM h WHERE contains(h, 'brand#1') AND p_brand = 'Brand#12' ORDER BY p_size DESC, p_partkey LIMIT 100""")
def search_list(spark, d):
    p = table(spark, d, "part")
    found = catalog.search(p, "  Brand#1", "p_partkey", catalog.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")))
    found = catalog.allowed(catalog.allowed(found, "p_brand", "Brand#12", ("Brand#11", "Brand#12")), "p_type", "nonsense", ("ECONOMY",))
    return catalog.page(found, [F.desc("p_size"), F.col("p_partkey")], 500, 0).select("p_partkey")


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS b FROM pages)
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/]*')), '^www\.', ''), ':\d+$', '') || regexp_replace(coalesce(regexp_extract(b, '^[^/]*(/.*)$', 1), ''), '/+$', '') AS url_key FROM u""")
def url_keys(spark, d):
    return table(spark, d, "pages").select("page_id", keys.url_key(F.col("url")).alias("url_key"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'TBA' ELSE strftime(o_orderdate, '%Y') || '-02-30' END AS label, o_orderdate FROM orders)
SELECT o_orderkey, label, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END AS "precision",
  CASE o_orderkey % 5 WHEN 0 THEN label WHEN 1 THEN label || '-01' WHEN 2 THEN label || '-01-01' END AS date FROM t""")
def fuzzy_dates(spark, d):
    r, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    label = F.when(r == 0, F.date_format(day, "yyyy-MM-dd")).when(r == 1, F.date_format(day, "yyyy-MM")).when(r == 2, F.date_format(day, "yyyy")).when(r == 3, "TBA").otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")))
    return table(spark, d, "orders").select("o_orderkey", values.fuzzy_date(label).alias("f")).select("o_orderkey", "f.*")


@query("SELECT event_id, CAST(floor((epoch_us(ts) + 500) / 1000) AS BIGINT) AS millis FROM events")
def ts_round3(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_millis(values.round_to_millis(F.col("ts").cast("timestamp"))).alias("millis"))


@query(r"""
SELECT p_partkey, regexp_replace(lower(p_name), '[\p{P}\p{S}\s]+', '', 'g') AS merge_title, regexp_replace(lower(p_name), '\s+', '', 'g') AS identity_title, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS descriptive,
  regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '', 'g') AS alnum_title, regexp_replace(lower(p_name), '[\s\p{P}\p{S}]+', '', 'g') AS summary, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM part""")
def title_keys(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", *[keys.key(k, name).alias(k) for k in ("merge_title", "identity_title", "descriptive", "alnum_title", "summary")], keys.slug(name).alias("slug"))


@query("""
WITH RECURSIVE e AS (
  SELECT event_id, date_trunc('day', ts) AS d, date_trunc('hour', ts) || ' ' || user_id AS u, event_type AS y, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT DISTINCT d, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS users, CAST([] AS VARCHAR[]) AS types, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS reason FROM e
  UNION ALL
  SELECT d, n, CASE WHEN r IS NULL THEN list_append(users, u) ELSE users END, CASE WHEN r IS NULL THEN list_append(types, y) ELSE types END, event_id, r
  FROM (SELECT e.*, s.users, s.types, CASE WHEN len(list_filter(s.users, lambda x: x = e.u)) >= 2 THEN 'hour_user_id' WHEN len(list_filter(s.types, lambda x: x = e.y)) >= 60 THEN 'day_event_type' END AS r
    FROM s JOIN e ON e.d = s.d AND e.n = s.n + 1))
SELECT event_id, reason, reason IS NULL AS admitted FROM s WHERE n > 0""")
def rate_caps(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return intake.capped(e, "ts", "event_id", [intake.Cap(2, ("user_id",), "hour"), intake.Cap(60, ("event_type",), "day")]).select("event_id", "reason", "admitted")


@query("""
WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT event_id, user_id, event_type, n, ts AS stored, true AS kept FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.n, CASE WHEN e.ts > s.stored + INTERVAL 2 HOURS THEN e.ts ELSE s.stored END, e.ts > s.stored + INTERVAL 2 HOURS
  FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.n = s.n + 1)
SELECT event_id FROM s WHERE kept""")
def online_dedup(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return intake.first_within(e, ["user_id", "event_type"], "ts", "event_id", "2 HOURS").select("event_id")


@query("""
WITH RECURSIVE o AS (SELECT event_id, ts, user_id AS u, event_type AS y, event_id % 3 AS c, event_id % 97 = 0 AS is_switch, (event_id // 97) % 3 = 0 AS off FROM events),
w AS (SELECT *, coalesce(last_value(CASE WHEN is_switch THEN off END IGNORE NULLS) OVER (ORDER BY ts, NOT is_switch, event_id), false) AS closed FROM o),
e AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS n FROM w WHERE NOT is_switch AND NOT closed),
s AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ts TIMESTAMP, y VARCHAR, c BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS verdict FROM e
  UNION ALL
  SELECT u, n, CASE WHEN r = 'accepted' THEN list_append(live, {'ts': ts, 'y': y, 'c': c}) ELSE live END, event_id, r
  FROM (SELECT *, CASE WHEN len(list_filter(live, lambda x: x.y = y)) >= 1 THEN 'duplicate' WHEN len(today) >= 3 OR len(live) >= 4 THEN 'daily_capacity' WHEN len(list_filter(today, lambda x: x.c = c)) >= 1 THEN 'rate_limited' ELSE 'accepted' END AS r
    FROM (SELECT *, list_filter(live, lambda x: date_trunc('day', x.ts) = date_trunc('day', ts)) AS today
      FROM (SELECT e.*, list_filter(s.held, lambda x: x.ts >= e.ts - INTERVAL 3 DAYS) AS live FROM s JOIN e ON e.u = s.u AND e.n = s.n + 1))))
SELECT event_id, verdict FROM s WHERE n > 0 UNION ALL SELECT event_id, 'closed' FROM w WHERE NOT is_switch AND closed""")
def intake_capacity(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    switch = F.col("event_id") % 97 == 0
    asked = intake.switched_off(e.where(~switch), e.where(switch).withColumn("disabled", F.floor(F.col("event_id") / 97) % 3 == 0), "ts", "event_id")
    open_rows = asked.where(~F.col("closed")).withColumn("client", F.col("event_id") % 3)
    taken = intake.inbox_verdicts(open_rows, intake.Inbox(3, 4, 1, "3 days"), "user_id", "ts", "event_id", "client", "event_type").select(F.col("tie_of").alias("event_id"), "verdict")
    return taken.unionByName(asked.where("closed").select("event_id", F.lit("closed").alias("verdict")))


@query("""
WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 2 = 0 THEN 'reserve' ELSE 'commit' END AS a FROM events),
h AS (SELECT *, max(CASE WHEN a = 'reserve' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e)
SELECT event_id, CASE WHEN r IS NULL THEN 'unknown' WHEN ts > r + INTERVAL 3 HOURS THEN 'expired' ELSE 'committed' END AS status FROM h WHERE a = 'commit'""")
def two_phase_intake(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 2 == 0, "reserve").otherwise("commit").alias("action"))
    return intake.reservations(e, "user_id", "ts", "event_id", "action", "3 HOURS").select("event_id", "status")


# -- classification -----------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' vol. ' || p_size WHEN 1 THEN ' ' || p_size WHEN 2 THEN ' Limited Edition' WHEN 3 THEN ' 番外' ELSE '' END AS title FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN 'child_candidate' WHEN p_partkey % 5 = 2 THEN 'edition_or_release_candidate' ELSE 'work_candidate' END AS boundary,
  CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN 'volume_like_title' WHEN p_partkey % 5 = 2 THEN 'edition_or_release_like_source_row' ELSE 'stable_work_candidate' END AS boundary_reason,
  CASE WHEN p_partkey % 5 = 3 OR p_partkey % 5 = 0 OR p_partkey % 5 = 1 THEN regexp_extract(title, '^([a-zA-Z# ]+?)( vol\. [0-9]+| [0-9]+| 番外)$', 1) ELSE '' END AS parent FROM t""")
def boundary_detection(spark, d):
    p = table(spark, d, "part")
    r = F.col("p_partkey") % 5
    tail = F.when(r == 0, F.concat(F.lit(" vol. "), F.col("p_size").cast("string"))).when(r == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(r == 2, " Limited Edition").when(r == 3, " 番外").otherwise("")
    rows = p.select("p_partkey", F.concat("p_name", tail).alias("title"), F.lit("").alias("raw_path"), F.lit("").alias("source_url"))
    return classify.boundary(rows).select("p_partkey", "boundary", "boundary_reason", "parent")


@query("""
WITH t AS (SELECT page_id, lower(html) AS h FROM pages), a AS (SELECT page_id, regexp_matches(h, 'restricted|hidden|quarantine') AS r, regexp_matches(h, 'doujinshi|loose extra') AS e FROM t)
SELECT page_id, CASE WHEN e AND r THEN 'doujinshi_or_extra,restricted' WHEN e THEN 'doujinshi_or_extra' WHEN r THEN 'restricted' ELSE '' END AS advisories, CASE WHEN r THEN 'restricted' WHEN e THEN 'adult' ELSE 'ordinary' END AS visibility FROM a""")
def content_advisories(spark, d):
    out = classify.advisories(table(spark, d, "pages"), F.col("html"))
    return out.select("page_id", F.array_join("advisories", ",").alias("advisories"), "visibility")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'w' END AS w, o_orderkey % 31 = 0 AS manual, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 's' END AS s, o_orderkey % 3 = 0 AS ai, o_orderkey % 2 = 0 AS complete, o_orderkey % 19 = 0 AS ident, o_orderkey % 23 = 0 AS prot,
  ['needs_external_research','ready_for_ai_assessment_with_warnings','needs_identity_or_series_review','?'][CAST(o_custkey % 4 AS INTEGER) + 1] AS ready FROM orders),
q AS (SELECT o_orderkey, CASE WHEN w = '' THEN 'invalid_record' WHEN manual THEN 'protected_or_manual_review' WHEN s = '' THEN 'invalid_record' WHEN ai AND complete THEN 'already_ai_assessed' WHEN ready = 'needs_identity_or_series_review' OR ident THEN 'identity_review'
  WHEN prot THEN 'protected_or_manual_review' WHEN ready = 'needs_external_research' THEN 'external_research' WHEN ready = 'ready_for_ai_assessment_with_warnings' THEN 'ready_for_ai_assessment' ELSE 'unclassified' END AS queue FROM r)
SELECT o_orderkey, queue, queue IN ('identity_review', 'external_research', 'ready_for_ai_assessment') AS actionable FROM q""")
def catalog_queues(spark, d):
    k = F.col("o_orderkey")
    ready = F.element_at(F.array(F.lit("needs_external_research"), F.lit("ready_for_ai_assessment_with_warnings"), F.lit("needs_identity_or_series_review"), F.lit("?")), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 50 == 0, "").otherwise("w").alias("work_id"), F.when(k % 37 == 0, "").otherwise("s").alias("site_id"), (k % 31 == 0).alias("manual"), (k % 3 == 0).alias("ai_marker"), (k % 2 == 0).alias("complete"), (k % 19 == 0).alias("identity"), (k % 23 == 0).alias("protected"), ready.alias("readiness"))
    return classify.queue(rows).select("o_orderkey", "queue", "actionable")


@query("""
WITH t AS (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' (' WHEN 1 THEN ': 「work」 監督' ELSE '' END AS n FROM supplier),
r AS (SELECT s_suppkey, (s_suppkey % 4 = 1)::INT * 11 + (s_suppkey % 4 = 0)::INT * 4 + (regexp_matches(lower(n), 's[0-9]+|vol|chapter|episode|season|scene|u[0-9]+|#[0-9]+'))::INT * 3 + (length(n) >= 24)::INT AS score FROM t)
SELECT s_suppkey, score, CASE WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS severity FROM r""")
def entity_risk(spark, d):
    r = F.col("s_suppkey") % 4
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.when(r == 0, " (").when(r == 1, ": 「work」 監督").otherwise("")).alias("n"))
    return classify.name_risk(rows, "n").select("s_suppkey", "score", "severity")


@query("""
WITH s AS (SELECT o_orderkey, ['multiple_secondary_supported','single_secondary_supported',' ','official'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS st, o_custkey % 3 AS n, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 101 END AS p FROM orders)
SELECT o_orderkey, CASE WHEN st = 'multiple_secondary_supported' AND n = 1 THEN 'single_secondary_supported' WHEN st IN ('multiple_secondary_supported', 'single_secondary_supported') AND n = 0 THEN 'insufficient_evidence' WHEN trim(st) = '' THEN 'unknown' ELSE st END AS evidence,
  CASE WHEN p IS NULL THEN 'none' WHEN p >= 90 THEN 'very_high' WHEN p >= 75 THEN 'high' WHEN p >= 50 THEN 'medium' ELSE 'low' END AS band FROM s""")
def evidence_bands(spark, d):
    status = F.element_at(F.array(F.lit("multiple_secondary_supported"), F.lit("single_secondary_supported"), F.lit(" "), F.lit("official")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    percent = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 101)
    return table(spark, d, "orders").select("o_orderkey", classify.honest_evidence(status, F.col("o_custkey") % 3).alias("evidence"), classify.band(percent).alias("band"))


@query("""
WITH s AS (SELECT o_orderkey, ['match','missing','other','absent','?'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS p, ['match','missing','other','absent','?'][CAST(o_custkey % 5 AS INTEGER) + 1] AS d FROM orders)
SELECT o_orderkey, CASE WHEN p = 'match' THEN 'published_matches' WHEN d = 'match' AND p = 'missing' THEN 'draft_only_match' WHEN d = 'match' AND p = 'other' THEN 'draft_matches_published_other' WHEN d = 'other' THEN 'draft_has_other'
  WHEN p = 'absent' OR d = 'absent' THEN 'work_or_plan_missing' WHEN p = 'missing' AND d = 'missing' THEN 'missing_from_both' ELSE 'needs_review' END AS status FROM s""")
def publication_gaps(spark, d):
    pick = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("match", "missing", "other", "absent", "?")]), (F.col(c) % 5 + 1).cast("int"))
    gap = classify.publication_gap(pick("o_orderkey"), pick("o_custkey"), match=("match",), missing=("missing",), absent=("absent",), other="other")
    return table(spark, d, "orders").select("o_orderkey", gap.alias("status"))


def _candidates(spark, d):
    """Parts as candidates; a twelfth of them lack their title, and every fifth carries an edition."""
    p = table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.regexp_replace("p_name", "^[^ ]* ", ""), F.lit(" "), F.floor(key / 40).cast("string"))
    edition = F.when(key % 5 == 0, " edition").otherwise("")
    return p.select(
        key.alias("ordinal"), F.when(key % 11 == 0, F.concat(F.lit("s"), F.floor(key / 33).cast("string"))).otherwise("").alias("site_id"), F.concat(name, edition).alias("title"),
        F.when(key % 12 == 0, "").otherwise(name).alias("original_title"), F.array(F.concat(F.lit("alias "), F.floor(key / 7).cast("string"))).alias("aliases"),
        F.element_at(F.array(F.lit("anime"), F.lit("game"), F.lit("unknown")), (size % 3 + 1).cast("int")).alias("media"), (1990 + size % 4).cast("int").alias("year"), F.when(size % 2 == 0, (size % 6).cast("string")).otherwise("").alias("provider_id"),
        F.create_map(F.lit("shop"), F.floor(key / 3).cast("string")).alias("external_ids"), F.col("p_brand").alias("brand"),
    )


@query(None)
def seq_dedup(spark, d):
    """Parts as candidates, folded in the order of their keys; tested against the fold by brute force."""
    return folding.sequential_dedup(_candidates(spark, d), norm=lambda c: keys.key("match_title", c, compose=False))


@query(None)
def dedup_conflicts(spark, d):
    """What folding the candidates leaves to a reviewer, similar titles within a brand."""
    norm = lambda c: keys.key("match_title", c, compose=False)
    candidates = _candidates(spark, d)
    return folding.dedup_conflicts(candidates, folding.sequential_dedup(candidates, norm=norm), norm=norm, block="brand")


# -- creators and survivorship ------------------------------------------------------------------


def _credits(spark, d):
    """Suppliers as creators of parts, return flags as roles."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("creator_id"), F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("role"), F.concat(F.lit("Name "), (F.col("l_suppkey") % 7).cast("string")).alias("name"))


@query("""
SELECT l_suppkey AS creator_id, l_partkey AS work_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles, 'Name ' || (l_suppkey % 7) AS "names" FROM lineitem GROUP BY l_suppkey, l_partkey""")
def creator_works(spark, d):
    return creators.works_of(_credits(spark, d))


@query("""
SELECT l_suppkey AS creator_id, count(DISTINCT l_partkey) AS works, CASE WHEN l_suppkey % 10 = 0 THEN 'review' WHEN count(DISTINCT l_partkey) >= CASE WHEN l_suppkey % 2 = 0 THEN 575 ELSE 590 END THEN 'selected' ELSE 'below' END AS decision FROM lineitem GROUP BY l_suppkey""")
def creator_selection(spark, d):
    counts = creators.work_counts(_credits(spark, d))
    kind = F.when(F.col("creator_id") % 2 == 0, "person").otherwise("organization")
    return creators.selected(counts, kind, {"person": 575, "organization": 590}, F.col("creator_id") % 10 == 0)


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS w, lower('Name ' || (l_suppkey % 7)) AS n, lower(l_returnflag) AS r, l_suppkey AS c FROM lineitem WHERE l_quantity > 25),
g AS (SELECT w, n, r, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM e GROUP BY ALL)
SELECT DISTINCT l_partkey AS work_id, l_returnflag AS role, 'Name ' || (l_suppkey % 7) AS name, coalesce(ids, '') AS creator_ids FROM lineitem LEFT JOIN g ON w = l_partkey AND n = lower('Name ' || (l_suppkey % 7)) AND r = lower(l_returnflag)""")
def credit_binding(spark, d):
    edges = _credits(spark, d).join(table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_suppkey").alias("creator_id"), F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("role")).distinct(), ["creator_id", "work_id", "role"], "left_semi")
    credits = _credits(spark, d).select("work_id", F.concat(F.lit(" "), F.upper("name")).alias("raw"), "role", "name").drop("raw").distinct()
    out = creators.attach(credits, edges, compose=False)
    return out.select("work_id", "role", "name", F.array_join(F.transform("creator_ids", lambda c: c.cast("string")), ",").alias("creator_ids"))


@query("""
WITH u AS (SELECT user_id, event_type, min(event_id) AS first, count(*) AS uses FROM events GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS number, event_type, uses FROM u""")
def reference_numbers(spark, d):
    return creators.numbered_references(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""
SELECT user_id, event_type, min(event_id) AS first, arg_max(value_text, event_id) FILTER (WHERE trim(value_text) <> '') AS value_text
FROM (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE CAST(event_id % 100 AS VARCHAR) END AS value_text FROM events) GROUP BY user_id, event_type""")
def key_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise((F.col("event_id") % 100).cast("string")).alias("value_text"))
    return survivorship.merged_by_key(e, "user_id", "event_type", "event_id", ["value_text"])


@query("""
WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS m, CASE WHEN o_orderkey % 6 = 0 THEN ' ' WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS o FROM orders)
SELECT k, 'status' AS field, CASE WHEN m = '' AND o = ' ' THEN 'empty' WHEN m = '' THEN 'fill' WHEN o = ' ' THEN 'keep' WHEN m = o THEN 'same' ELSE 'conflict' END AS action, coalesce(nullif(m, ''), nullif(trim(o), '')) AS value FROM m""")
def field_plans(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    master = o.select(k.alias("k"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"))
    other = o.select(k.alias("k"), F.when(k % 6 == 0, " ").when(k % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("status"))
    return survivorship.field_plan(master, other, "k", ["status"])


@query("""
WITH r AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'u' || user_id END AS a, CASE WHEN user_id % 2 = 0 THEN NULL ELSE event_type END AS b, props AS c FROM events),
k AS (SELECT event_id, CASE WHEN a <> '' THEN '0:' || a WHEN trim(b) <> '' THEN '1:' || b WHEN trim(c) <> '' THEN '2:' || c END AS group_key FROM r)
SELECT group_key, count(*) AS records, min(event_id) AS event_id FROM k GROUP BY 1""")
def record_collapse(spark, d):
    u = F.col("user_id")
    parts = [F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("u"), u.cast("string"))), F.when(u % 2 != 0, F.col("event_type")), F.col("props")]
    return survivorship.collapsed(table(spark, d, "events"), "event_id", *parts).select("group_key", "records", "event_id")


@query("SELECT user_id, arg_min(event_id, {'f': event_type, 'i': event_id}) AS event_id FROM events GROUP BY user_id")
def first_ingested(spark, d):
    return survivorship.first_ingested(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id").select("user_id", "event_id")


@query("""
SELECT p_name, count(*) AS members, CASE WHEN count(DISTINCT p_type) > 1 THEN 'media_mismatch' WHEN count(DISTINCT p_brand) > 1 THEN 'season_split' WHEN max(p_size) - min(p_size) > 1 THEN 'hold' ELSE 'safe' END AS verdict FROM part GROUP BY p_name""")
def group_classes(spark, d):
    return survivorship.group_class(table(spark, d, "part"), "p_name", media="p_type", year="p_size", season="p_brand")


@query("""
WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'covered' END AS status, coalesce(n, 0) AS n_works FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def source_coverage(spark, d):
    return survivorship.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""
WITH p AS (SELECT s.s_suppkey AS x, c.c_custkey AS y, s.s_nationkey AS n, CAST(1990 + s.s_suppkey % 3 AS INTEGER) AS ya, CAST(1990 + c.c_custkey % 4 AS INTEGER) AS yb, s.s_suppkey % 5 = 0 AS ma, c.c_custkey % 2 AS fb FROM supplier s JOIN customer c ON c.c_custkey = s.s_suppkey),
q AS (SELECT *, abs(ya - yb) AS dy FROM p),
r AS (SELECT x, y, CASE dy WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN fb = 1 THEN 2 ELSE 0 END + 2 + 3 AS score, dy > 1 AS bad, fb = 0 AS same, ma FROM q)
SELECT x, y, score, array_to_string(list_filter([CASE WHEN bad THEN 'date_conflict' END, CASE WHEN same THEN 'not_confirmed_cross_source' END, CASE WHEN ma THEN 'already_merged_or_deprecated' END], lambda v: v IS NOT NULL), ',') AS blockers,
  CASE WHEN bad OR same OR ma THEN 'blocked' WHEN score >= 6 THEN 'candidate' ELSE 'weak' END AS verdict FROM r""")
def cross_language_scores(spark, d):
    side = lambda year, family, title, merged: F.struct(F.lit("anime").alias("media"), F.lit(None).cast("string").alias("format"), year.cast("int").alias("year"), family.alias("family"), F.lit(title).alias("title"), F.array().cast("array<string>").alias("titles"), F.array().cast("array<string>").alias("source_keys"), merged.alias("merged"))
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a = s.select(F.col("s_suppkey").alias("x"), side(1990 + F.col("s_suppkey") % 3, F.lit("f0"), "漢字", F.col("s_suppkey") % 5 == 0).alias("a"))
    b = c.select(F.col("c_custkey").alias("y"), side(1990 + F.col("c_custkey") % 4, F.concat(F.lit("f"), (F.col("c_custkey") % 2).cast("string")), "Latin title", F.lit(False)).alias("b"))
    pairs = a.join(b, F.col("x") == F.col("y")).withColumn("tokens", F.array(F.struct(F.lit("rarest").alias("token"), F.lit(2).alias("df")), F.struct(F.lit("common").alias("token"), F.lit(40).alias("df"))))
    return survivorship.pair_score(pairs).select("x", "y", "score", F.array_join("blockers", ",").alias("blockers"), "verdict")


# -- validation ---------------------------------------------------------------------------------


@query("""
SELECT 'orders_rows' AS "check", CAST(15000 AS BIGINT) AS expected, count(*) AS actual, count(*) = 15000 AS ok FROM orders
UNION ALL SELECT 'part_name_brand_unique', 0, count(*) - count(DISTINCT (p_name, p_brand)), count(*) - count(DISTINCT (p_name, p_brand)) = 0 FROM part
UNION ALL SELECT 'orders_customers', 0, count(*), count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'status_letters', 0, count(*), count(*) = 0 FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def release_checks(spark, d):
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    return validation.checks(
        validation.row_count("orders_rows", o, 15000), validation.unique("part_name_brand_unique", p, ["p_name", "p_brand"]),
        validation.referenced("orders_customers", o, "o_custkey", table(spark, d, "customer"), "c_custkey"), validation.holds("status_letters", o, F.col("o_orderstatus").isin("F", "O")),
    )


@query("""
WITH e(k, n) AS (VALUES ('F', 7000), ('O', 1), ('Q', 5)), a AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(e.k, a.k) AS o_orderstatus, CAST(coalesce(e.n, 0) AS BIGINT) AS expected, coalesce(a.n, 0) AS actual, coalesce(e.n, 0) = coalesce(a.n, 0) AS ok FROM e FULL JOIN a ON e.k = a.k""")
def manifest_histogram(spark, d):
    return validation.histogram(table(spark, d, "orders"), "o_orderstatus", {"F": 7000, "O": 1, "Q": 5})


@query("""
SELECT 'props' AS field, count(*) FILTER (WHERE trim(props) <> '') AS filled, count(*) AS rows FROM events
UNION ALL SELECT 'event_type', count(*) FILTER (WHERE trim(event_type) <> ''), count(*) FROM events UNION ALL SELECT 'value', count(value), count(*) FROM events""")
def field_coverage(spark, d):
    return validation.field_coverage(table(spark, d, "events"), ["props", "event_type", "value"])


@query("""
WITH h AS (SELECT page_id, lower(html) AS h, [url, 'article', 'zzz' || page_id] AS v FROM pages), m AS (SELECT page_id, unnest(v) AS v, h FROM h)
SELECT page_id, string_agg(DISTINCT v, ',' ORDER BY v) AS missing FROM m WHERE NOT contains(h, lower(v)) GROUP BY 1""")
def search_coverage(spark, d):
    p = table(spark, d, "pages")
    values_of = F.array(F.col("url"), F.lit("article"), F.concat(F.lit("zzz"), F.col("page_id").cast("string")))
    return validation.search_coverage(p, "page_id", values_of, F.col("html")).select("page_id", F.array_join("missing", ",").alias("missing"))


@query("""
WITH per AS (SELECT p_name, p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY ALL), c AS (SELECT p_name, count(*) AS n FROM per WHERE n > 1 GROUP BY 1),
g AS (SELECT p_name, count(*) AS members, count(DISTINCT p_type) > 1 AS mixed_media, count(DISTINCT p_size % 4) > 1 AS mixed_grades FROM part GROUP BY 1 HAVING count(*) > 1)
SELECT g.*, coalesce(c.n, 0) AS provider_conflicts FROM g LEFT JOIN c USING (p_name)""")
def merge_audit(spark, d):
    return validation.group_audit(table(spark, d, "part").withColumn("grade", F.col("p_size") % 4), "p_name", "p_brand", "p_size", "p_type", "grade")


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 4 THEN 'kind' END, CASE WHEN doc_id % 5 < 2 AND doc_id % 3 = 0 THEN 'work_id' END, CASE WHEN length(trim(source)) > 200 OR length(trim(source)) = 0 THEN 'title' END,
  CASE WHEN length(trim(text, ' ')) NOT BETWEEN 10 AND 3000 THEN 'description' END, CASE WHEN doc_id % 7 = 0 THEN 'sources' END, CASE WHEN doc_id % 11 = 0 THEN 'consent' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents""")
def submission_problems(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(k % 5 == 4, "other").when(k % 5 < 2, "correction").otherwise("new_work").alias("kind"), F.when(k % 3 == 0, "x1").otherwise("12").alias("work_id"), F.col("source").alias("title"), F.col("text").alias("description"),
        F.when(k % 7 == 0, F.array(F.lit("http://plain.example"))).otherwise(F.array(F.lit("https://ok.example/a"))).alias("sources"), F.lit("").alias("website"), (k % 11 != 0).alias("consent"),
    )
    return validation.submission_problems(rows).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS t FROM events GROUP BY 1), c AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END AS t FROM events WHERE user_id % 5 <> 0)
SELECT user_id, CASE WHEN c.t IS NULL THEN 'work_missing' WHEN c.t = l.t THEN 'match' ELSE 'differs' END AS status, CASE WHEN c.t <> l.t THEN 'event_type' ELSE '' END AS changed FROM l LEFT JOIN c USING (user_id)""")
def event_reconciliation(spark, d):
    e = table(spark, d, "events")
    current = e.where("user_id % 5 <> 0").select("user_id").distinct().withColumn("event_type", F.when(F.col("user_id") % 2 == 0, "click").otherwise("view"))
    out = validation.reconciled_events(e, current, "user_id", "ts", "event_id", ["event_type"])
    return out.select("user_id", "status", F.array_join("changed", ",").alias("changed"))


@query("""
WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS t FROM part WHERE length(split_part(p_name, ' ', 1)) >= 5), r AS (SELECT p_partkey, p_name || 'x' AS t FROM part),
m AS (SELECT p_partkey, a.t AS anchor FROM r JOIN a ON contains(r.t, a.t))
SELECT p_partkey, count(*) AS n, max(length(anchor)) AS longest FROM m GROUP BY 1""")
def anchor_matches(spark, d):
    p = table(spark, d, "part")
    first = p.select(F.substring_index("p_name", " ", 1).alias("t")).where(F.char_length("t") >= 5).distinct()
    out = validation.anchors(p, first.withColumn("id", F.col("t")), "p_partkey", F.concat("p_name", F.lit("x")), "id", "t")
    return out.select("p_partkey", "n", F.char_length("anchor").alias("longest"))


@query("""
SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('k', 'a'))), ',') AS unknown_fields FROM events""")
def known_fields(spark, d):
    e = table(spark, d, "events")
    return validation.known_fields(e, F.col("props"), ["k", "a"]).select("event_id", F.array_join("unknown_fields", ",").alias("unknown_fields"))


@query("""
WITH n AS (SELECT 's' || s_suppkey AS node_id, 1 AS seq, s_name AS label FROM supplier UNION ALL SELECT 's' || c_custkey, 2, c_name FROM customer)
SELECT node_id, arg_min(label, seq) AS label FROM n GROUP BY 1""")
def first_nodes(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit(1).alias("seq"), F.col("s_name").alias("label"))
    c = table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit(2).alias("seq"), F.col("c_name").alias("label"))
    return graph.nodes(s, c).select("node_id", "label")


@query("""
WITH f AS (SELECT event_id, props AS doc FROM events), g AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"k": -1}' ELSE doc END AS doc FROM f)
SELECT count(DISTINCT event_id) AS changed FROM f JOIN g USING (event_id) WHERE f.doc <> g.doc""")
def json_changes(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("doc"))
    after = e.withColumn("doc", F.when(F.col("event_id") % 4 == 0, '{"k": -1}').otherwise(F.col("doc")))
    return diff.json_diff(e, after, "event_id", "doc").agg(F.count_distinct("event_id").alias("changed"))


@query("""
WITH m AS (SELECT p_partkey, ['game','visual_novel','other',NULL,'anime'][CAST(p_partkey % 5 AS INTEGER) + 1] AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'partial' ELSE 'exact' END AS st, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_brand END AS pr FROM part)
SELECT p_partkey, CASE WHEN kind IN ('game', 'visual_novel') THEN 'game' WHEN kind IS NULL OR kind = 'other' THEN 'unknown' ELSE kind END AS bucket, CASE WHEN st = 'exact' AND trim(pr) <> '' THEN lower(pr) || '|' || p_partkey END AS identity FROM m""")
def identity_keys(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("game"), F.lit("visual_novel"), F.lit("other"), F.lit(None), F.lit("anime")), (k % 5 + 1).cast("int"))
    identity = keys.exact_identity(F.when(k % 3 == 0, "partial").otherwise("exact"), F.when(k % 7 == 0, " ").otherwise(F.col("p_brand")), k.cast("string"))
    return table(spark, d, "part").select("p_partkey", keys.media_bucket(kind).alias("bucket"), identity.alias("identity"))


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dt, o_orderpriority AS t FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(substr(dt, 1, 4) AS INTEGER) DESC NULLS LAST, dt DESC NULLS LAST, t, o_orderkey) AS place FROM w""")
def creator_display_order(spark, d):
    o = table(spark, d, "orders")
    w = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dt"), "o_orderpriority")
    order = creators.display_order(F.col("dt"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return w.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("place"))


@query(r"""
WITH t AS (SELECT conv_id, turn, replace(replace(text, '. ', ';'), ', ', '|') AS t FROM conversations), s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(t, '[;|,\n]')) AS x FROM t)
SELECT conv_id, turn, count(*) AS items FROM s WHERE trim(x) <> '' GROUP BY ALL""")
def list_items(spark, d):
    c = table(spark, d, "conversations")
    text = F.replace(F.replace("text", F.lit(". "), F.lit(";")), F.lit(", "), F.lit("|"))
    return c.select("conv_id", "turn", F.size(keys.split_list(text)).cast("long").alias("items")).where("items > 0")


@query("""
SELECT bucket, n, digest FROM (SELECT CAST(n_regionkey AS BIGINT) AS bucket, count(*) AS n, string_agg(md5(n_name), ',' ORDER BY n_name) AS digest FROM nation GROUP BY 1)""")
def child_table_digest(spark, d):
    """Nested rows to a child table and back: names of each region, hashed and in order."""
    nested = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("n_name"))).alias("names"))
    child = writers.children(nested, "bucket", "names")
    back = child.groupBy("bucket").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", F.md5("n_name").alias("h")))).alias("a"))
    return back.select("bucket", "n", F.array_join(F.transform("a", lambda x: x["h"]), ",").alias("digest"))

# Names under which the whole-table forms were first registered.
for _name, _same in (("whole_key_matches", "multi_key_matches"), ("whole_candidate_groups", "candidate_groups")):
    QUERIES[_name], SQL[_name] = QUERIES[_same], SQL[_same]


# -- what a public catalog shows ----------------------------------------------------------------

_GRADES, _TERMINAL = ["S", "A", "B", "C", "D", "E"], ["assessed", "insufficient", "excluded"]


@query("""
WITH r AS (SELECT p_partkey // 4 AS g, p_partkey AS o, ['rated','rated','insufficient','excluded','assessed'][CAST(p_size % 5 AS INTEGER) + 1] AS state, CASE WHEN p_size % 5 < 2 OR p_size % 7 = 0 THEN ['S','A','B','C','D','E'][CAST(p_partkey * 7 % 6 AS INTEGER) + 1] END AS grade,
  ['k' || (p_size % 9), 'k' || (p_partkey % 9)] AS classes, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS reason, CASE WHEN p_size % 2 = 0 THEN 'u' || p_partkey END AS evidence, p_size % 7 AS rich, p_size % 11 = 0 AS research FROM part),
i AS (SELECT *, CASE WHEN state = 'rated' AND grade IS NOT NULL THEN list_position(['S','A','B','C','D','E'], grade) END AS bad, coalesce(list_position(['assessed','insufficient','excluded'], state), 100) AS rank FROM r),
f AS (SELECT *, max(bad) OVER w AS worst, min(rank) OVER w AS first_rank, bool_or(research) OVER w AS any_research FROM i WINDOW w AS (PARTITION BY g)),
c AS (SELECT *, CASE WHEN worst IS NULL THEN rank = first_rank ELSE bad IS NOT DISTINCT FROM worst END AS candidate, ['S','A','B','C','D','E'][CAST(worst AS INTEGER)] AS sg FROM f),
m AS (SELECT *, CASE WHEN sg IS NULL THEN candidate ELSE grade IS NOT DISTINCT FROM sg END AS same FROM c),
s AS (SELECT * FROM m WHERE candidate QUALIFY row_number() OVER (PARTITION BY g ORDER BY rich DESC, o) = 1),
w AS (SELECT * FROM m WHERE same AND reason <> '' QUALIFY row_number() OVER (PARTITION BY g ORDER BY length(reason) DESC, o) = 1),
e AS (SELECT g, arg_min(evidence, o) AS evidence FROM m WHERE same AND evidence IS NOT NULL GROUP BY g),
k AS (SELECT g, class, min(o * 10 + nth) AS place FROM (SELECT g, o, sg, unnest(classes) AS class, unnest([0, 1]) AS nth FROM m WHERE same) WHERE sg IS NULL OR ['S','A','B','C','D','E'][CAST(substr(class, 2)::INTEGER % 6 AS INTEGER) + 1] = sg GROUP BY g, class),
l AS (SELECT g, string_agg(class, ',' ORDER BY place) AS classes FROM k GROUP BY g)
SELECT s.g AS work, s.o AS selected, s.state, s.sg AS grade, coalesce(l.classes, '') AS classes, w.reason, CASE WHEN w.g IS NOT NULL THEN w.evidence ELSE coalesce(s.evidence, e.evidence) END AS evidence, s.any_research AS needs_research
FROM s LEFT JOIN w USING (g) LEFT JOIN e USING (g) LEFT JOIN l USING (g)""")
def merged_rating(spark, d):
    size, part = F.col("p_size"), F.col("p_partkey")
    pick = lambda options, k: F.element_at(F.array(*[F.lit(x) for x in options]), (k + 1).cast("int"))
    records = table(spark, d, "part").select(
        F.floor(part / 4).alias("work"), part.alias("ordinal"), pick(["rated", "rated", "insufficient", "excluded", "assessed"], size % 5).alias("state"),
        F.when((size % 5 < 2) | (size % 7 == 0), pick(_GRADES, part * 7 % 6)).alias("grade"), F.array(F.concat(F.lit("k"), (size % 9).cast("string")), F.concat(F.lit("k"), (part % 9).cast("string"))).alias("classes"),
        F.when(size % 3 == 0, F.col("p_name")).otherwise("").alias("reason"), F.when(size % 2 == 0, F.concat(F.lit("u"), part.cast("string"))).alias("evidence"), (size % 7).alias("richness"), (size % 11 == 0).alias("research"),
    )
    registry = spark.range(9).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("class"), pick(_GRADES, F.col("id") % 6).alias("grade"))
    out = published.merged_rating(records, registry, "work", grades=_GRADES, terminal=_TERMINAL)
    return out.withColumn("classes", F.array_join("classes", ","))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 99 END AS s, CASE WHEN substr(o_orderpriority, 1, 1) BETWEEN '1' AND '4' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 ELSE 99 END AS g FROM orders)
SELECT o_orderkey, row_number() OVER (PARTITION BY s, g ORDER BY o_orderkey) AS place, s AS state_rank, g AS grade_rank FROM r""")
def display_order(spark, d):
    o = table(spark, d, "orders")
    state, grade, ordinal = published.display_order(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_orderkey"), ["F", "O"], ["1", "2", "3", "4"])
    ranked = o.select("o_orderkey", state.alias("state_rank"), grade.alias("grade_rank"), ordinal.alias("k"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("state_rank", "grade_rank").orderBy("k")).cast("long")).drop("k")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus = 'F' AND o_custkey % 2 = 0 WHEN 1 THEN o_custkey % 5 <> 0 AND o_custkey % 7 = 0 ELSE o_custkey % 4 = 1 END AS shown FROM orders""")
def exportable_docs(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    collection = F.when(k % 3 == 0, "evidence").when(k % 3 == 1, "works").otherwise("creators")
    status = F.when(k % 3 == 0, F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("open")).when(c % 4 == 1, " published ").when(c % 4 == 2, "archived")
    shown = published.exportable(collection, status, F.when(c % 5 == 0, "archived").when(c % 3 == 0, ""), F.when(c % 7 == 0, "published"), c % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", shown.alias("shown"))


@query("""
WITH m AS (SELECT *, ['RAIL', 'MAIL', 'SHIP', 'AIR', 'FOB'][CAST(l_suppkey % 5 AS INTEGER) + 1] AS source FROM lineitem),
c AS (SELECT DISTINCT l_orderkey, source, l_returnflag || (l_linenumber % 2) AS value, coalesce(list_position(['SHIP', 'AIR', 'RAIL'], source), 999) AS rank FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, source, value) AS n FROM c), f AS (SELECT l_orderkey, source, value FROM b WHERE n = 1)
SELECT f.l_orderkey, f.source, f.value, coalesce(string_agg(DISTINCT CASE WHEN c.value <> f.value THEN c.source || '=' || c.value END, ',' ORDER BY CASE WHEN c.value <> f.value THEN c.source || '=' || c.value END), '') AS conflicts
FROM f JOIN c USING (l_orderkey) GROUP BY 1, 2, 3""")
def source_conflicts(spark, d):
    source = F.element_at(F.array(*[F.lit(x) for x in ("RAIL", "MAIL", "SHIP", "AIR", "FOB")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    claims = table(spark, d, "lineitem").select("l_orderkey", source.alias("source"), F.concat("l_returnflag", (F.col("l_linenumber") % 2).cast("string")).alias("v"))
    out = published.by_source_priority(claims, ["l_orderkey"], "source", "v", ["SHIP", "AIR", "RAIL"])
    return out.select("l_orderkey", "source", "value", F.array_join("conflicts", ",").alias("conflicts"))


@query("SELECT o_orderkey, coalesce(n, 0) AS attachments, coalesce(b, 0) AS bytes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS b FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) ON l_orderkey = o_orderkey")
def attachment_counts(spark, d):
    files = table(spark, d, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("size"))
    return published.counted_attachments(table(spark, d, "orders").select("o_orderkey"), files, "o_orderkey", "size")


@query(r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(url || ' "HTTP://x.org/v' || page_id || '?a" ' || coalesce(html, ''), '(?i)https?://[^\s"''<>]+')) AS found FROM pages)
SELECT page_id, count(*) AS n, max(CASE WHEN regexp_matches(found, '(?i)^https?://(www\.)?x\.org/v[0-9]+') THEN regexp_extract(found, '(?i)^https?://(?:www\.)?x\.org/v([0-9]+)', 1) END) AS site_id FROM u GROUP BY 1""")
def found_urls(spark, d):
    text = F.concat(F.col("url"), F.lit(' "HTTP://x.org/v'), F.col("page_id").cast("string"), F.lit('?a" '), F.coalesce("html", F.lit("")))
    found = table(spark, d, "pages").select("page_id", F.explode(published.urls(text)).alias("found"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.max(published.site_id(F.col("found"), r"x\.org", "v([0-9]+)")).alias("site_id"))


@query("""
SELECT p_partkey, replace(p_name, '#', 'no') AS series, CASE WHEN p_partkey % 5 < 3 THEN CAST(p_size AS VARCHAR) ELSE '' END AS volume FROM part""")
def series_titles(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    tail = F.when(k == 0, F.concat(F.lit(" （ "), size, F.lit(" )"))).when(k == 1, F.concat(F.lit(" 第"), size, F.lit("巻"))).when(k == 2, F.concat(F.lit("第"), size, F.lit("集"))).otherwise("")
    title = F.concat(F.regexp_replace("p_name", "#", "no"), tail)
    series, volume = published.series_title(title)
    return table(spark, d, "part").select("p_partkey", series.alias("series"), volume.alias("volume"))


@query("""
WITH e AS (SELECT s_suppkey, s_name AS n, s_suppkey % 3 AS k, s_nationkey AS x FROM supplier)
SELECT s_suppkey, n AS name, 'committee' AS role, NULL::VARCHAR AS member_of FROM e WHERE k < 2
UNION ALL SELECT s_suppkey, 'a' || x, 'committee_member', n FROM e WHERE k = 0 UNION ALL SELECT s_suppkey, 'b', 'committee_member', n FROM e WHERE k = 0 UNION ALL SELECT s_suppkey, 'c', 'committee', NULL FROM e WHERE k = 1""")
def committee_members(spark, d):
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, F.concat("s_name", F.lit(" （a"), F.col("s_nationkey").cast("string"), F.lit("、 b）"))).when(k == 1, F.concat("s_name", F.lit(" / c")))
    return published.committee(table(spark, d, "supplier").select("s_suppkey", text.alias("entry")), "entry").drop("entry")


# -- audits and links ---------------------------------------------------------------------------


@query("""
WITH h AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 7 ELSE -1 END AS t, l_returnflag <> 'N' AS ok, l_partkey % 2 = 0 AS done FROM lineitem)
SELECT l_orderkey, l_linenumber AS latest, CASE WHEN NOT ok THEN 'latest_available_invalid' WHEN done THEN 'latest_structurally_valid_complete' ELSE 'latest_structurally_valid_incomplete' END AS status
FROM h QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ok DESC, t DESC, l_linenumber DESC, l_partkey DESC) = 1""")
def latest_candidates(spark, d):
    when = F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey") % 7)
    out = audits.latest_candidate(table(spark, d, "lineitem"), "l_orderkey", [when, F.col("l_linenumber"), F.col("l_partkey")], F.col("l_returnflag") != "N", F.col("l_partkey") % 2 == 0)
    return out.select("l_orderkey", F.col("candidate.l_linenumber").alias("latest"), "status")


@query("""
SELECT o_orderkey, c.c_custkey IS NOT NULL AS doc_found, CASE WHEN c.c_custkey IS NOT NULL AND (c.c_custkey % 5 = 0 OR c.c_custkey % 7 <> 0) THEN 'keep' ELSE 'omit_from_search_index' END AS action
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_custkey % 3 <> 0""")
def index_actions(spark, d):
    k = F.col("c_custkey")
    docs = table(spark, d, "customer").where(k % 3 != 0).select(k.alias("slug"), F.when(k % 5 != 0, k % 7 != 0).alias("visible"))
    return audits.index_actions(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("slug")), docs, "slug", "visible").select("o_orderkey", "doc_found", "action")


@query("""
WITH w AS (SELECT p_partkey AS id, p_size % 4 AS score, p_brand || '|unknown' AS m, lower(p_name) AS t, ['s' || (p_partkey // 7), 'alias ' || (p_partkey // 9)] AS more, ['mal:' || (p_partkey // 5), 'iso:' || (p_partkey // 5), 'iso:' || (p_partkey // 11)] AS s FROM part),
c AS (SELECT id, score, 'source_key' AS kind, unnest(s) AS key, unnest([0, 1, 2]) AS nth FROM w
  UNION ALL SELECT id, score, 'primary_title_media', m || '|' || t, 0 FROM w UNION ALL SELECT id, score, 'primary_title_only', t, 0 FROM w
  UNION ALL SELECT id, score, 'alias_title_media', m || '|' || unnest([t] || more), unnest([0, 1, 2]) FROM w UNION ALL SELECT id, score, 'alias_title_only', unnest([t] || more), unnest([0, 1, 2]) FROM w),
k AS (SELECT id, score, kind, key, min(nth) AS nth FROM c GROUP BY ALL),
g AS (SELECT kind, key, count(*) AS n, arg_max(id, CAST(score AS BIGINT) * 1000000000 - id) AS keep, min(id * 10 + nth) AS place, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM k GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT *, CASE WHEN kind = 'source_key' THEN CASE WHEN key LIKE 'iso:%' THEN 0 ELSE 3 END WHEN kind LIKE '%media' THEN 1 WHEN length(key) >= 6 THEN 2 ELSE 3 END AS rank FROM g)
SELECT kind, key, ['high', 'medium', 'low', 'review'][rank + 1] AS confidence, n, keep FROM r QUALIFY row_number() OVER (PARTITION BY kind, members ORDER BY rank, place) = 1""")
def duplicate_groups(spark, d):
    by = lambda prefix, n: F.concat(F.lit(prefix), F.floor(F.col("p_partkey") / n).cast("string"))
    title = F.lower("p_name")
    works = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("media_group"), F.lit("").alias("media_type"), title.alias("primary"), F.array(title, by("s", 7), by("alias ", 9)).alias("titles"),
        F.array(by("mal:", 5), by("iso:", 5), by("iso:", 11)).alias("source_keys"), (F.col("p_size") % 4).alias("score"),
    )
    return audits.duplicate_groups(works, "p_partkey", ["iso"])


@query("""
WITH r AS (SELECT o_orderkey, ['http://a/' || (o_custkey % 3), CASE WHEN o_custkey % 2 = 0 THEN 'http://a/1' ELSE '' END] AS u, o_orderkey % 4 AS told, ['multiple_secondary_supported', 'single_secondary_supported', 'unknown'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS s FROM orders),
t AS (SELECT *, len(list_distinct(list_filter(u, lambda x: x <> ''))) AS n, u[2] = '' AS unlinked FROM r),
p AS (SELECT o_orderkey, n, s = 'multiple_secondary_supported' AND n < 2 AS b, concat_ws(',', CASE WHEN told <> n THEN 'declared_count_differs' END, CASE WHEN unlinked THEN 'unlinked_secondary' END) AS w FROM t)
SELECT o_orderkey, n AS traceable, CASE WHEN b THEN 'fewer_than_two_traceable' ELSE '' END AS blockers, w AS warnings, CASE WHEN b THEN 'blocked' WHEN w <> '' THEN 'warning' ELSE 'ok' END AS status FROM p""")
def provenance_audit(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    source = lambda u: F.struct(u.alias("url"), F.lit("secondary_web").alias("kind"))
    sources = F.array(source(F.concat(F.lit("http://a/"), (c % 3).cast("string"), F.lit("/"))), source(F.when(c % 2 == 0, "http://a/1").otherwise("")))
    state = F.when(k % 3 == 0, "multiple_secondary_supported").when(k % 3 == 1, "single_secondary_supported")
    a = table(spark, d, "orders").select("o_orderkey", audits.provenance_audit(sources, k % 4, state).alias("a"))
    return a.select("o_orderkey", "a.traceable", F.array_join("a.blockers", ",").alias("blockers"), F.array_join("a.warnings", ",").alias("warnings"), "a.status")


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'text:title' END, CASE WHEN p_size % 4 < 2 THEN 'array:sources:' || (p_size % 4) || '/2' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'map:findings' END, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 'finding:pace' END, CASE WHEN p_partkey % 5 <> 0 THEN 'finding:tone' END) AS problems FROM part""")
def research_problems(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.when(size % 3 != 0, F.col("p_name")).otherwise(" ").alias("title"), F.array_repeat("p_brand", (size % 4).cast("int")).alias("sources"), F.when(k % 5 != 0, F.create_map(F.lit("pace"), F.when(k % 2 != 0, "slow").otherwise(""))).alias("findings"))
    return rows.select("p_partkey", F.array_join(audits.research_problems(["title"], {"sources": 2}, "findings", ["pace", "tone"]), ",").alias("problems"))


@query("""
WITH e AS (SELECT s_suppkey AS e, CASE WHEN s_suppkey % 3 = 0 THEN ['a' || (s_suppkey // 2), 'b' || s_nationkey] ELSE [] END AS keys, 'n' || s_nationkey AS name FROM supplier),
r AS (SELECT p_partkey AS r, ['a' || (p_partkey % 40), 'b' || p_size] AS keys, 'n' || (p_size % 30) AS name FROM part),
bk AS (SELECT k, count(*) AS n, min(e) AS e FROM (SELECT e, unnest(keys) AS k FROM e) GROUP BY k),
bn AS (SELECT name, count(*) AS n, min(e) AS e1, count(*) FILTER (len(keys) > 0) AS w, min(e) FILTER (len(keys) > 0) AS e2 FROM e GROUP BY name),
h AS (SELECT r, n, e FROM (SELECT r, unnest(keys) AS k, unnest([0, 1]) AS nth FROM r) JOIN bk USING (k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY nth) = 1),
o AS (SELECT r.r, h.e, e1, e2, CASE WHEN h.n = 1 THEN 'key' WHEN h.n > 1 THEN 'ambiguous_key' WHEN bn.n = 1 THEN 'name' WHEN w = 1 THEN 'name_with_keys' WHEN bn.n > 1 THEN 'ambiguous_name' ELSE 'missing' END AS how FROM r LEFT JOIN h ON h.r = r.r LEFT JOIN bn ON bn.name = r.name)
SELECT r AS p_partkey, how AS matched_by, CASE how WHEN 'key' THEN e WHEN 'name' THEN e1 WHEN 'name_with_keys' THEN e2 END AS s_suppkey FROM o""")
def reference_links(spark, d):
    word = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    entries = table(spark, d, "supplier").select(k, F.when(k % 3 == 0, F.array(word("a", F.floor(k / 2)), word("b", nation))).alias("keys"), word("n", nation).alias("name"))
    refs = table(spark, d, "part").select("p_partkey", F.array(word("a", F.col("p_partkey") % 40), word("b", F.col("p_size"))).alias("keys"), word("n", F.col("p_size") % 30).alias("name"))
    return audits.reference_links(refs, entries, "p_partkey", "s_suppkey")


@query("""
WITH k AS (SELECT s_suppkey, 'k' || (s_suppkey // 2) AS k FROM supplier WHERE s_suppkey % 5 < 3)
SELECT s_suppkey, 'shared_key' AS problem, k AS what FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)
UNION ALL SELECT s_suppkey, 'id_not_below_next', '8' FROM supplier WHERE s_suppkey >= 8 UNION ALL SELECT s_suppkey, 'conflicting_provider_ids', 'p' FROM supplier WHERE s_nationkey % 2 = 1""")
def creator_problems(spark, d):
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    identity = lambda p, v: F.struct(F.lit(p).alias("provider"), v.cast("string").alias("value"))
    creators = table(spark, d, "supplier").select(k, F.when(k % 5 < 3, F.array(F.concat(F.lit("k"), F.floor(k / 2).cast("string")))).alias("keys"), F.array(identity("p", nation), identity("p", nation - nation % 2), identity("q", k)).alias("identities"))
    return audits.creator_problems(creators, "s_suppkey", 8)


@query("""
WITH m AS (SELECT o_custkey AS c, o_orderkey AS id, o_orderkey <> o_custkey AS other, ['A' || (o_orderkey % 4), 'a' || (o_orderkey % 3)] AS al, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS f, CASE WHEN o_orderkey % 5 = 0 THEN 'y' || o_orderkey END AS y, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS s, o_orderkey % 8 = 0 AS src FROM orders),
r AS (SELECT c_custkey AS c, 'a' || (c_custkey % 5) AS title, CASE WHEN c_custkey % 2 = 0 THEN 'own' END AS y, CASE WHEN c_custkey % 3 = 0 THEN 'text' END AS s FROM customer),
o AS (SELECT c, unnest(al) AS alias, other, id, unnest([0, 1]) AS nth FROM m),
a AS (SELECT c, alias, other, id, nth FROM o QUALIFY row_number() OVER (PARTITION BY c, lower(alias) ORDER BY other, id, nth) = 1),
l AS (SELECT a.c, string_agg(alias, ',' ORDER BY other, id, nth) AS aliases FROM a JOIN r USING (c) WHERE lower(alias) <> title GROUP BY 1),
f AS (SELECT c, arg_min(f, (other, id)) FILTER (f IS NOT NULL) AS f, arg_min(y, (other, id)) FILTER (y IS NOT NULL) AS y, arg_min(s, (other, id)) FILTER (s IS NOT NULL) AS s, arg_min(s, (other, id)) FILTER (s IS NOT NULL AND src) AS src FROM m GROUP BY 1)
SELECT r.c AS c_custkey, title, coalesce(aliases, '') AS aliases, coalesce(f.f, 'none') AS format, coalesce(r.y, f.y) AS first_published, coalesce(src, r.s, f.s) AS summary FROM r LEFT JOIN l USING (c) LEFT JOIN f USING (c)""")
def metadata_overlay(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    word = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    members = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), k, F.array(word("A", k % 4), word("a", k % 3)).alias("aliases"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("format"),
        F.when(k % 5 == 0, word("y", k)).alias("first_published"), F.when(k % 2 == 0, word("s", k)).alias("summary"), F.when(k % 8 == 0, "source_summary").alias("summary_kind"),
    )
    records = table(spark, d, "customer").select(c, word("a", c % 5).alias("title"), F.array().cast("array<string>").alias("aliases"), F.lit("none").alias("format"), F.when(c % 2 == 0, "own").alias("first_published"), F.when(c % 3 == 0, "text").alias("summary"))
    return audits.metadata_overlay(records, members, "c_custkey", "o_orderkey", "o_orderkey").withColumn("aliases", F.array_join("aliases", ","))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 2 THEN '' ELSE s_name END AS name FROM supplier""")
def credit_names(spark, d):
    k, name = F.col("s_suppkey") % 6, F.col("s_name")
    text = (
        F.when(k == 0, F.concat(F.lit("漫画： "), name, F.lit("（月刊X）"))).when(k == 1, F.concat(name, F.lit("「T」"))).when(k == 2, F.lit("12 - 13)"))
        .when(k == 3, F.concat(F.lit("音乐制作:"), name, F.lit(" [x]"))).when(k == 4, F.concat(name, F.lit(" （未"))).otherwise(F.concat(F.lit(" "), name, F.lit("(3-4)")))
    )
    return table(spark, d, "supplier").select("s_suppkey", keys.credit_name(text).alias("name"))


@query("""
WITH d AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents), n AS (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '[ÃÂãäåæçèéêëìíîïðñòóôõöøùúûüýþ�]', '', 'g')) AS bad FROM d)
SELECT doc_id, bad >= 3 AND bad > 0.08 * n AS garbled FROM n""")
def garbled_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.badly_decoded(F.col("text")).alias("garbled"))


@query("""
WITH r AS (SELECT o_orderkey, coalesce(list_position(['1-URGENT', '2-HIGH'], o_orderpriority), 3) AS priority, o_orderstatus AS source, 'c' || (o_custkey % 5) AS issue, CASE WHEN o_orderkey % 2 = 0 THEN 't' || (o_orderkey % 100) ELSE 'n' || (o_orderkey % 100) END AS t FROM orders)
SELECT o_orderkey, CAST(priority AS INTEGER) AS priority, row_number() OVER (PARTITION BY priority, source, issue ORDER BY t, o_orderkey) AS place FROM r""")
def review_order(spark, d):
    k = F.col("o_orderkey")
    word = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    order = audits.review_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], F.col("o_orderstatus"), word("c", F.col("o_custkey") % 5), F.when(k % 2 == 0, word("t", k % 100)), word("n", k % 100))
    rows = table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(order, ("priority", "source", "issue", "title"))])
    return rows.select("o_orderkey", "priority", F.row_number().over(Window.partitionBy("priority", "source", "issue").orderBy("title", "o_orderkey")).cast("long").alias("place"))


@query("""
SELECT 'changed' AS state, count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (o_custkey % 3 = 0 AND o_orderstatus <> 'X') = 0 AS same FROM orders
UNION ALL SELECT 'rolled back', count(*), count(*), true FROM orders""")
def rollback_check(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = before.withColumn("o_orderstatus", F.when(F.col("o_custkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    images = before.where("o_custkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("image"))
    back = changed.join(images, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("image", "o_orderstatus").alias("o_orderstatus"))
    checks = [audits.same_contents(before, after, before.columns).select(F.lit(name).alias("state"), "*") for name, after in (("changed", changed), ("rolled back", back))]
    return checks[0].unionByName(checks[1])
