"""Registered queries of elections, overlays, references and inventories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.operators import survivorship, upkeep
from tessera.queries import query
from tessera.session import table


@query("""
WITH p AS (SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 25 ELSE 0 END + least(p_size % 20, 15) + CASE WHEN p_partkey % 5 > 1 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END AS score FROM part),
s AS (SELECT p_name, max(p_partkey) AS named FROM part WHERE p_partkey % 7 = 0 GROUP BY 1),
r AS (SELECT p_name, p_partkey, p_partkey = named AS own, count(*) OVER (PARTITION BY p_name) AS members, row_number() OVER (PARTITION BY p_name ORDER BY coalesce(p_partkey = named, false) DESC, score DESC, p_partkey) AS k FROM p LEFT JOIN s USING (p_name))
SELECT p_name, p_partkey, coalesce(own, false) AS is_stable, members FROM r WHERE k = 1""")
def scored_primaries(spark, d):
    """The part to keep of each name: one that is named, else the one with most points."""
    p = table(spark, d, "part")
    status = F.element_at(F.array(F.lit("published"), F.lit("review"), F.lit("draft"), F.lit("gone")), (F.col("p_size") % 4 + 1).cast("int"))
    rank = F.element_at(F.array(F.lit(""), F.lit("unknown"), F.lit("A"), F.lit("B"), F.lit("C")), (F.col("p_partkey") % 5 + 1).cast("int"))
    score = upkeep.keep_score(status, F.col("p_partkey") % 3 == 0, F.col("p_size") % 20, rank, F.col("p_partkey") % 2 == 0)
    stable = p.where("p_partkey % 7 = 0").groupBy("p_name").agg(F.max("p_partkey").alias("p_partkey"))
    return upkeep.elect_primary(p, "p_name", "p_partkey", score, F.col("p_partkey"), stable)


@query("""
WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, 'c' || o_custkey AS i, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 > 0),
c AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE 'c' || o_custkey END AS i, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 > 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'c' || o_custkey, o_orderstatus, 'p' FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 7 > 0),
h AS (SELECT k, count(*) AS n, min(i) AS i, min(s) AS s FROM c GROUP BY 1)
SELECT coalesce(d.k, h.k) AS pub, CASE WHEN d.k IS NULL OR n > 1 THEN 'blocked' WHEN n IS NULL THEN 'missingRating' WHEN d.i <> h.i THEN 'identityMismatch' WHEN d.s = h.s THEN 'alreadyCurrent' ELSE 'wouldUpdate' END AS status,
  CASE WHEN d.k IS NULL THEN 'current_database_rating_outside_release' WHEN n IS NULL THEN 'no_current_public_rating' WHEN n > 1 THEN 'duplicate_current_publication_key' WHEN d.i <> h.i THEN 'publication_key_identity_mismatch' END AS reason,
  CASE WHEN n = 1 AND d.k IS NOT NULL AND d.i = h.i AND d.s <> h.s THEN 's' ELSE '' END AS changed FROM d FULL JOIN h ON d.k = h.k""")
def overlay_plan(spark, d):
    """What an overlay of orders would do to a copy that drifted."""
    o = table(spark, d, "orders")
    key, identity = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    pub = F.concat(F.lit(" "), key.cast("string")).alias("pub")
    desired = o.where(key % 11 > 0).select(pub, identity.alias("i"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    kept = o.where(key % 7 > 0)
    current = kept.select(pub, F.when(key % 13 == 0, "x").otherwise(identity).alias("i"), F.when(key % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    current = current.unionByName(kept.where(key % 17 == 0).select(pub, identity.alias("i"), F.col("o_orderstatus").alias("s"), F.lit("p").alias("p")))
    return upkeep.overlay_plan(desired, current, "pub", "i", ["s", "p"]).withColumn("changed", F.array_join("changed", ","))


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://store.steampowered.com/app/' || page_id || '/x' WHEN 1 THEN 'http://a' || page_id || '.itch.io/game' WHEN 2 THEN 'https://WWW.dlsite.com/x/product_id/' || page_id WHEN 3 THEN 'ftp://' || url WHEN 4 THEN 'https://me:pw@host/' || page_id WHEN 5 THEN 'https://www.kadokawa.co.jp/' ELSE url END AS url FROM pages)
SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN '购买 / 游玩 · Steam' WHEN 1 THEN '游玩 / 获取 · itch.io' WHEN 2 THEN '购买 / 获取 · DLsite' WHEN 5 THEN '出版方资料 / 获取信息' ELSE '资料来源' END AS purpose FROM u WHERE page_id % 7 NOT IN (3, 4)""")
def page_references(spark, d):
    """Addresses of pages, some of stores, that may stand as references, with their purpose."""
    k = F.col("page_id")
    word = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    shapes = [word("https://store.steampowered.com/app/", k, "/x"), word("http://a", k, ".itch.io/game"), word("https://WWW.dlsite.com/x/product_id/", k), word("ftp://", F.col("url")), word("https://me:pw@host/", k), F.lit("https://www.kadokawa.co.jp/")]
    url = F.col("url")
    for i, shape in enumerate(shapes):
        url = F.when(k % 7 == i, shape).otherwise(url)
    return table(spark, d, "pages").select("page_id", upkeep.reference(url).alias("r")).where("r is not null").select("page_id", "r.*")


@query("""
WITH v AS (SELECT c_custkey, 'segment' AS kind, c_mktsegment || c_nationkey || c_custkey % 9 AS value FROM customer UNION ALL SELECT c_custkey, 'balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer WHERE c_custkey % 4 > 0)
SELECT kind, value, c_custkey, count(*) OVER (PARTITION BY kind, value) AS n FROM v QUALIFY n > 1""")
def repeated_values(spark, d):
    """Customers that share a segment and nation, or a whole balance."""
    c = table(spark, d, "customer")
    balance = F.when(F.col("c_custkey") % 4 > 0, F.floor("c_acctbal").cast("string")).otherwise(" ")
    return upkeep.repeated_values(c, "c_custkey", segment=F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 9).cast("string")), balance=balance)


@query(r"""
WITH k AS (SELECT doc_id, source, regexp_replace(lower(text), '[\s\p{Z}\p{P}\p{S}]+', '', 'g') AS k FROM documents),
g AS (SELECT k, min(doc_id) AS first_id, count(*) AS n, count(DISTINCT coalesce(source, '') || '|' || doc_id) AS works FROM k WHERE length(k) >= 80 GROUP BY 1 HAVING count(DISTINCT coalesce(source, '') || '|' || doc_id) > 1)
SELECT doc_id, first_id, n, works FROM k JOIN g USING (k)""")
def distinct_duplicates(spark, d):
    """Documents whose long text other works share."""
    return upkeep.distinct_duplicates(table(spark, d, "documents"), "doc_id", "text", "source")


@query("""
WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE CAST(event_id % 100 AS VARCHAR) END AS v, 'u' || (event_id % 4) AS url FROM events)
SELECT user_id, event_type, min(event_id) AS first, arg_max(v, event_id) FILTER (WHERE trim(v) <> '') AS v, array_to_string(list_sort(list(DISTINCT url)), ',') AS urls FROM e GROUP BY user_id, event_type""")
def merged_lists(spark, d):
    """Events merged by key: the last filled value, and all addresses."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise((F.col("event_id") % 100).cast("string")).alias("v"), F.array(F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string"))).alias("urls"))
    return survivorship.merged_by_key(e, "user_id", "event_type", "event_id", ["v"], ["urls"]).withColumn("urls", F.array_join("urls", ","))


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'game' ELSE 'anime' END AS kind, CASE p_size % 4 WHEN 0 THEN 'Light Novel ' || p_name WHEN 1 THEN '视觉小说' WHEN 2 THEN p_name ELSE 'novel' END AS t, p_size % 5 = 0 AS tagged FROM part)
SELECT p_partkey, CASE WHEN kind = 'book' THEN CASE WHEN t LIKE 'Light%' THEN 'light_novel' WHEN t = '视觉小说' OR t = 'novel' OR tagged THEN 'novel' ELSE 'manga' END WHEN kind = 'game' THEN CASE WHEN t = '视觉小说' THEN 'visual_novel' ELSE 'game' END ELSE 'anime' END AS media_type,
  CASE WHEN kind = 'book' THEN CASE WHEN t LIKE 'Light%' THEN 'light_novel_series' WHEN t = '视觉小说' OR t = 'novel' OR tagged THEN 'novel_series' ELSE 'manga_series' END WHEN kind = 'game' AND t = '视觉小说' THEN 'visual_novel' ELSE 'unknown' END AS format FROM p""")
def media_subtypes(spark, d):
    """Subtypes of parts as books and games."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "book").when(k % 3 == 1, "game").otherwise("anime")
    described = F.when(size % 4 == 0, F.concat(F.lit("Light Novel "), "p_name")).when(size % 4 == 1, "视觉小说").when(size % 4 == 2, F.col("p_name")).otherwise("novel")
    tags = F.when(size % 5 == 0, F.array(F.lit("小说"))).otherwise(F.lit(None).cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", upkeep.media_subtype(kind, described, tags).alias("s")).select("p_partkey", "s.*")


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag AS code, CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'R' THEN 'E' END AS grade, l_returnflag IN ('A', 'R') AS registered, CASE WHEN l_linenumber % 2 = 0 THEN 'none' ELSE l_linestatus END AS mode FROM lineitem""")
def registered_codes(spark, d):
    """Lines with a registry's grade of their code, and a default for blank modes."""
    registry = spark.createDataFrame([("A", "D"), ("R", "E")], "code string, grade string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("code"), F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.col("l_linestatus")).alias("mode"))
    return upkeep.with_defaults(upkeep.looked_up(rows, registry, "code", ["grade"]), {"mode": "none"})


@query("SELECT c_custkey, c_acctbal AS value, b AS before FROM (SELECT c_custkey, c_acctbal, lag(c_acctbal) OVER (ORDER BY c_custkey) AS b, lag(c_custkey) OVER (ORDER BY c_custkey) AS k FROM customer) WHERE k = c_custkey - 1 AND NOT c_acctbal > b")
def out_of_order(spark, d):
    """Customers whose balance is not above the one before."""
    return upkeep.out_of_order(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal"))


_KEYS = ("merge_title", "identity_title", "descriptive", "ingest_title", "merge_plan_title", "duplicate_title", "payload_title", "alnum_title")


@query(r"""
WITH t AS (SELECT doc_id, lower(substr(text, 1, 200)) AS t FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]*'))
SELECT doc_id, regexp_replace(t, '[\p{P}\p{S}\s]+', '', 'g') AS merge_title, regexp_replace(t, '\s+', '', 'g') AS identity_title, trim(regexp_replace(t, '\s+', ' ', 'g')) AS descriptive,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '[\[\]()]', '', 'g'), '[,:;!?.~_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS ingest_title,
  regexp_replace(regexp_replace(t, '\s+', '', 'g'), '[\[\](){}!?:;,.''`"~_-]+', '', 'g') AS merge_plan_title, regexp_replace(regexp_replace(t, '\s+', '', 'g'), '[-~:;,.!?''"\[\]()<>]', '', 'g') AS duplicate_title,
  regexp_replace(regexp_replace(t, '\s+', '', 'g'), '[-~:;,.!?''"\[\]()]', '', 'g') AS payload_title, regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g') AS alnum_title FROM t""")
def document_keys(spark, d):
    """Eight more keys, of the beginnings of documents in ASCII, which SQL can spell."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    start = F.substring("text", 1, 200)
    return docs.select("doc_id", *[keys.key(k, start, compose=False).alias(k) for k in _KEYS])
