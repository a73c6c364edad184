"""Registered queries of byte-exact reading, source pickers, creator pages and checks with whole results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import audits, creators, diff, entity
from tessera.queries import query
from tessera.session import shared_folder, spread, table
from tessera.sources import pickers, readers, strict


def _new_folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# -- files ----------------------------------------------------------------------------------------

_TOTALS = "SELECT n_nationkey AS n, n_name || '|' || count(c_custkey) || '|' || coalesce(CAST(sum(c_custkey) AS BIGINT), 0) || chr(10) AS body FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"


def _written(spark, d):
    """One file for each nation, with its name, customers and the sum of their keys."""
    path = _new_folder(spark)
    totals = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("k"), F.coalesce(F.sum("c_custkey"), F.lit(0)).cast("long").alias("s"))
    totals.select(F.col("n_nationkey").alias("n"), F.concat_ws("|", "n_name", F.col("k").cast("string"), F.col("s").cast("string")).alias("value")).write.partitionBy("n").text(path)
    found = strict.receipts(spark, path, path)
    return found.withColumn("file", F.regexp_extract("file", r"^n=(\d+)/", 1))


@query(f"SELECT CAST(n AS VARCHAR) AS file, CAST(length(body) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS lines, sha256(body) AS sha256 FROM ({_TOTALS})")
def file_digests(spark, d):
    """Receipts of files as they were read, digests and all."""
    return _written(spark, d).select("file", "bytes", "lines", "sha256")


@query(f"SELECT count(*) AS n, sha256(string_agg(sha256(body) || '  ' || n || chr(10), '' ORDER BY CAST(n AS VARCHAR))) AS sha256 FROM ({_TOTALS})")
def root_digest(spark, d):
    """One digest of all files' receipts."""
    return strict.root_receipt(_written(spark, d))


@query("SELECT count(*) AS n, sha256(string_agg(doc_id || chr(9) || sha256(coalesce(text, '')) || chr(10), '' ORDER BY length(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR))) AS sha256 FROM documents")
def document_set_digest(spark, d):
    """The digest of all documents' ids and digests."""
    return strict.document_set_digest(table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "doc_id", "h")


@query("""
SELECT CASE k WHEN 0 THEN '' WHEN 1 THEN '{"id": ' || o_orderkey || '}' WHEN 2 THEN '{"status":"' || o_orderstatus || '","id":' || o_orderkey || '}' WHEN 3 THEN '{"id":' || o_orderkey WHEN 4 THEN '{"id":' || o_orderkey || '}' || chr(13)
    WHEN 5 THEN '{"id":1,"id":' || o_orderkey || '}' WHEN 6 THEN '[' || o_orderkey || ']' WHEN 7 THEN '{"id":' || o_orderkey || '}' ELSE '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' END AS text,
  CASE k WHEN 0 THEN 'blank_line' WHEN 1 THEN 'not_canonical' WHEN 2 THEN 'not_canonical' WHEN 3 THEN 'not_json' WHEN 4 THEN 'carriage_return' WHEN 5 THEN 'repeated_key' WHEN 6 THEN 'not_an_object' WHEN 7 THEN 'other_fields' END AS fault
FROM (SELECT *, o_orderkey % 13 AS k FROM orders)""")
def strict_scan(spark, d):
    """Lines of JSON with every fault that one line can have.

    A writer whose first task has no rows leaves an empty file; that is a fault of a file without lines.
    """
    path = _new_folder(spark)
    k, key, status = F.col("o_orderkey") % 13, F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    lines = ["", ('{"id": ', key, "}"), ('{"status":"', status, '","id":', key, "}"), ('{"id":', key), ('{"id":', key, "}\r"), ('{"id":1,"id":', key, "}"), ("[", key, "]"), ('{"id":', key, "}")]
    line = F.concat(F.lit('{"id":'), key, F.lit(',"status":"'), status, F.lit('"}'))
    for i, parts in enumerate(lines):
        line = F.when(k == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in (parts or ("",))])).otherwise(line)
    table(spark, d, "orders").select(line.alias("value")).write.option("lineSep", "\n").text(path)
    return strict.strict_lines(spark, path, fields=["id", "status"]).where("line > 0").select("text", "fault")


@query("SELECT 'good' AS kind, o_orderkey AS k, NULL AS line FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'bad', NULL, '{broken ' || o_orderkey FROM orders WHERE o_orderkey % 9 = 0")
def lenient_rows(spark, d):
    """Every good row and every bad line of a lenient read."""
    path, k = _new_folder(spark), F.col("o_orderkey").cast("string")
    good = F.concat(F.lit('{"k":'), k, F.lit("}"))
    line = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("{broken "), k)).when(F.col("o_orderkey") % 9 == 1, F.concat(F.lit("﻿"), good, F.lit("\n   "))).otherwise(good)
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    rows, bad = readers.jsonl_lenient(spark, path, "k long")
    return rows.select(F.lit("good").alias("kind"), "k", F.lit(None).cast("string").alias("line")).unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(None).cast("long").alias("k"), "line"))


@query("""
WITH f AS (SELECT event_id, props->>'$.k' AS k, event_type AS t FROM events), g AS (SELECT *, CASE event_id % 4 WHEN 0 THEN '-1' ELSE k END AS k2, CASE event_id % 3 WHEN 0 THEN t END AS more FROM f)
SELECT event_id, '$.k' AS path, k AS value_left, k2 AS value_right FROM g WHERE k <> k2
UNION ALL SELECT event_id, '$.more.x[1]', NULL, '"' || more || '"' FROM g WHERE more IS NOT NULL
UNION ALL SELECT event_id, '$.more.x[0]', NULL, 'null' FROM g WHERE more IS NOT NULL""")
def json_path_changes(spark, d):
    """Every path that differs between two documents, with both values."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("props").alias("doc"))
    k = F.when(F.col("event_id") % 4 == 0, F.lit("-1")).otherwise(F.get_json_object("doc", "$.k"))
    more = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"more":{"x":[null,"'), "event_type", F.lit('"]}'))).otherwise("")
    after = e.select("event_id", F.concat(F.lit('{"k":'), k, more, F.lit("}")).alias("doc"))
    return diff.json_diff(e.select("event_id", "doc"), after, "event_id", "doc")


# -- sources, creators and documents --------------------------------------------------------------


@query("""
WITH p AS (SELECT *, ['bangumi', 'anilist', 'vndb', 'other'][CAST(p_partkey % 4 AS INTEGER) + 1] AS source, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name FROM part)
SELECT p_partkey, name AS title, CASE source WHEN 'vndb' THEN 'v' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS source_id, CASE source WHEN 'bangumi' THEN trim(p_brand) || ',' || trim(p_type) WHEN 'anilist' THEN trim(p_brand) WHEN 'vndb' THEN trim(p_type) ELSE '' END AS aliases,
  CASE source WHEN 'bangumi' THEN '2001-0' || (p_size % 9 + 1) WHEN 'anilist' THEN '20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-05' END AS release_date, CASE source WHEN 'other' THEN '' ELSE trim(p_brand) END AS creators FROM p""")
def picked_sources(spark, d):
    """Part names as four sources would write them."""
    p = spread(table(spark, d, "part"), "p_partkey")
    source = F.element_at(F.array(*[F.lit(x) for x in ("bangumi", "anilist", "vndb", "other")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    shapes = {
        "bangumi": F.struct(F.struct(F.col("p_name").alias("name"), key.alias("id")).alias("subject"), F.concat_ws("; ", "p_brand", "p_type").alias("aliases"), F.concat(F.lit("2001-0"), (F.col("p_size") % 9 + 1).cast("string")).alias("date"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("staff")),
        "anilist": F.struct(F.struct(F.col("p_name").alias("userPreferred"), F.col("p_brand").alias("native")).alias("title"), F.struct(F.col("p_partkey").alias("id")).alias("media"), F.struct(F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("year"), F.lit(5).alias("month"), F.lit(None).cast("int").alias("day")).alias("startDate"), F.array("p_brand", "p_brand").alias("studios")),
        "vndb": F.struct(F.col("p_name").alias("title"), key.alias("vid"), F.col("p_type").alias("original"), F.col("p_brand").alias("developer")),
        "other": F.struct(F.col("p_name").alias("displayTitle"), key.alias("external_id")),
    }
    document = F.lit(None).cast("string")
    for name, shape in shapes.items():
        document = F.when(source == name, F.to_json(shape)).otherwise(document)
    rows = p.select("p_partkey", source.alias("source"), document.alias("doc"))
    return pickers.picked(rows, "doc", "source").select("p_partkey", "title", "source_id", F.array_join("aliases", ",").alias("aliases"), "release_date", F.array_join("creators", ",").alias("creators"))


@query("""
WITH w AS (SELECT l_suppkey, o_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS dt, strftime(o_orderdate, '%Y') AS y, o_orderpriority AS t, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT l_suppkey, count(*) AS all_total, count(*) FILTER (y = '1995') AS total, array_to_string(list_sort(list(DISTINCT y), 'DESC'), ',') AS years FROM w GROUP BY 1),
r AS (SELECT l_suppkey, id, row_number() OVER (PARTITION BY l_suppkey ORDER BY dt DESC, t, id) AS place FROM w WHERE y = '1995')
SELECT l_suppkey, id, place, total, all_total, years FROM r JOIN c USING (l_suppkey) WHERE place BETWEEN 11 AND 20""")
def creator_pages(spark, d):
    """The second page of every supplier's lines of one year, titles in a locale's order."""
    w = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = w.select("l_suppkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"), "o_orderpriority", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    page = creators.creator_page(w, "l_suppkey", F.col("dt"), F.col("o_orderpriority"), F.col("id").cast("string"), year="1995", offset=10, limit=10)
    return page.select("l_suppkey", "id", "place", "total", "all_total", F.array_join("years", ",").alias("years"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<br\s*/?\s*>', chr(10), 'gi'), '</(?:p|div|li|h[1-6]|section|article|tr|dt|dd)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n\t\r]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM c""")
def page_texts(spark, d):
    """Plain text of every page's HTML."""
    return table(spark, d, "pages").select("page_id", audits.plain_text(F.col("html")).alias("text"))


@query("""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT conv_id, string_agg(role || ':' || turn, ',' ORDER BY turn) AS firsts FROM t WHERE k = 1 GROUP BY 1""")
def first_wins_fields(spark, d):
    """Each conversation's first turn of every role, by a field of its structs."""
    each = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    kept = entity.first_wins(F.col("turns"), "role")
    return each.select("conv_id", F.array_join(F.transform(kept, lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), ",").alias("firsts"))
