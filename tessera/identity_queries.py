"""Registered queries of tiers, merge policies, identity candidates and series, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.queries import query
from tessera.session import table

# -- tiers: customers as records, suppliers as works ----------------------------------------------

_TIER_PAIRS = """
c AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS bal, c_nationkey AS n FROM customer), s AS (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS bal, s_nationkey AS n FROM supplier),
met AS (
  SELECT c_custkey, s_suppkey, 0 AS t FROM c JOIN s ON c.n = s.n AND floor(c.bal / 100) = floor(s.bal / 100)
  UNION ALL SELECT c_custkey, s_suppkey, 1 FROM c JOIN s ON floor(c.bal / 7) = floor(s.bal / 7)
  UNION ALL SELECT c_custkey, s_suppkey, 1 FROM c JOIN s ON c_custkey % 500 = s_suppkey % 500
  UNION ALL SELECT c_custkey, s_suppkey, 2 FROM c JOIN s ON c_custkey % 700 = s_suppkey % 700 AND c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, s_suppkey, CASE WHEN abs(c.bal - s.bal) <= 3000 THEN 3 ELSE 4 END FROM c JOIN s ON c.n = s.n AND c_custkey % 5 = s_suppkey % 5),
pairs AS (SELECT c_custkey, s_suppkey, min(t) AS t FROM met GROUP BY ALL),
roles AS (SELECT *, CASE WHEN t = 4 THEN 'weak' WHEN t = min(t) OVER (PARTITION BY c_custkey) THEN 'primary' ELSE 'conflict' END AS role,
  ['site_id', 'external_id', 'slug', 'title_media_date', 'title_media_weak'][t + 1] AS tier FROM pairs)"""


def _tiers(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    word = lambda *x: F.concat_ws(":", *[y.cast("string") for y in x])

    def sides(key, nation, balance):
        bal = F.floor(balance)
        return (
            F.array(word(nation, F.floor(bal / 100))), F.array(word(F.lit("a"), F.floor(bal / 7)), word(F.lit("b"), key % 500)),
            F.array(word(key % 700)), F.array(word(nation, key % 5)), bal,
        )

    mine, theirs = sides(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")), sides(F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal"))
    slug = F.when(F.col("c_custkey") % 3 == 0, mine[2]).otherwise(F.array(F.lit("")))
    tiers = {"site_id": (mine[0], theirs[0]), "external_id": (mine[1], theirs[1]), "slug": (slug, theirs[2]), "title_media_date": (mine[3], theirs[3])}
    near = lambda x, y: F.abs(x - y) <= 3000
    return c, identity.tier_matches(c, s, "c_custkey", "s_suppkey", tiers, facts=(mine[4], theirs[4]), weak={"title_media_date": ("title_media_weak", near)})


@query(f"WITH {_TIER_PAIRS} SELECT c_custkey, s_suppkey, tier, role FROM roles")
def tier_matches(spark, d):
    """Matches of every customer by tier, with the works that lower tiers name besides."""
    return _tiers(spark, d)[1]


@query(f"""
WITH {_TIER_PAIRS},
per AS (SELECT c_custkey, count(*) FILTER (role = 'primary') AS p, count(*) FILTER (role = 'conflict') AS k, count(*) FILTER (role = 'weak') AS w, min(s_suppkey) FILTER (role = 'primary') AS one,
  min(tier) FILTER (role = 'primary') AS pt FROM roles GROUP BY 1),
b AS (SELECT c.c_custkey, coalesce(p, 0) AS p, coalesce(k, 0) AS k, coalesce(w, 0) AS w, one, pt,
  list_filter([CASE WHEN c.c_custkey % 50 = 0 THEN 'missing_title' END, CASE WHEN k > 0 THEN 'identity_tier_conflict' END, CASE WHEN p > 1 THEN 'ambiguous_' || pt || '_match' END], lambda x: x IS NOT NULL) AS blockers FROM customer c LEFT JOIN per USING (c_custkey))
SELECT c_custkey, CASE WHEN len(blockers) > 0 THEN 'blocked' WHEN p = 1 AND pt <> 'title_media_date' THEN 'update' WHEN p + w > 0 THEN 'review' ELSE 'create' END AS action,
  coalesce(pt, CASE WHEN w > 0 THEN 'title_media_weak' ELSE 'none' END) AS tier, CASE WHEN p = 1 THEN one END AS s_suppkey, p AS n_primary, k AS n_conflict, w AS n_weak, array_to_string(blockers, ',') AS blockers FROM b""")
def tier_plan(spark, d):
    """What becomes of every customer as a record found."""
    c, found = _tiers(spark, d)
    own = F.when(F.col("c_custkey") % 50 == 0, F.array(F.lit("missing_title"))).otherwise(F.array().cast("array<string>"))
    return identity.tier_plan(c, found, "c_custkey", "s_suppkey", blockers=own, exact=("site_id", "external_id", "slug")).withColumn("blockers", F.array_join("blockers", ","))


# -- merge policies -------------------------------------------------------------------------------

_POLICY_ROWS = """
k AS (SELECT c_custkey AS id, 'b' || CAST(floor(c_acctbal * 10) AS BIGINT) AS strong, c_nationkey || '|' || c_mktsegment || '|' || CAST(floor(c_acctbal / 60) AS BIGINT) AS title,
  [[], [2000], [2000, 2001], [2001]][CAST(c_custkey % 4 AS INTEGER) + 1] AS years FROM customer),
t AS (SELECT title FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
p AS (SELECT a.id AS x, b.id AS y, len(list_distinct(list_concat(a.years, b.years))) <= 1 OR len(a.years) + len(b.years) < 2 AS fits FROM k a JOIN k b ON a.title = b.title AND a.id <> b.id JOIN t ON t.title = a.title),
s AS (SELECT a.id AS x, b.id AS y FROM k a JOIN k b ON a.strong = b.strong AND a.id <> b.id)"""


def _components(name: str, edges: str) -> str:
    return f"{name}_e AS ({edges}), {name}_r(id, c) AS (SELECT id, id FROM k UNION SELECT e.y, r.c FROM {name}_r r JOIN {name}_e e ON r.id = e.x), {name} AS (SELECT id, min(c) AS c FROM {name}_r GROUP BY 1)"


_POLICIES = ",\n".join((_POLICY_ROWS, _components("broad", "SELECT x, y FROM p"), _components("dated", "SELECT x, y FROM p WHERE fits"), _components("whole", "SELECT x, y FROM p WHERE fits UNION SELECT x, y FROM s")))


def _policies(spark, d):
    """Groups by titles alone, by titles in compatible years, and by strong keys besides."""
    c = table(spark, d, "customer")
    words = lambda sep, *x: F.concat_ws(sep, *[y.cast("string") for y in x])
    strong = F.array(words("", F.lit("b"), F.floor(F.col("c_acctbal") * 10)))
    titles = F.array(words("|", F.col("c_nationkey"), F.col("c_mktsegment"), F.floor(F.col("c_acctbal") / 60)))
    none, ints = F.array().cast("array<string>"), lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<int>")
    years = F.element_at(F.array(ints(), ints(2000), ints(2000, 2001), ints(2001)), (F.col("c_custkey") % 4 + 1).cast("int"))
    plan = lambda *x: identity.merge_plan(c, "c_custkey", *x, most=8)
    return c, {"broad": plan(none, titles, ints()), "dated": plan(none, titles, years), "whole": plan(strong, titles, years)}


@query(f"WITH RECURSIVE {_POLICIES} SELECT id AS c_custkey, c AS component FROM whole")
def merge_plan(spark, d):
    """Customers merged by strong keys and by titles in compatible years."""
    return _policies(spark, d)[1]["whole"]


@query(f"""
WITH RECURSIVE {_POLICIES},
named AS (SELECT 'broad' AS policy, * FROM broad UNION ALL SELECT 'dated', * FROM dated UNION ALL SELECT 'whole', * FROM whole),
f AS (SELECT policy, c, c_nationkey AS provider, c_custkey % 40 AS site, c_mktsegment AS media, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 END AS grade, ['rated', 'excluded', 'assessed'][CAST(c_custkey % 3 AS INTEGER) + 1] AS state FROM named JOIN customer ON id = c_custkey),
per AS (SELECT policy, c, max(n) AS sites FROM (SELECT policy, c, provider, count(DISTINCT site) AS n FROM f GROUP BY ALL) GROUP BY ALL),
g AS (SELECT policy, c, count(*) AS n, count(DISTINCT media) AS media, count(DISTINCT grade) AS grades, bool_or(state = 'rated') AND bool_or(state = 'excluded') AS hides FROM f GROUP BY ALL)
SELECT policy, CAST(sum(n) AS BIGINT) AS source_works, count(*) AS visible_works, CAST(sum(n) - count(*) AS BIGINT) AS merged_away, count(*) FILTER (n > 1) AS groups, max(n) AS largest, count(*) FILTER (n > 1 AND sites > 1) AS provider_conflicts,
  count(*) FILTER (n > 1 AND media > 1) AS mixed_media, count(*) FILTER (n > 1 AND grades > 1) AS mixed_grades, count(*) FILTER (n > 1 AND hides) AS hidden_states FROM g JOIN per USING (policy, c) GROUP BY 1""")
def policy_counts(spark, d):
    """Counts of each merge policy's groups and of those that should not be."""
    c, policies = _policies(spark, d)
    out = None
    for name, parts in policies.items():
        key = F.col("c_custkey")
        state = F.element_at(F.array(F.lit("rated"), F.lit("excluded"), F.lit("assessed")), (key % 3 + 1).cast("int"))
        counts = identity.merge_counts(c.join(parts, "c_custkey"), "component", provider=F.col("c_nationkey"), site=key % 40, media=F.col("c_mktsegment"), grade=F.when(key % 3 == 0, key % 5), state=state, blocking=("excluded",))
        counts = counts.select(F.lit(name).alias("policy"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


@query(f"""
WITH RECURSIVE {_POLICIES},
x AS (SELECT 'broad to dated' AS policies, a.c AS a, b.c AS b FROM broad a JOIN dated b USING (id) UNION ALL SELECT 'dated to whole', a.c, b.c FROM dated a JOIN whole b USING (id)),
n AS (SELECT policies, a, b, count(*) AS n FROM x GROUP BY ALL)
SELECT policies, 'split' AS change, a AS component, count(*) AS parts, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest FROM n GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT policies, 'merged', b, count(*), CAST(sum(n) AS BIGINT), max(n) FROM n GROUP BY ALL HAVING count(*) > 1""")
def policy_changes(spark, d):
    """Groups that the next policy splits or merges."""
    _, p = _policies(spark, d)
    pairs = [("broad to dated", "broad", "dated"), ("dated to whole", "dated", "whole")]
    named = [identity.policy_changes(p[a], p[b], "c_custkey").select(F.lit(n).alias("policies"), "*") for n, a, b in pairs]
    return named[0].unionByName(named[1])


# -- identity candidates and series ---------------------------------------------------------------


def _evidence(spark, d):
    """Parts as entities: brand and size as source id, name as title, neighbours by key as edges."""
    p = table(spark, d, "part")
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    entity = F.concat(F.lit("p"), key.cast("string"))
    edge = F.element_at(F.array(*[F.lit(x) for x in ("possible_duplicate_of", "linked_to_existing_work", "candidate_child_of", "same_creator", "")]), (F.col("p_size") % 5 + 1).cast("int"))
    base = dict(entity=entity, media=F.when(F.col("p_size") % 4 > 0, F.col("p_type")), scope=F.when(key % 3 > 0, (key % 2).cast("string")))
    kinds = [
        dict(kind=F.lit("source_id"), value=F.concat_ws(":", "p_brand", F.col("p_retailprice").cast("string")), edge_type=none, source=none, target=none),
        dict(kind=F.lit("normalized_title"), value=F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(F.substring("p_name", 1, 2)), edge_type=none, source=none, target=none),
        dict(kind=F.lit("graph_edge"), value=none, edge_type=edge, source=entity, target=F.concat(F.lit("p"), (key + F.col("p_size")).cast("string"))),
    ]
    parts = [p.where(edge != "" if k["edge_type"] is not none else F.lit(True)).select(*[v.alias(c) for c, v in {**base, **k}.items()]) for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CANDIDATES = """
WITH p AS (SELECT 'p' || p_partkey AS entity, p_partkey, p_size, CASE WHEN p_size % 4 > 0 THEN p_type END AS media, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 2 AS VARCHAR) END AS scope, p_brand || ':' || CAST(p_retailprice AS VARCHAR) AS sid,
  trim(CASE WHEN p_size > 5 THEN p_name ELSE substr(p_name, 1, 2) END) AS title, ['possible_duplicate_of', 'linked_to_existing_work', 'candidate_child_of', 'same_creator', ''][CAST(p_size % 5 AS INTEGER) + 1] AS edge FROM part),
m AS (
  SELECT 'same_source_id' AS candidate_type, sid AS group_key, entity, '' AS title, 85 AS score FROM p
  UNION SELECT 'title_match', title || '||' || coalesce(media, 'unknown'), entity, title, CASE WHEN length(title) <= 2 THEN 25 ELSE 45 END FROM p WHERE title <> ''
  UNION SELECT CASE edge WHEN 'possible_duplicate_of' THEN 'graph_possible_duplicate' WHEN 'linked_to_existing_work' THEN 'graph_existing_work_link' WHEN 'candidate_child_of' THEN 'boundary_relation' ELSE 'graph_relation' END, edge || ':' || entity || '->p' || (p_partkey + p_size), unnest([entity, 'p' || (p_partkey + p_size)]), '',
    CASE edge WHEN 'possible_duplicate_of' THEN 20 WHEN 'linked_to_existing_work' THEN 70 WHEN 'candidate_child_of' THEN 50 ELSE 60 END FROM p WHERE edge <> ''),
g AS (SELECT candidate_type, group_key, count(DISTINCT m.entity) AS members, count(DISTINCT media) AS media_types, count(DISTINCT scope) AS scopes, max(score) AS base FROM m JOIN p ON p.entity = m.entity GROUP BY ALL HAVING count(DISTINCT m.entity) > 1),
s AS (SELECT *, CAST(CASE WHEN candidate_type = 'same_source_id' AND scopes > 1 THEN 75 ELSE base END AS INTEGER) AS score FROM g)"""


@query(_CANDIDATES + """
SELECT candidate_type, group_key, members, media_types, scopes, score, CASE WHEN score >= 60 THEN '60-89' WHEN score >= 30 THEN '30-59' ELSE '0-29' END AS band,
  CASE WHEN candidate_type = 'graph_possible_duplicate' THEN 'identity_conflict' WHEN candidate_type = 'title_match' OR score < 60 THEN 'weak_title_only_candidate' ELSE 'review_match_candidate' END AS class FROM s""")
def identity_candidates(spark, d):
    """Groups of parts that ids, titles or edges hold for one, scored and classed."""
    return identity.identity_candidates(_evidence(spark, d))[0]


@query(_CANDIDATES + " SELECT DISTINCT m.candidate_type, m.group_key, m.entity FROM m JOIN s USING (candidate_type, group_key) JOIN p ON p.entity = m.entity")
def identity_members(spark, d):
    """Members of the groups, one row each."""
    return identity.identity_candidates(_evidence(spark, d))[1]


@query(r"""
WITH p AS (SELECT p_partkey, regexp_replace(p_name, '(?i)(\s+(ova|sp|special|movie|high))+$', '') AS n, p_name FROM part),
t AS (SELECT *, p_name || [' 2nd season', ' OVA', '!', ' movie special~', '', ' 第二期'][CAST(p_partkey % 6 AS INTEGER) + 1] AS title, CASE WHEN p_partkey % 7 = 0 THEN 'Mini ' || p_name || ' SP' END AS alias FROM p),
s AS (SELECT p_partkey, title, CASE WHEN alias IS NOT NULL AND length(p_name || ' SP') >= 4 AND n <> title THEN n END AS from_alias, n FROM t)
SELECT p_partkey, regexp_replace(regexp_replace(lower(coalesce(from_alias, n)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS key, coalesce(from_alias, n) AS series, CASE WHEN from_alias IS NULL THEN 'title_heuristic' ELSE 'alias_heuristic' END AS source,
  CASE WHEN coalesce(from_alias, n) <> title THEN 'title_variant' ELSE 'title_base' END AS confidence FROM s""")
def series_groups(spark, d):
    """The series of part names with the endings of variants, some known by a small edition's name."""
    p = table(spark, d, "part")
    endings = F.array(*[F.lit(x) for x in (" 2nd season", " OVA", "!", " movie special~", "", " 第二期")])
    title = F.concat("p_name", F.element_at(endings, (F.col("p_partkey") % 6 + 1).cast("int")))
    alias = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("Mini "), "p_name", F.lit(" SP"))).otherwise("")
    rows = p.select("p_partkey", title.alias("title"), alias.alias("alias"))
    return identity.series_groups(rows, "p_partkey", "title", F.array("title", "alias"))
