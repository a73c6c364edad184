"""Matches in tiers, merge policies and their comparison, scores of identity candidates, series of titles."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.operators.components import connected_components
from tessera.operators.skew import any_repeats, join_by_work
from tessera.operators.survivorship import bound, series_base

Tiers = Mapping[str, tuple[Column, Column]]


def tier_matches(records: DataFrame, works: DataFrame, record: str, work: str, tiers: Tiers, *, facts: tuple[Column, Column] | None = None, weak: Mapping[str, tuple[str, Callable[[Column, Column], Column]]] | None = None) -> DataFrame:
    """Every record's matches by their best tier, and what they mean to it.

    ``tiers``, best first: name to the records' and the works' keys (arrays).  ``weak`` takes matches of
    a tier for which a condition over both sides' ``facts`` fails into a last tier of its own name.
    All tiers are one table of keys and one join, and a pair comes from the first key of its best tier,
    so that pairs are made where they meet and never dealt again (unless ids repeat).  Returns the record, the work, ``tier``, and ``role``:
    ``primary`` in the record's best tier, ``conflict`` for another work in a lower one, ``weak`` below.
    Blank keys match nothing.
    """
    names, weak = list(tiers), weak or {}
    last = {t: len(names) + i for i, t in enumerate(weak)}
    labels = [*names, *(w for w, _ in weak.values())]

    def keyed(rows: DataFrame, side: int, row_id: str, own: str) -> DataFrame:
        filled = lambda x: F.array_distinct(F.filter(F.transform(x, lambda k: k.cast("string")), lambda k: F.coalesce(F.trim(k), F.lit("")) != ""))
        each = [F.coalesce(filled(tiers[t][side]), F.array().cast("array<string>")).alias(f"{own}_{i}") for i, t in enumerate(names)]
        fact = facts[side] if facts else F.lit(None)
        numbered = lambda i: F.transform(f"{own}_{i}", lambda k: F.struct(F.lit(i).alias("t"), k.alias("k")))
        flat = F.flatten(F.array(*[numbered(i) for i in range(len(names))]))
        kept = [own, f"{own}_facts", *[f"{own}_{i}" for i in range(len(names))]]
        return rows.select(F.col(row_id).alias(own), fact.alias(f"{own}_facts"), *each).select(*kept, F.explode(flat).alias("e")).select(*kept, "e.t", "e.k")

    def shared(i: int) -> Column:
        r, w = F.col(f"r_{i}"), F.col(f"w_{i}")
        return F.when((F.size(r) == 1) & (F.size(w) == 1), F.get(r, F.lit(0)) == F.get(w, F.lit(0))).otherwise(F.arrays_overlap(r, w))

    mine, theirs = keyed(records, 0, record, "r").where("r is not null"), keyed(works, 1, work, "w")
    fit = {names.index(t): F.coalesce(fits(F.col("r_facts"), F.col("w_facts")), F.lit(False)) for t, (_, fits) in weak.items()}

    # A record's best tier: one that needs no look at facts by its keys, any other by its pairs.
    plain = [i for i in range(len(names)) if i not in fit]
    firsts = mine.where(F.col("t").isin(plain)).join(theirs.select("t", "k").distinct().hint("merge"), ["t", "k"], "left_semi").select("r", "t")
    for i in (i for i in fit if i < len(names) - 1):
        firsts = firsts.unionByName(join_by_work(mine.where(F.col("t") == i), theirs.where(F.col("t") == i), ["t", "k"]).where(fit[i]).select("r", "t"))
    firsts = firsts.groupBy("r").agg(F.min("t").alias("first"))
    met = join_by_work(mine.join(firsts.hint("merge"), "r", "left"), theirs, ["t", "k"])

    better, tier = F.lit(False), F.col("t")
    for i in range(len(names)):
        by = lambda js: reduce(lambda x, y: x | y, [shared(j) & fit.get(j, F.lit(True)) for j in js], F.lit(False))
        earlier = by(range(i))
        if i in fit:
            weaker = reduce(lambda x, y: x | y, [shared(j) for j in fit if last[names[j]] < last[names[i]]], F.lit(False))
            earlier = F.when(fit[i], earlier).otherwise(by(j for j in range(len(names)) if j != i) | weaker)
            tier = F.when((F.col("t") == i) & ~fit[i], last[names[i]]).otherwise(tier)
        again = (F.size(f"r_{i}") > 1) & (F.size(f"w_{i}") > 1) & (F.get(F.array_intersect(f"r_{i}", f"w_{i}"), F.lit(0)) != F.col("k"))
        better = F.when(F.col("t") == i, earlier | again).otherwise(better)
    pairs = met.where(~better).select("r", "w", tier.alias("t"), "first")
    if any_repeats(records, record) or any_repeats(works, work):
        pairs = pairs.groupBy("r", "w").agg(F.min("t").alias("t"), F.min("first").alias("first"))
    role = F.when(F.col("t") >= len(names), "weak").when(F.col("t") == F.coalesce("first", "t"), "primary").otherwise("conflict")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("t") + 1).cast("int"))
    return pairs.select(F.col("r").alias(record), F.col("w").alias(work), label.alias("tier"), role.alias("role"))


def tier_plan(records: DataFrame, matches: DataFrame, record: str, work: str, *, blockers: Column | None = None, exact: tuple[str, ...]) -> DataFrame:
    """One row for each record: ``action``, ``tier``, its one work, counts by role, and ``blockers``.

    Two works in the best tier, or another work in a lower one, block; one work in one of the ``exact``
    tiers updates it; any other match is to be reviewed; none makes a draft.
    """
    # By tier first, so that pairs only add to counts where they are made and no text is sorted for each.
    counted = matches.groupBy(F.col(record).alias("of"), "role", "tier").agg(F.count("*").alias("n"), F.min(work).alias("least"))
    count = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(f"n_{role}")
    per = counted.groupBy("of").agg(
        count("primary"), count("conflict"), count("weak"), F.min(F.when(F.col("role") == "primary", F.col("least"))).alias("one"),
        F.first(F.when(F.col("role") == "primary", F.col("tier")), True).alias("primary_tier"), F.min(F.when(F.col("role") == "weak", F.col("tier"))).alias("weak_tier"),
    )
    own = records.select(F.col(record).alias("of_record"), (blockers if blockers is not None else F.array().cast("array<string>")).alias("own"))
    out = own.join(per, F.col("of_record") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    more = F.array_compact(F.array(F.when(zero("n_conflict") > 0, "identity_tier_conflict"), F.when(zero("n_primary") > 1, F.concat(F.lit("ambiguous_"), F.col("primary_tier"), F.lit("_match")))))
    out = out.withColumn("blockers", F.concat("own", more))
    action = (
        F.when(F.size("blockers") > 0, "blocked")
        .when((zero("n_primary") == 1) & F.col("primary_tier").isin(*exact), "update")
        .when(zero("n_primary") + zero("n_weak") > 0, "review")
        .otherwise("create")
    )
    tier = F.coalesce("primary_tier", "weak_tier", F.lit("none"))
    return out.select(F.col("of_record").alias(record), action.alias("action"), tier.alias("tier"), F.when(zero("n_primary") == 1, F.col("one")).alias(work), *[zero(f"n_{r}").alias(f"n_{r}") for r in ("primary", "conflict", "weak")], "blockers")


def merge_plan(rows: DataFrame, row_id: str, strong: Column, titles: Column, years: Column, *, most: int = 30) -> DataFrame:
    """Components of rows that share a strong key, or a title in compatible years.

    ``strong``, ``titles``, ``years``: arrays.  Title keys of more than ``most`` rows link nothing.  Two
    rows of a title fit if they name one year between them, or fewer than two.  So rows without a year
    fit every row that names one only; then all of these hang together, and else each year's rows.
    Links go to the least such row: as many as rows, not pairs.  Returns the row and ``component``.
    """
    named = rows.select(F.col(row_id).alias("id"), F.filter(strong, lambda x: F.coalesce(x, F.lit("")) != "").alias("strong"), F.array_distinct(F.filter(titles, lambda x: F.coalesce(x, F.lit("")) != "")).alias("titles"), F.filter(years, lambda y: y.isNotNull()).alias("years"))
    each = named.select("id", F.explode(F.array_distinct("strong")).alias("k"))
    least = each.groupBy("k").agg(F.min("id").alias("first"))
    links = each.join(least, "k").where("id <> first").select("id", "first")
    titled = named.select("id", F.explode("titles").alias("k"), F.size(F.array_distinct("years")).alias("n"), F.size("years").alias("said"), F.array_min("years").alias("y"))
    size = titled.groupBy("k").agg(F.count("*").alias("rows"), F.min(F.when(F.col("n") == 0, F.col("id"))).alias("undated")).where(F.col("rows").between(2, most))
    inside = titled.join(size, "k")
    # A row that contradicts itself fits none; one dated row and an undated one need no more.
    dated = inside.where("n = 1").groupBy("k", "y").agg(F.min("id").alias("of_year"))
    fits = inside.where("n <= 1").join(dated, ["k", "y"], "left").select("id", F.coalesce("undated", "of_year").alias("first")).where("id <> first")
    found = connected_components(links.unionByName(fits), "id", "first")
    return named.select("id").join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias(row_id), F.coalesce("component", "id").alias("component"))


def merge_counts(parts: DataFrame, component: str, *, provider: Column, site: Column, media: Column, grade: Column, state: Column, blocking: tuple[str, ...]) -> DataFrame:
    """One row of counts for a merge policy: works, visible ones, groups, and groups that should not be.

    ``parts``: works with their component.  A group is wrong if one provider names it twice, or it mixes
    known media or grades, or hides a ``blocking`` state behind a rating.
    """
    named = parts.select(F.col(component).alias("c"), provider.alias("provider"), site.alias("site"), media.alias("media"), grade.alias("grade"), state.alias("state"))
    claims = named.where("provider is not null and site is not null").groupBy("c", "provider").agg(F.count_distinct("site").alias("n")).groupBy("c").agg(F.max("n").alias("sites"))
    groups = named.groupBy("c").agg(
        F.count("*").alias("n"), F.count_distinct("media").alias("media"), F.count_distinct("grade").alias("grades"),
        F.max((F.col("state") == "rated").cast("int")).alias("rated"), F.max(F.col("state").isin(*blocking).cast("int")).alias("blocked"),
    ).join(claims, "c", "left")
    several = F.col("n") > 1
    count = lambda when: F.count(F.when(several & when, 1))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("source_works"), F.count("*").alias("visible_works"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("merged_away"), count(F.lit(True)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        count(F.col("sites") > 1).alias("provider_conflicts"), count(F.col("media") > 1).alias("mixed_media"), count(F.col("grades") > 1).alias("mixed_grades"), count((F.col("rated") == 1) & (F.col("blocked") == 1)).alias("hidden_states"),
    )


def policy_changes(before: DataFrame, after: DataFrame, row_id: str, component: str = "component") -> DataFrame:
    """What a second merge policy does with the groups of a first one, from the counts of rows in common.

    ``split``: a group of the first whose rows lie in several groups of the second; ``merged``: a group
    of the second that holds rows of several of the first.  Returns ``change``, ``component`` (of that
    group), ``parts``, ``rows`` and ``largest`` (rows of its largest part).
    """
    a, b = before.select(F.col(row_id).alias("id"), F.col(component).alias("a")), after.select(F.col(row_id).alias("id"), F.col(component).alias("b"))
    common = a.join(b, "id").groupBy("a", "b").agg(F.count("*").alias("n"))

    def side(of: str, change: str) -> DataFrame:
        return common.groupBy(F.col(of).alias("component")).agg(F.lit(change).alias("change"), F.count("*").alias("parts"), F.sum("n").alias("rows"), F.max("n").alias("largest")).where("parts > 1")

    return side("a", "split").unionByName(side("b", "merged")).select("change", "component", "parts", "rows", "largest")


# Scores of identity candidates, the bands, and reasons that make a conflict.
SAME_SOURCE_ID, OTHER_SCOPES, SAME_TITLE, SHORT_TITLE = 85, 75, 45, 25
EDGE_SCORES = {"possible_duplicate_of": ("graph_possible_duplicate", 20), "linked_to_existing_work": ("graph_existing_work_link", 70), "candidate_child_of": ("boundary_relation", 50), "candidate_edition_of": ("boundary_relation", 50)}
OTHER_EDGE = ("graph_relation", 60)


def identity_candidates(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of entities that evidence holds for one, with score, band and class, and their members.

    Reads entity, kind (``source_id``, ``normalized_title`` or ``graph_edge``), value (of the first two),
    media, scope, and edge_type, source, target (of edges).  Entities that share a source id, or a title
    within a medium, form a group; so do both ends of an edge, if evidence names both.

    Returns (candidates, members): candidate_type, group_key, members, media_types, scopes, score, band
    and class; and candidate_type, group_key, entity, one row each, however large a group is.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    rows = evidence.select(*[filled(c).alias(c) for c in ("entity", "kind", "value", "media", "scope", "edge_type", "source", "target")])
    same = rows.where("kind = 'source_id' and value <> '' and entity <> ''").select(F.lit("same_source_id").alias("candidate_type"), F.col("value").alias("group_key"), "entity", F.lit("").alias("title"), F.lit(SAME_SOURCE_ID).alias("score"))
    medium = F.when(F.col("media") == "", "unknown").otherwise(F.col("media"))
    title = rows.where("kind = 'normalized_title' and value <> '' and entity <> ''").select(F.lit("title_match").alias("candidate_type"), F.concat_ws("||", "value", medium).alias("group_key"), "entity", F.col("value").alias("title"), F.lit(SAME_TITLE).alias("score"))
    kind, score = F.lit(OTHER_EDGE[0]), F.lit(OTHER_EDGE[1])
    for edge, (name, points) in EDGE_SCORES.items():
        kind, score = F.when(F.col("edge_type") == edge, name).otherwise(kind), F.when(F.col("edge_type") == edge, points).otherwise(score)
    edges = rows.where("kind = 'graph_edge'").select("edge_type", "source", "target").distinct()
    edges = edges.select(kind.alias("candidate_type"), F.concat("edge_type", F.lit(":"), "source", F.lit("->"), "target").alias("group_key"), F.explode(F.array("source", "target")).alias("entity"), F.lit("").alias("title"), score.alias("score"))
    # What an entity brings into a group is its first row of evidence there, so any of its rows will do for media and scope.
    own = rows.where("entity <> ''").groupBy("entity").agg(F.min(F.nullif("media", F.lit(""))).alias("media"), F.min(F.nullif("scope", F.lit(""))).alias("scope"))
    members = same.unionByName(title).unionByName(edges).distinct().join(own, "entity")
    groups = members.groupBy("candidate_type", "group_key").agg(
        F.count_distinct("entity").alias("members"), F.count_distinct("media").alias("media_types"), F.count_distinct("scope").alias("scopes"), F.max("score").alias("score"), F.max("title").alias("title")
    ).where("members > 1")
    score = F.when((F.col("candidate_type") == "same_source_id") & (F.col("scopes") > 1), OTHER_SCOPES).when((F.col("candidate_type") == "title_match") & (F.char_length("title") <= 2), SHORT_TITLE).otherwise(F.col("score"))
    groups = groups.withColumn("score", score)
    mixed = (F.col("candidate_type") == "title_match") & (F.col("media_types") > 1)
    klass = (
        F.when((F.col("candidate_type") == "graph_possible_duplicate") | mixed, "identity_conflict")
        .when(F.col("candidate_type") == "title_match", "weak_title_only_candidate")
        .when(F.col("score") >= 90, "strong_match_candidate")
        .when(F.col("score") >= 60, "review_match_candidate")
        .when(F.col("score") >= 30, "weak_title_only_candidate")
        .otherwise("review_match_candidate")
    )
    band = F.when(F.col("score") >= 90, "90-100").when(F.col("score") >= 60, "60-89").when(F.col("score") >= 30, "30-59").otherwise("0-29")
    candidates = groups.select("candidate_type", "group_key", "members", "media_types", "scopes", "score", band.alias("band"), klass.alias("class"))
    return candidates, members.select("candidate_type", "group_key", "entity").distinct().join(groups.select("candidate_type", "group_key"), ["candidate_type", "group_key"], "left_semi")


# Endings and beginnings that variants of a series add to its title, and marks at its end.
SERIES_SUFFIXES = [
    r"(?u)\s+第[一二三四五六七八九十0-9]+[季期部]$",
    r"(?iu)\s+[0-9]+(?:st|nd|rd|th)?\s*(?:season|期|季)$",
    r"(?iu)\s+[0-9]+\s*[☆★]?\s*high$",
    r"(?iu)\s+(?:ova|oad|ona|oav|sp|special|movie)$",
    r"(?u)\s+(?:剧场版|劇場版|特别篇|特別篇|番外篇|外传|外傳)$",
    r"(?iu)\s+(?:夏日时光|暑假时光|夏日時光|なちゅやちゅみ)$",
]
SERIES_PREFIXES = [r"^迷你(.+)$", r"^みに(.+)$", r"(?i)^mini\s+(.+)$"]
SERIES_MARKS = r"[\s♪☆!！+、,.，。:：;；~〜-]+$"


def series_groups(rows: DataFrame, row_id: str, title: str, names: Column, *, shortest: int = 4) -> DataFrame:
    """The series that a title belongs to: its key, title, where it came from and how sure that is.

    The first of ``names`` (the title among them) that begins as small editions do names the series, if
    that has ``shortest`` letters and is not the title itself; else the title without its variant endings.
    Rows without a title have none.
    """
    tidy = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), SERIES_MARKS, ""))
    base = lambda x: series_base(tidy(x), SERIES_SUFFIXES)

    def without_prefix(x: Column) -> Column:
        cut = lambda plain: F.array(*[tidy(F.regexp_extract(plain, p, 1)) for p in SERIES_PREFIXES])
        inner = bound(tidy(x), lambda plain: F.get(F.filter(cut(plain), lambda c: F.char_length(c) >= shortest), F.lit(0)))
        return bound(inner, lambda found: F.when(found.isNotNull(), base(found)))

    own = F.trim(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"\s+", " "))
    alias = lambda own: F.get(F.filter(F.transform(names, without_prefix), lambda x: x.isNotNull() & (x != "") & (x != own)), F.lit(0))
    series = lambda own: bound(alias(own), lambda alias: F.struct(own.alias("own"), alias.alias("alias"), F.coalesce(alias, base(own)).alias("series")))
    # Made by a generator, so that neither the filter nor the columns below work it out again.
    out = rows.select(F.col(row_id), F.explode(F.array(bound(own, series))).alias("s")).select(row_id, "s.*").where("series <> ''")
    source = F.when(F.col("alias").isNotNull(), "alias_heuristic").otherwise("title_heuristic")
    return out.select(row_id, keys.slug(F.col("series"), "work-group").alias("key"), "series", source.alias("source"), F.when(F.col("series") != F.col("own"), "title_variant").otherwise("title_base").alias("confidence"))
