"""Ordered classifications: each is a table of conditions of which the first decides, or all are listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(table: list[tuple[Column, object]], otherwise) -> Column:
    """The value beside the first condition that holds; a null condition does not hold."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda rest, row: F.when(F.coalesce(row[0], F.lit(False)), lit(row[1])).otherwise(rest), reversed(table), lit(otherwise))


def all_of(table: dict[str, Column]) -> Column:
    """Names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in table.items()]))


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


# Title shapes of volumes, parents, editions and advisories.
VOLUME = r"(?iu)(?:\bvol(?:ume)?\.?\s*\d+\b|volume\s*\d+|第\s*\d+\s*[卷巻册冊話话]|\d+\s*[卷巻册冊]|\s\d{1,3}\s|\s\d{1,3}$|上巻|下巻|前篇|後篇|后篇|番外|外伝|外传)"
PARENTS = (
    r"(?iu)^(.+?)\s*(?:vol(?:ume)?\.?|volume)\s*\d{1,3}\b.*$",
    r"(?iu)^(.+?)\s+\d{1,3}\s*(?:巻|卷|册|冊|話|话)\b.*$",
    r"(?iu)^(.+?)\s*第\s*\d{1,3}\s*(?:巻|卷|册|冊|話|话)\b.*$",
    r"(?u)^(.+?)\s+[\[(（【]?\d{1,3}[\])）】]?.*$",
    r"(?iu)^(.+?)\s*(?:上巻|下巻|前篇|後篇|后篇|番外|外伝|外传).*$",
)
EDITION = r"(?iu)(?:edition|revised|digital|ebook|paperback|hardcover|switch|ps4|ps5|steam|dlc|bundle|limited|remaster|remastered|完全版|新装版|電子|文庫|特装版|限定版|移植版)"
ADVISORIES = {
    "suggestive": r"contentrating=suggestive|\bsuggestive\b|擦边|暗示性",
    "erotica": r"contentrating=erotica|\berotica\b|情色|成人向",
    "pornographic": r"contentrating=pornographic|\bpornographic\b|色情|成人内容|18禁|r-?18",
    "doujinshi_or_extra": r"doujinshi|同人志|同人本|loose extra",
    "restricted": r"不宜展示|敏感内容|restricted|hidden|quarantine",
}
RISKS = {
    "title_contains_work_quote": 3, "creator_title_contains_context_role": 3, "title_contains_colon_work_person_pattern": 5, "title_unbalanced_brackets": 4,
    "title_too_long": 1, "creator_title_contains_scene_or_episode_marker": 3, "title_contains_source_artifact": 3, "missing_title_or_name": 5,
}
BRACKETS = (("《", "》"), ("『", "』"), ("「", "」"), ("【", "】"), ("(", ")"), ("（", "）"), ("[", "]"))


def parent_title(title: Column) -> Column:
    """The title before a volume mark, without trailing punctuation; empty if there is none."""
    found = []
    for p in PARENTS:
        parent = F.regexp_replace(F.regexp_extract(title, p, 1), r"(?u)[\s:：,，.。;；~〜ー—–_\-]+$", "")
        found.append(F.when((F.char_length(parent) >= 2) & (parent != title), parent))
    return F.coalesce(*found, F.lit(""))


def boundary(rows: DataFrame, title: str = "title", path: str = "raw_path", url: str = "source_url") -> DataFrame:
    """Adds ``boundary``, ``boundary_reason``, ``parent``, ``volume_like`` and ``edition_like``."""
    name = F.regexp_replace(_text(title), r"(?U)\s+", " ")
    volume = name.rlike(VOLUME)
    edition = name.rlike(EDITION) | F.lower(_text(path)).rlike("(?:steam|release|edition|package|appid)") | F.lower(_text(url)).contains("store.steampowered.com")
    parent = parent_title(name)
    kind = first_of([(volume, F.struct(F.lit("child_candidate").alias("k"), F.lit("volume_like_title").alias("r"))), (parent != "", F.struct(F.lit("child_candidate").alias("k"), F.lit("parent_title_inferred").alias("r"))), (edition, F.struct(F.lit("edition_or_release_candidate").alias("k"), F.lit("edition_or_release_like_source_row").alias("r")))], F.struct(F.lit("work_candidate").alias("k"), F.lit("stable_work_candidate").alias("r")))
    out = rows.withColumn("kind_of_row", kind)
    return out.select(*rows.columns, F.col("kind_of_row.k").alias("boundary"), F.col("kind_of_row.r").alias("boundary_reason"), F.when(F.col("kind_of_row.k") == "child_candidate", parent).otherwise("").alias("parent"), volume.alias("volume_like"), edition.alias("edition_like"))


def advisories(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``advisories`` by the words of a text, and ``visibility``: restricted, adult or ordinary."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = all_of({k: low.rlike(p) for k, p in ADVISORIES.items()})
    visibility = first_of([(F.array_contains("advisories", "restricted"), "restricted"), (F.size("advisories") > 0, "adult")], "ordinary")
    return rows.withColumn("advisories", found).withColumn("visibility", visibility)


def page_category(rows: DataFrame, *, system_spaces: tuple[str, ...], system_pages: tuple[str, ...], spam_words: tuple[str, ...], home: str) -> DataFrame:
    """Adds ``category`` and ``reasons`` of wiki pages.

    Reads web, name, author, content, hidden and attachments.
    """
    content, web, name = F.coalesce("content", F.lit("")), _text("web"), _text("name")
    low = F.lower(content)
    length, urls, han = F.char_length(content), F.regexp_count(content, F.lit(r"https?://\S+")), F.regexp_count(content, F.lit(r"\p{IsHan}"))
    spam = F.filter(F.array(*[F.lit(w) for w in sorted(spam_words)]), lambda w: F.contains(low, w))
    system_space = web.isin(*system_spaces) | F.substring_index(web, ".", 1).isin(*system_spaces)
    system_name = name.isin(*system_pages) | name.rlike("(?:Class|Sheet|Template)$")
    stranger = F.lower(_text("author")).rlike("anonymous|guest|spam|bot")
    hidden, files = F.coalesce("hidden", F.lit(False)), F.coalesce("attachments", F.lit(0))
    junk = ((F.size(spam) > 0) & ((urls >= 2) | (han == 0))) | ((urls >= 10) & (length < 3000)) | (stranger & (length < 300) & (files == 0))
    profile = (web == home) & ~name.isin(*system_pages) & (length < 800)
    category = first_of([(junk, "candidate_spam_or_junk"), (system_space | system_name | hidden | profile, "candidate_system_page"), ((length >= 800) | (han >= 120) | (files > 0), "candidate_user_content")], "needs_review")
    listed = all_of({"system_space": system_space, "system_page_name": system_name, "hidden": hidden, "long_content": length >= 500, "has_chinese_content": han >= 80, "has_attachment": files > 0, "many_urls": urls >= 5, "suspicious_author": stranger})
    words = F.when(F.size(spam) > 0, F.array(F.concat(F.lit("spam_keywords:"), F.array_join(F.slice(spam, 1, 8), "|")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("category", category).withColumn("reasons", F.concat(listed, words))


def queue(rows: DataFrame) -> DataFrame:
    """Adds ``queue`` and ``actionable`` of catalog rows.

    Reads work_id, site_id, manual (protected by people), ai_marker, complete (assessment),
    identity (review asked for), protected and readiness.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ready = _text("readiness")
    table = [
        (_text("work_id") == "", "invalid_record"),
        (yes("manual"), "protected_or_manual_review"),
        (_text("site_id") == "", "invalid_record"),
        (yes("ai_marker") & yes("complete"), "already_ai_assessed"),
        ((ready == "needs_identity_or_series_review") | yes("identity"), "identity_review"),
        (yes("protected"), "protected_or_manual_review"),
        (ready == "needs_external_research", "external_research"),
        (ready == "ready_for_ai_assessment_with_warnings", "ready_for_ai_assessment"),
    ]
    out = rows.withColumn("queue", first_of(table, "unclassified"))
    return out.withColumn("actionable", F.col("queue").isin("identity_review", "external_research", "ready_for_ai_assessment"))


def name_risk(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``risks`` of an entity's name, their weight ``score`` and ``severity``."""
    text = _text(name)
    count = lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    quoted = text.rlike("[《『「][^》』」]{2,}[》』」]")
    unbalanced = reduce(lambda a, b: a | b, [count(o) != count(c) for o, c in BRACKETS])
    risks = all_of({
        "missing_title_or_name": text == "",
        "title_contains_work_quote": quoted,
        "title_contains_colon_work_person_pattern": text.rlike("[：:]") & quoted,
        "creator_title_contains_scene_or_episode_marker": text.rlike(r"(?iu)(?:scene|chapter|episode|vol\.?|#\d+|第\d+|u\d+|season|s\d+)"),
        "creator_title_contains_context_role": text.rlike("(原案|角色原画|角色原案|キャラクター原案|キャラ原案|作画|漫画|脚本|構成|監督|監修|運営|制作|製作|製作委員会|著|著者|作者|原作)"),
        "title_contains_source_artifact": text.rlike(r"(?i)(object Object|\[object Object\])"),
        "title_unbalanced_brackets": unbalanced,
        "title_too_long": F.char_length(text) >= 24,
    })
    weights = F.create_map(*[x for k, v in RISKS.items() for x in (F.lit(k), F.lit(v))])
    out = rows.withColumn("risks", risks).withColumn("score", F.aggregate("risks", F.lit(0), lambda a, r: a + weights[r]))
    return out.withColumn("severity", first_of([(F.col("score") >= 8, "high"), (F.col("score") >= 4, "medium")], "low"))


def honest_evidence(status: Column, traceable: Column) -> Column:
    """Evidence status held to the number of sources that can be traced."""
    s = F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("unknown"))
    return first_of([((s == "multiple_secondary_supported") & (traceable == 1), "single_secondary_supported"), (s.isin("multiple_secondary_supported", "single_secondary_supported") & (traceable == 0), "insufficient_evidence")], s)


def publication_gap(published: Column, draft: Column, *, match: tuple[str, ...], missing: tuple[str, ...], absent: tuple[str, ...], other: str) -> Column:
    """How the published and the draft view of a work stand to each other."""
    m, n, a = (lambda c, s=s: F.coalesce(c.isin(*s), F.lit(False)) for s in (match, missing, absent))
    return first_of([
        (m(published), "published_matches"),
        (m(draft) & n(published), "draft_only_match"),
        (m(draft) & (published == other), "draft_matches_published_other"),
        (draft == other, "draft_has_other"),
        (a(published) | a(draft), "work_or_plan_missing"),
        (n(published) & n(draft), "missing_from_both"),
    ], "needs_review")


def band(percent: Column) -> Column:
    return first_of([(percent.isNull(), "none"), (percent >= 90, "very_high"), (percent >= 75, "high"), (percent >= 50, "medium")], "low")


def tags(explicit: Column, classes: Column, implied: dict[str, list[str]]) -> Column:
    """Explicit tags and those that the classes imply, first wins."""
    table = F.create_map(*[x for k, v in implied.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(explicit, none), F.flatten(F.transform(F.coalesce(classes, none), lambda c: F.coalesce(table[c], none))))
