"""Audits and links of a catalog: histories, duplicate groups, provenance, references, overlays."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import spread, unused


def _filled(value: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit(""))


def latest_candidate(history: DataFrame, group: str, order: list[Column], valid: Column, complete: Column) -> DataFrame:
    """The latest structurally valid row of each group, else the latest of any, with its status.

    Rows are compared by ``order``, null first; ``candidate`` is the whole row.
    """
    (done,) = unused(history, "done")
    row = F.struct(*[F.col(c) for c in history.columns], F.coalesce(complete, F.lit(False)).alias(done))
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = history.groupBy(group).agg(F.max_by(row, F.when(valid, key)).alias("sound"), F.max_by(row, key).alias("any"))
    status = F.when(F.col("sound").isNull(), "latest_available_invalid").when(F.col("sound")[done], "latest_structurally_valid_complete").otherwise("latest_structurally_valid_incomplete")
    return best.select(group, status.alias("status"), F.coalesce("sound", "any").dropFields(done).alias("candidate"))


def index_actions(items: DataFrame, docs: DataFrame, slug: str, visible: str) -> DataFrame:
    """Which items of a search index to keep: those with a document that is not hidden.

    ``docs`` has one row for each slug; an empty or null slug leads nowhere.
    """
    known = docs.where(_filled(F.col(slug).cast("string")).isNotNull()).select(F.col(slug).alias("doc_slug"), F.col(visible).alias("doc_visible"), F.lit(True).alias("found"))
    keep = F.coalesce("found", F.lit(False)) & F.coalesce("doc_visible", F.lit(True))
    return items.join(known, F.col(slug) == F.col("doc_slug"), "left").select(*[F.col(c) for c in items.columns], F.coalesce("found", F.lit(False)).alias("doc_found"), "doc_visible", F.when(keep, "keep").otherwise("omit_from_search_index").alias("action"))


def duplicate_groups(works: DataFrame, row_id: str, high: list[str]) -> DataFrame:
    """Groups of works that share a key of one of five kinds, with confidence and the one to keep.

    Reads media_group, media_type, primary (title key), titles (keys), source_keys (provider:id) and
    score; ids are whole numbers.  Of the groups of one kind with the same members only the most
    confident stays, then the one that appears first.  Members are compared by count and two
    exclusive-or sums of hashes, so that no group is collected.
    """
    none = F.array().cast("array<string>")
    media = F.concat_ws("|", *[F.coalesce(_filled(F.col(c)), F.lit("unknown")) for c in ("media_group", "media_type")])
    primary = F.filter(F.array("primary"), lambda k: F.coalesce(k != "", F.lit(False)))
    titles = F.array_distinct(F.filter(F.coalesce("titles", none), lambda k: F.char_length(k) >= 2))
    sources = F.array_distinct(F.filter(F.coalesce("source_keys", none), lambda k: F.coalesce(k != "", F.lit(False))))

    def claims(kind: str, keys: Column, *, by_media: bool = False) -> Column:
        return F.transform(keys, lambda k, i: F.struct(F.lit(kind).alias("kind"), (F.concat(media, F.lit("|"), k) if by_media else k).alias("key"), i.alias("at")))

    kinds = [claims("source_key", sources), claims("primary_title_media", primary, by_media=True), claims("alias_title_media", titles, by_media=True), claims("primary_title_only", primary), claims("alias_title_only", titles)]
    # A work makes eleven claims or more, so few works make a task.
    each = spread(works, row_id).select(F.col(row_id).alias("id"), F.coalesce("score", F.lit(0)).alias("score"), F.explode(F.concat(*kinds)).alias("c")).select("id", "score", "c.*")
    groups = each.groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.max_by("id", F.struct("score", (-F.col("id")).alias("least"))).alias("keep"), F.min(F.struct("id", "at")).alias("place"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    ).where("n > 1")
    rank = (
        F.when(F.col("kind") == "source_key", F.when(F.substring_index("key", ":", 1).isin(high), 0).otherwise(3))
        .when(F.col("kind").endswith("_media"), 1)
        .otherwise(F.when(F.char_length("key") >= 6, 2).otherwise(3))
    )
    first = groups.withColumn("rank", rank).groupBy("kind", "n", "x", "y").agg(F.min_by(F.struct("key", "keep", "rank"), F.struct("rank", "place")).alias("g"))
    confidence = F.element_at(F.array(*[F.lit(c) for c in ("high", "medium", "low", "review")]), F.col("g.rank") + 1)
    return first.select("kind", F.col("g.key").alias("key"), confidence.alias("confidence"), "n", F.col("g.keep").alias("keep"))


def provenance_audit(sources: Column, declared: Column, evidence: Column) -> Column:
    """Struct of traceable (distinct addresses), unlinked, blockers, warnings and status.

    ``sources`` are structs with url and kind.  A claim of several (one) secondary sources needs two
    (one) addresses that can be followed.
    """
    rows = F.coalesce(sources, F.array())
    address = lambda s: F.regexp_replace(F.coalesce(_filled(s["url"]), F.lit("")), "/+$", "")
    traceable = F.size(F.filter(F.array_distinct(F.transform(rows, address)), lambda u: u != "")).cast("long")
    unlinked = F.size(F.filter(rows, lambda s: (F.trim(s["kind"]) == "secondary_web") & (address(s) == ""))).cast("long")
    state = F.coalesce(_filled(evidence), F.lit("unknown"))
    told = F.greatest(F.coalesce(declared.cast("long"), F.lit(0)), F.lit(0))
    listed = lambda *rules: F.filter(F.array(*[F.when(c, why) for c, why in rules]), lambda x: x.isNotNull())
    blockers = listed(((state == "multiple_secondary_supported") & (traceable < 2), "fewer_than_two_traceable"), ((state == "single_secondary_supported") & (traceable < 1), "no_traceable"))
    warnings = listed((told != traceable, "declared_count_differs"), (unlinked > 0, "unlinked_secondary"))
    status = F.when(F.size(blockers) > 0, "blocked").when(F.size(warnings) > 0, "warning").otherwise("ok")
    return F.struct(traceable.alias("traceable"), unlinked.alias("unlinked"), blockers.alias("blockers"), warnings.alias("warnings"), status.alias("status"))


def research_problems(texts: list[str], least: dict[str, int], findings: str, required: list[str]) -> Column:
    """Why a research record is incomplete: empty texts, arrays below their minimum, missing findings (a map)."""
    rules = [(_filled(F.col(c)).isNull(), F.lit(f"text:{c}")) for c in texts]
    rules += [(F.col(c).isNull() | (F.size(c) < n), F.concat(F.lit(f"array:{c}:"), F.coalesce(F.size(c), F.lit(0)).cast("string"), F.lit(f"/{n}"))) for c, n in least.items()]
    rules += [(F.col(findings).isNull(), F.lit(f"map:{findings}"))]
    rules += [(F.col(findings).isNotNull() & _filled(F.try_element_at(F.col(findings), F.lit(k))).isNull(), F.lit(f"finding:{k}")) for k in required]
    return F.filter(F.array(*[F.when(c, why) for c, why in rules]), lambda x: x.isNotNull())


def reference_links(refs: DataFrame, entries: DataFrame, ref: str, entry: str) -> DataFrame:
    """Each reference with its entry: by its first key that any entry has, else by name.

    Both sides have keys (array, in order of trust) and name, normalised.  A key of several entries
    is ambiguous; a name of several leads to the only one of them that has keys.
    """
    has_keys = F.coalesce(F.size("keys"), F.lit(0)) > 0
    by_key = entries.select(F.col(entry).alias("e"), F.explode(F.array_distinct("keys")).alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n"), F.min("e").alias("e"))
    by_name = entries.where("name <> ''").groupBy(F.col("name").alias("entry_name")).agg(F.count("*").alias("named"), F.min(entry).alias("e1"), F.sum(has_keys.cast("long")).alias("with_keys"), F.min(F.when(has_keys, F.col(entry))).alias("e2"))
    refs = refs.select(ref, "keys", "name")
    hits = refs.select(ref, F.posexplode("keys").alias("at", "k")).join(by_key, "k").groupBy(ref).agg(F.min(F.struct("at", "n", "e")).alias("hit"))
    out = refs.join(hits, ref, "left").join(by_name, F.col("name") == F.col("entry_name"), "left")
    n = F.col("hit.n")
    how = F.when(n == 1, "key").when(n > 1, "ambiguous_key").when(F.col("named") == 1, "name").when(F.col("with_keys") == 1, "name_with_keys").when(F.col("named") > 1, "ambiguous_name").otherwise("missing")
    return out.select(ref, how.alias("matched_by"), F.when(how == "key", F.col("hit.e")).when(how == "name", F.col("e1")).when(how == "name_with_keys", F.col("e2")).alias(entry))


def creator_problems(creators: DataFrame, creator: str, next_id: int) -> DataFrame:
    """Broken rules of a creator registry: keys with two owners, ids not below the next, two ids of one provider.

    Reads keys (array) and identities (array of structs with provider and value).
    """
    keys = creators.select(F.col(creator).alias("id"), F.explode("keys").alias("k")).where("k is not null")
    shared = keys.join(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k").select("id", F.lit("shared_key").alias("problem"), F.col("k").alias("what")).distinct()
    late = creators.where(F.col(creator) >= next_id).select(F.col(creator).alias("id"), F.lit("id_not_below_next").alias("problem"), F.lit(str(next_id)).alias("what"))
    each = creators.select(F.col(creator).alias("id"), F.explode("identities").alias("i"))
    several = each.groupBy("id", F.col("i.provider").alias("what")).agg(F.count_distinct("i.value").alias("n")).where("n > 1")
    return shared.unionByName(late).unionByName(several.select("id", F.lit("conflicting_provider_ids").alias("problem"), "what")).withColumnRenamed("id", creator)


def metadata_overlay(records: DataFrame, members: DataFrame, key: str, member: str, ordinal: str) -> DataFrame:
    """Descriptive fields of merged records after their identity is settled.

    Both sides have ``key``, aliases, format, first_published, summary and summary_kind; records have
    title.  The record's own member comes first, then input order.  The format is the first member's
    that has one, else the record's; the date is the record's first; a source summary of any member
    goes before the record's own, any other after it.  Aliases are unique without regard to case and
    never the title.
    """
    fields = ("format", "first_published", "summary")
    place = F.struct((F.col(member) != F.col(key)).alias("other"), F.col(ordinal).alias("ordinal"))
    first = lambda c, if_: F.min_by(c, F.when(_filled(F.col(c)).isNotNull() & if_, place))
    always = F.lit(True)
    found = members.groupBy(key).agg(*[first(c, always).alias(f"m_{c}") for c in fields], first("summary", F.col("summary_kind") == "source_summary").alias("m_source"))
    normal = lambda c: F.lower(F.trim(c))
    columns = lambda level, at: (F.lit(level).alias("level"), at.cast("long").alias("place"), F.posexplode("aliases").alias("at", "alias"))
    own = records.select(key, *columns(0, F.lit(0)))
    theirs = members.select(key, *columns(1, F.col(ordinal)), (F.col(member) == F.col(key)).alias("self"))
    theirs = theirs.withColumn("level", F.when(F.col("self"), 1).otherwise(2)).drop("self")
    listed = own.unionByName(theirs).where("trim(alias) <> ''").groupBy(key, normal(F.col("alias")).alias("plain")).agg(F.min(F.struct("level", "place", "at", "alias")).alias("a"))
    aliases = listed.groupBy(key).agg(F.array_sort(F.collect_list("a")).alias("found"))
    out = records.join(found, key, "left").join(aliases, key, "left")
    others = F.filter(F.transform(F.col("found"), lambda a: a["alias"]), lambda a: F.coalesce(normal(a) != normal(F.col("title")), F.lit(True)))
    return out.select(
        key, "title", F.coalesce(others, F.array().cast("array<string>")).alias("aliases"), F.coalesce("m_format", _filled(F.col("format"))).alias("format"),
        F.coalesce(_filled(F.col("first_published")), "m_first_published").alias("first_published"), F.coalesce("m_source", _filled(F.col("summary")), "m_summary").alias("summary"),
    )


def workflow_artifact(raw_path: Column, title: Column, source_id: Column, url: Column, path: str) -> Column:
    """Whether a record is a left-over of the workflow: read from ``path``, with no identity of its own."""
    return (F.coalesce(_filled(raw_path), F.lit("")) == path) & F.coalesce(_filled(title), _filled(source_id), _filled(url)).isNull()


def plain_text(html: Column) -> Column:
    """Text of a fragment of HTML: scripts and styles go, blocks end lines, references are decoded."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in (
        (r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"(?i)<br\s*/?\s*>", "\n"),
        (r"(?i)</(?:p|div|li|h[1-6]|section|article|tr|dt|dd)>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;|&#160;", " "),
        ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
    ):
        text = F.regexp_replace(text, pattern, by)
    pieces = F.transform(F.split(text, "(?=&#)"), _decoded)
    lines = F.regexp_replace(F.regexp_replace(F.array_join(pieces, ""), r"[ \t]+", " "), r" ?\n[ \n\t\r]*", "\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def _decoded(piece: Column) -> Column:
    """A piece of text with the numeric reference that it may begin with decoded; one that names no character stays."""
    pattern = r"(?i)^&#(?:x([0-9a-f]{1,6})|([0-9]{1,7}));"
    code = F.coalesce(F.conv(F.nullif(F.regexp_extract(piece, pattern, 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(piece, pattern, 2), F.lit(""))).cast("int")
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.concat(character, F.regexp_replace(piece, pattern, ""))).otherwise(piece)


def rich_text(document: Column) -> Column:
    """Texts of a rich-text tree (JSON) as lines; what is not JSON gives the empty text."""

    def lines(value) -> str:
        if isinstance(value, str):
            return value
        if isinstance(value, dict) and isinstance(value.get("text"), str):
            return value["text"]
        parts = value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) else []
        return "\n".join(filter(None, map(lines, parts)))

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return lines(json.loads(text or "null"))
            except (ValueError, RecursionError):
                return ""

        return texts.map(one)

    return read(document)


def review_order(priority: Column, priorities: list[str], source: Column, issue: Column, title: Column, other_title: Column) -> list[Column]:
    """Sort keys of a review queue: priority (unknown last), source, issue, then the title or its stand-in."""
    place = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.coalesce(priority, F.lit("")))
    return [F.when(place == 0, len(priorities) + 1).otherwise(place.cast("int")), source, issue, F.coalesce(_filled(title), other_title)]


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for a table's contents in any order: rows, and two sums of row hashes."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(whole, F.lit(i)).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 2)]
    return rows.agg(F.count("*").alias("rows"), *sums)


def same_contents(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Whether two tables hold the same rows as often, by their fingerprints, as after an exact rollback."""
    sides = fingerprint(before, columns).withColumn("side", F.lit(0)).unionByName(fingerprint(after, columns).withColumn("side", F.lit(1)))
    return sides.agg(F.max_by("rows", F.lit(1) - F.col("side")).alias("rows_before"), F.max_by("rows", "side").alias("rows_after"), (F.count_distinct("rows", "s1", "s2") == 1).alias("same"))
