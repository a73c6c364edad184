"""Repairs and audits of a catalog: parents, seed attachments, reuse of assessments, ratings, lineage, credits, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as keys
from tessera.functions import values
from tessera.operators import rules


def _said(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def retarget_parents(rows: DataFrame) -> DataFrame:
    """Takes back inferred parents that are only a number or shorter than two characters.

    Reads parent, volume_like, boundary, boundary_reason, action, reason, confidence and matched (an
    array), and rewrites them where the parent is rejected: a volume that was linked to it becomes a
    child entity that needs a policy, a child candidate known by its parent alone a work for review,
    any other row keeps its action.  Adds ``rejected_parent``, ``rejected_reason`` and ``changed_action``.
    """
    parent = F.regexp_replace(_said("parent"), r"(?U)\s+", " ")
    number = parent.rlike(r"(?U)^\d+$")
    noisy = (parent != "") & (number | (F.char_length(keys.key("ingest_title", parent)) == 1))
    volume = F.coalesce(F.col("volume_like"), F.lit(False))
    linked = volume & (_said("action") == "link_to_parent_work_candidate")
    child = ~volume & (F.col("boundary") == "child_candidate") & (F.col("boundary_reason") == "parent_title_inferred")
    none = F.array().cast(rows.schema["matched"].dataType)
    rejected = "parent_title_inference_rejected"
    new = {
        "parent": F.lit(""),
        "boundary": F.when(child, "work_candidate").otherwise(F.col("boundary")),
        "boundary_reason": F.when(volume, "volume_like_title_without_useful_parent").otherwise(rejected),
        "action": F.when(linked, "create_child_entity_needs_policy").when(child, "create_new_work_needs_review").otherwise(F.col("action")),
        "reason": F.when(linked, "rejected_noisy_parent_candidate_from_parent_link").when(volume, "volume_like_row_no_useful_parent_candidate").otherwise(rejected + "_noisy_parent"),
        "confidence": F.lit("low"),
        "matched": F.when(linked | child, none).otherwise(F.col("matched")),
    }
    marked = rows.withColumn("noisy_parent", noisy)
    out = {c: F.when(F.col("noisy_parent"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns}
    return marked.select(
        *out.values(),
        F.when(noisy, F.col("parent")).alias("rejected_parent"),
        F.when(noisy, F.when(number, "numeric_parent_candidate").otherwise("too_short_parent_candidate")).alias("rejected_reason"),
        (noisy & ~new["action"].eqNullSafe(F.col("action"))).alias("changed_action"),
    )


def _asked(rows: DataFrame, row_id: str, weak: str) -> DataFrame:
    """(id, kind, at, key) of titles and keys; kinds are title, strong and weak."""
    each = F.concat(
        F.transform(F.coalesce("titles", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("title").alias("kind"), i.alias("at"), x.alias("key"))),
        F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda x, i: F.struct(F.when(F.lower(x).rlike(weak), "weak").otherwise("strong").alias("kind"), i.alias("at"), x.alias("key"))),
    )
    return rows.select(row_id, F.explode(each).alias("x")).select(row_id, "x.*").where("key <> ''")


def attach_seeds(seeds: DataFrame, groups: DataFrame, seed: str, group: str, weak: str = r"^row-\d+$") -> DataFrame:
    """The group that each seed belongs to: by its titles if they name one group, else by strong keys.

    Both sides have ``titles`` (normalised) and ``keys``, arrays that may be null.  Keys like ``weak``
    never attach.  Titles that name several groups end the search.  Returns seed, group (null if
    none), ``method``, ``matched_by`` (the seed's first title or key that hits) and ``reason``.
    A key's groups are reduced to the least and greatest before the join, so common keys cost nothing.
    """
    owners = _asked(groups, group, weak).groupBy("kind", "key").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    hits = _asked(seeds, seed, weak).join(owners, ["kind", "key"])
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    facts = hits.groupBy(seed).agg(*[f.alias(f"{kind}_{name}") for kind in ("title", "strong", "weak") for name, f in (("lo", F.min(of(kind, "lo"))), ("hi", F.max(of(kind, "hi"))), ("key", F.min_by("key", of(kind, "at"))))])
    one = lambda kind: F.col(f"{kind}_lo") == F.col(f"{kind}_hi")
    any_of = lambda kind: F.col(f"{kind}_lo").isNotNull()
    answer = lambda to, method, by, reason: F.struct(to.alias("to"), F.lit(method).alias("method"), by.alias("by"), F.lit(reason).alias("reason"))
    none, no = F.lit(None).cast(groups.schema[group].dataType), F.lit(None).cast("string")
    picked = (
        F.when(one("title"), answer(F.col("title_lo"), "exact_title", F.concat(F.lit("title:"), F.col("title_key")), "unique exact title"))
        .when(any_of("title"), answer(none, "none", no, "ambiguous exact titles"))
        .when(one("strong"), answer(F.col("strong_lo"), "strong_key", F.concat(F.lit("key:"), F.col("strong_key")), "unique strong key, no exact title"))
        .when(any_of("strong"), answer(none, "none", no, "ambiguous strong keys, no exact title"))
        .when(any_of("weak"), answer(none, "none", no, "weak key only, no exact title"))
        .otherwise(answer(none, "none", no, "no exact title or key"))
    )
    out = seeds.select(seed).join(facts, seed, "left").withColumn("picked", picked)
    return out.select(seed, F.col("picked.to").alias(group), "picked.method", F.col("picked.by").alias("matched_by"), "picked.reason")


def seed_reviews(seeds: DataFrame, groups: DataFrame, decisions: DataFrame, seed: str, group: str, weak: str = r"^row-\d+$") -> DataFrame:
    """Hits that people should see: key hits beside a title's group, and all hits of the tier that left a seed undecided."""
    tier = F.when(F.col("reason").startswith("ambiguous exact"), "title").when(F.col("reason").startswith("ambiguous strong"), "strong").when(F.col("reason").startswith("weak"), "weak")
    wanted = decisions.select(seed, F.col(group).alias("selected"), "method", tier.alias("tier")).where("method = 'exact_title' or tier is not null")
    hits = _asked(seeds, seed, weak).join(wanted, seed).where("kind = tier or (method = 'exact_title' and kind <> 'title')")
    owners = _asked(groups, group, weak).select("kind", "key", group).distinct()
    return hits.join(owners, ["kind", "key"]).where(F.col("selected").isNull() | (F.col("selected") != F.col(group))).select(seed, "kind", "key", "at", F.col(group).alias("other"))


# States that are no evidence, marks of a doubtful identity, the worth of files by name.
WEAK_EVIDENCE = ("", "unknown", "insufficient_evidence", "conflicting_evidence")
DOUBTFUL = r"(?i)(identity[_ -]?review|identity[_ -]?conflict|duplicate|wrong[_ -]?summary|series[_ -]?identity[_ -]?conflict)"
FILE_WORTH = (("^v0\\.6-resolutions", 500), ("^v0\\.5-resolutions", 450), ("resolved", 400))
OTHER_FILE = 300


def reusable_evidence(rows: DataFrame) -> DataFrame:
    """Whether an older assessment may serve again: ``refusal`` (null if so) and its ``score``.

    Reads work_id, site_id, marks (array of review notes), coverage (a share or a percentage),
    evidence_status, summary, grade, rule_codes, source_urls (arrays) and file.
    """
    coverage = F.when(F.col("coverage").isNotNull(), values.confidence(F.col("coverage")))
    codes = F.size(F.filter(F.coalesce("rule_codes", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    urls = F.size(F.array_distinct(F.filter(F.coalesce("source_urls", F.array().cast("array<string>")), lambda x: F.trim(x) != "")))
    refusal = (
        F.when((_said("work_id") == "") | (_said("site_id") == ""), "identity_missing")
        .when(F.array_join(F.coalesce("marks", F.array().cast("array<string>")), " ").rlike(DOUBTFUL), "identity_blocked")
        .when(coverage.isNull() | (coverage < 0.35), "coverage_too_low")
        .when(_said("evidence_status").isin(*WEAK_EVIDENCE), "evidence_too_weak")
        .when(_said("summary") == "", "source_summary_missing")
        .when((_said("grade") == "") & (codes == 0), "assessment_signal_missing")
    )
    worth = F.coalesce(*[F.when(F.col("file").rlike(p), F.lit(n)) for p, n in FILE_WORTH], F.lit(OTHER_FILE))
    score = worth + F.floor(coverage * 100 + 0.5) + F.when(_said("grade") != "", 20).otherwise(0) + urls
    return rows.withColumn("refusal", refusal).withColumn("score", F.when(F.col("refusal").isNull(), score.cast("long")))


def best_reusable(rows: DataFrame, row_id: str) -> DataFrame:
    """Of each work's reusable assessments the one of the highest score, then the least id."""
    kept = reusable_evidence(rows).where("refusal is null")
    return kept.groupBy("work_id").agg(F.max("score").alias("score"), F.min_by(row_id, F.struct(-F.col("score"), F.col(row_id))).alias(row_id), F.count("*").alias("n"))


def rating_audit(rows: DataFrame) -> DataFrame:
    """One row of counts over the conclusions of ``rows`` (see ``rules.conclusions``).

    ``rows`` also has ``rule`` (the rule that decided), ``classes`` (array) and ``has_tag`` (whether the
    tag for pending conclusions is there).  Counts are sums of conditions, so partial sums are all
    that is shuffled.
    """
    best, likely, worst, core = (rules.grade(F.col(c)) for c in ("best", "likely", "worst", "core"))
    given = [_said(c) != "" for c in ("best", "likely", "worst")]
    legal = F.coalesce((rules.rank(best) <= rules.rank(likely)) & (rules.rank(likely) <= rules.rank(worst)), F.lit(False))
    fixed = legal & (best == worst)
    unclear = F.exists(F.concat(F.array("rule"), F.coalesce("classes", F.array().cast("array<string>"))), lambda x: F.coalesce(F.upper(F.trim(x)) == "D-UNCLEAR", F.lit(False)))
    untagged = (F.size("pending") > 0) & ~F.coalesce(F.col("has_tag"), F.lit(False))
    counts = {
        **{f"mode_{m}": F.col("conclusion_mode") == m for m in ("fixed_grade", "bounded_range", "labels_only", "unscanned", "blocked")},
        "fixed_ranges": fixed,
        "bounded_ranges": legal & ~fixed,
        "malformed_ranges": (given[0] | given[1] | given[2]) & ~legal,
        "rows_with_missing_fields": ~(given[0] & given[1] & given[2]),
        "core_likely_mismatch": (core != "") & (likely != "") & (core != likely),
        "unclear_bounded_ranges": legal & ~fixed & unclear,
        "pending_tag_missing": untagged,
        "findings": (F.size("issues") > 0) | untagged,
    }
    return rules.conclusions(rows).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


#: What the statistics read of a lineage document; the rest of it is not parsed.
LINEAGE = "identities struct<bindings:array<struct<bindingId:string,externalIdentity:struct<providerIdentityKey:string>>>,observation:struct<state:string>>, legacy string, research struct<observation:struct<state:string>>, assessment struct<attempts:array<string>>, candidate struct<records:array<string>>, published struct<entries:array<string>>, human struct<judgments:array<string>>, effectiveState struct<ai:struct<selection:struct<failClosed:boolean>>>"


def lineage_stats(works: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row of counts over a lineage store.

    ``works`` has work_id, document (JSON) and audit_run_ref, ``provenance`` object_ref and
    object_kind.  Bindings are counted in all and by distinct binding and provider key.
    """
    parsed = works.select("audit_run_ref", F.from_json("document", LINEAGE).alias("d"))
    some = lambda path: F.coalesce(F.size(path) > 0, F.lit(False))
    state = F.col("d.research.observation.state")
    totals = parsed.agg(
        F.count("*").alias("formal_rows"),
        F.count_if(F.col("d.identities.observation.state") == "partial").alias("partial_identity_rows"),
        F.count_if(F.col("d.legacy").isNotNull()).alias("legacy_rows"),
        F.count_if(state != "not_observed").alias("research_rows"),
        *[F.count_if(some(f"d.{p}")).alias(f"{n}_rows") for n, p in (("assessment", "assessment.attempts"), ("candidate", "candidate.records"), ("published", "published.entries"), ("human", "human.judgments"))],
        F.count_if(~F.coalesce("d.effectiveState.ai.selection.failClosed", F.lit(False))).alias("open_selection_rows"),
    )
    bindings = parsed.select(F.explode("d.identities.bindings").alias("b")).agg(
        F.count("*").alias("binding_rows"), F.count_distinct("b.bindingId").alias("unique_binding_ids"), F.count_distinct("b.externalIdentity.providerIdentityKey").alias("unique_provider_keys")
    )
    objects = provenance.agg(F.count("*").alias("provenance_objects"), F.count_if(F.col("object_kind") == "observation").alias("provenance_observations"))
    known = provenance.select(F.col("object_ref").alias("audit_run_ref")).distinct()
    broken = parsed.join(known, "audit_run_ref", "left_anti").agg(F.count("*").alias("broken_audit_refs"))
    out = totals
    for one_row in (bindings, objects, broken):
        out = out.join(F.broadcast(one_row))
    return out


# The roles of people and of organisations, and the infobox keys that name them.
CREATOR_KEYS = {
    "original_creator": "原作 原作者 作者 著者 作家",
    "original_concept": "原案 故事原案 企画原案",
    "story": "故事 剧情 劇情 ストーリー",
    "art": "作画 作畫 漫画 漫畫",
    "illustration": "插画 插畫 插图 插圖 イラスト",
    "director": "監督 监督 导演",
    "chief_director": "総監督 总监督 總監督",
    "series_director": "シリーズディレクター 系列监督 系列監督",
    "series_composition": "シリーズ構成 系列构成 系列構成",
    "script": "脚本 剧本 劇本 シナリオ",
    "planning": "企画 企劃",
    "character_original_design": "キャラクター原案 角色原案 人物原案",
    "character_design": "キャラクターデザイン 角色设计 角色設計 人物设定 人物設定 人设 人設 原画 原畫",
    "producer": "プロデューサー 制作人 製作人",
}
ORGANIZATION_KEYS = {
    "committee": "製作 製作委員会 製作委員會 制作委员会 制作委員会",
    "developer": "开发 開發 开发商 開發商 デベロッパー Developer 品牌 ブランド",
    "animation_studio": "アニメーション制作 动画制作 動畫制作 制作",
    "production_company": "制作公司 製作会社 制作会社",
    "publisher": "出版社 出版 出版者",
    "magazine": "连载杂志 連載誌 掲載誌 杂志 雑誌 刊载杂志 掲載",
    "imprint": "文库 文庫 レーベル Label label",
    "distributor": "发行 发行商 發行 發行商 配給 配给 販売 販売元 发售 發售",
    "platform": "平台 游戏平台 遊戲平台 対応機種 対応平台",
    "streaming_platform": "网络播放 網絡播放 网络配信 配信 配信平台",
    "broadcaster": "放送局 电视台 電視台 放送 播放电视台",
    "music_label": "音楽制作 音乐制作 音樂制作",
}


def infobox_credits(entries: DataFrame, subject: str) -> DataFrame:
    """Typed credits of infobox entries: ``kind`` (creator or organization), ``role``, ``name``, ``original_role``.

    ``entries`` has the subject, ``at`` (place in its infobox), ``key`` and ``value``.  Values name
    several people between slashes, commas and semicolons; a committee with members in brackets gives
    both, the members with ``member_of``.  Of names that differ in case only the first stays for each
    role and key.
    """
    roles = {k: (kind, role) for kind, table in (("creator", CREATOR_KEYS), ("organization", ORGANIZATION_KEYS)) for role, names in table.items() for k in names.split()}
    as_map = F.create_map(*[x for k, (kind, role) in roles.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role")))])
    names = lambda text: F.filter(F.transform(F.split(text, r"(?U)\s*[/、;；,，]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    value = F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"(?U)\s+", " "))
    known = entries.select(subject, "at", F.col("key").alias("original_role"), value.alias("value"), as_map[F.col("key")].alias("as")).where("as is not null and value <> ''")
    head, inside = F.trim(F.regexp_extract("value", "^(.+?)[（(](.+)[）)]$", 1)), F.regexp_extract("value", "^(.+?)[（(](.+)[）)]$", 2)
    whole = (F.col("as.role") == "committee") & (inside != "")
    credit = lambda name, role, of: F.struct(name.alias("name"), role.alias("role"), of.alias("member_of"))
    nobody = F.lit(None).cast("string")
    each = F.when(whole, F.concat(F.array(credit(head, F.lit("committee"), nobody)), F.transform(names(inside), lambda x: credit(x, F.lit("committee_member"), head)))).otherwise(F.transform(names(F.col("value")), lambda x: credit(x, F.col("as.role"), nobody)))
    rows = known.select(subject, "at", "original_role", F.col("as.kind").alias("kind"), F.posexplode(each).alias("nth", "c")).where("c.name <> ''")
    first = rows.groupBy(subject, "kind", F.col("c.role").alias("role"), "original_role", F.lower("c.name").alias("folded")).agg(F.min(F.struct("at", "nth", "c.name", "c.member_of")).alias("c"))
    return first.select(subject, "kind", "role", "c.name", "original_role", "c.member_of")


def index_header(items: DataFrame, collection: str, visibility: str, works: str = "works") -> DataFrame:
    """The head of a search index in one row: items in all, in each collection, and works by visibility (``ordinary`` if null).

    The items themselves stay a table beside it, written as lines by ``writers.write_jsonl``: as one
    document they would have to pass one task.
    """
    shown = F.when(F.col(collection) == works, F.coalesce(visibility, F.lit("ordinary")))
    counted = items.groupBy(F.col(collection).alias("c"), shown.alias("v")).agg(F.count("*").alias("n"))
    to_map = lambda of: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(of).alias("k"), "n"))))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    by_collection = counted.where("c is not null").groupBy("c").agg(F.sum("n").alias("n")).agg(to_map("c").alias("counts"))
    by_visibility = counted.where("v is not null").select("v", "n").agg(to_map("v").alias("visibility_counts"))
    return total.join(F.broadcast(by_collection)).join(F.broadcast(by_visibility))  # one row each
