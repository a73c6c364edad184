"""What a public catalog shows: merged ratings, display order, visibility, priorities, parts of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import join_facts


def _place(value: Column, order: list[str], missing: int) -> Column:
    """Position of a value in a list; ``missing`` for any other and for null."""
    found = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(value.isNull() | (found == 0), missing).otherwise(found.cast("int") - 1)


def merged_rating(records: DataFrame, registry: DataFrame, group: str, *, grades: list[str], terminal: list[str]) -> DataFrame:
    """One rating for each group of merged records.

    ``records`` has ``group``, ordinal, state, grade, classes, reason, evidence, richness and
    research; ``registry`` has one row for each class with its grade.  The worst grade (last in
    ``grades``) of the rated records wins; without one, the state that comes first in ``terminal``.
    Of the records that have it the richest is selected, the earliest among equals.  Classes are
    those of records with the selected grade, in order of appearance, if the registry gives them that
    grade.  The reason is the longest of those records, and the evidence is that of the same record;
    without a reason it is the selected record's, or the first there is.
    """
    grade, reason = F.col("grade"), F.nullif(F.trim("reason"), F.lit(""))
    rated = (F.col("state") == "rated") & grade.isNotNull()
    rows = records.withColumn("bad", F.when(rated, _place(grade, grades, -1))).withColumn("rank", _place(F.col("state"), terminal, 99))
    facts = rows.groupBy(group).agg(F.max("bad").alias("worst"), F.min("rank").alias("first_rank"), F.max(F.coalesce("research", F.lit(False))).alias("needs_research"))
    chosen = join_facts(rows, facts.where(F.col(group).isNotNull()), group)
    candidate = F.when(F.col("worst").isNotNull(), F.coalesce(F.col("bad") == F.col("worst"), F.lit(False))).otherwise(F.col("rank") == F.col("first_rank"))
    wanted = F.when(F.col("worst") >= 0, F.element_at(F.array(*[F.lit(g) for g in grades]), F.col("worst") + 1))
    chosen = chosen.withColumn("selected_grade", wanted).withColumn("same", F.when(F.col("selected_grade").isNotNull(), F.coalesce(grade == F.col("selected_grade"), F.lit(False))).otherwise(candidate))
    earliest = -F.col("ordinal")
    best = chosen.groupBy(group).agg(
        F.first("selected_grade").alias("grade"),
        F.first("needs_research").alias("needs_research"),
        F.max_by(F.struct("ordinal", "state", "evidence"), F.when(candidate, F.struct(F.coalesce("richness", F.lit(0)), earliest))).alias("s"),
        F.max_by(F.struct(reason.alias("reason"), "evidence"), F.when(F.col("same") & reason.isNotNull(), F.struct(F.char_length(reason), earliest))).alias("r"),
        F.min_by("evidence", F.when(F.col("same") & F.col("evidence").isNotNull(), F.col("ordinal"))).alias("any_evidence"),
    )
    each = chosen.where("same").select(group, "selected_grade", "ordinal", F.posexplode("classes").alias("at", "class"))
    kept = each.join(registry.select(F.col("class"), F.col("grade").alias("class_grade")), "class").where("selected_grade is null or class_grade = selected_grade")
    listed = kept.groupBy(group, "class").agg(F.min(F.struct("ordinal", "at")).alias("place")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "class"))), lambda x: x["class"]).alias("classes"))
    evidence = F.when(F.col("r.reason").isNotNull(), F.col("r.evidence")).otherwise(F.coalesce("s.evidence", "any_evidence"))
    return best.join(listed, group, "left").select(group, F.col("s.ordinal").alias("selected"), F.col("s.state").alias("state"), "grade", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.col("r.reason").alias("reason"), evidence.alias("evidence"), "needs_research")


def display_order(state: Column, grade: Column, ordinal: Column, states: list[str], grades: list[str]) -> list[Column]:
    """Sort keys of a public list: state, grade, then input order; unknown values last."""
    return [_place(state, states, 99), _place(grade, grades, 99), F.coalesce(ordinal, F.lit(0))]


def exportable(collection: Column, status: Column, catalog_status: Column, publication: Column, public: Column, drafts: bool = False) -> Column:
    """Whether an index may show a document: confirmed public evidence, published works that are not archived, published others."""
    text = lambda c, default: F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))
    works = (text(catalog_status, "active") != "archived") & (F.lit(drafts) | (text(publication, "draft") == "published"))
    others = text(status, "") != "archived" if drafts else text(status, "") == "published"
    evidence = F.coalesce((status == "confirmed") & public, F.lit(False))
    return F.when(collection == "evidence", evidence).when(collection == "works", works).otherwise(others)


def by_source_priority(claims: DataFrame, keys: list[str], source: str, value: str, order: list[str]) -> DataFrame:
    """One value for each key, that of the source that comes first; later ones that differ stay as ``conflicts``.

    Sources outside ``order`` come last; ties go to the lesser source name, then value.
    """
    some = claims.where(F.nullif(F.trim(F.col(value)), F.lit("")).isNotNull()).select(*keys, F.struct(_place(F.col(source), order, 998).alias("rank"), F.col(source).alias("source"), F.trim(F.col(value)).alias("value")).alias("c")).distinct()
    first = Window.partitionBy(*keys).orderBy("c")
    ranked = some.withColumn("best", F.first("c").over(first))
    differing = F.when(F.col("c.value") != F.col("best.value"), F.concat_ws("=", "c.source", "c.value"))
    return ranked.groupBy(*keys).agg(F.first("best.source").alias("source"), F.first("best.value").alias("value"), F.array_sort(F.collect_set(differing)).alias("conflicts"))


def counted_attachments(documents: DataFrame, attachments: DataFrame, key: str, size: str) -> DataFrame:
    """Documents with the number and size of their attachments, zero where there are none."""
    sums = attachments.groupBy(key).agg(F.count("*").alias("attachments"), F.sum(size).alias("bytes"))
    return join_facts(documents, sums, key, "left").fillna(0, ["attachments", "bytes"])


def urls(text: Column) -> Column:
    """All http and https addresses in a text, or in a nested value written as JSON."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)https?://[^\s\"'<>]+"), F.lit(0))


def site_id(url: Column, host: str, path: str) -> Column:
    """The id that an address of a site carries: ``path`` is a pattern with one group, from the root on."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), rf"(?i)^https?://(?:www\.)?{host}/{path}", 1)
    return F.when(found != "", found)


def series_title(title: Column) -> tuple[Column, Column]:
    """A title's series and volume number: a last number in brackets, after a space, or with a volume mark."""
    whole = F.trim(F.coalesce(title, F.lit("")))
    # The shapes of volume numbers, tried in order.
    patterns = [r"\s*[（(]\s*(\d+)\s*[）)]\s*$", r"\s+第?\s*(\d+)\s*[巻卷册集]?\s*$", r"\s*第\s*(\d+)\s*[巻卷册集]\s*$"]
    series, volume = whole, F.lit("")
    for p in reversed(patterns):
        hit = whole.rlike(p)
        series = F.when(hit, F.trim(F.regexp_replace(whole, p, ""))).otherwise(series)
        volume = F.when(hit, F.regexp_extract(whole, p, 1)).otherwise(volume)
    return F.when(series == "", whole).otherwise(series), volume


def committee(credits: DataFrame, entry: str, split: str = "[、,，/／;；]") -> DataFrame:
    """Rows ``name``, ``role`` and ``member_of`` of committee credits: "name (a, b)" is the committee and its members."""
    text = F.trim(F.coalesce(F.col(entry), F.lit("")))
    shape = r"^(.+?)[（(](.+)[）)]$"
    whole, inside = F.trim(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)
    person = lambda x, role, of: F.struct(F.trim(x).alias("name"), F.lit(role).alias("role"), of.alias("member_of"))
    members = F.transform(F.split(inside, split), lambda x: person(x, "committee_member", whole))
    plain = F.transform(F.split(text, split), lambda x: person(x, "committee", F.lit(None).cast("string")))
    rows = F.when(text.rlike(shape), F.concat(F.array(person(whole, "committee", F.lit(None).cast("string"))), members)).otherwise(plain)
    return credits.withColumn("row", F.explode(F.filter(rows, lambda x: x["name"] != ""))).select(*credits.columns, "row.*")
