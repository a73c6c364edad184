"""Fields of source records, picked by each source's own names.

A record's JSON is parsed once, into a VARIANT; every name is a lookup in that.  A name with dots is a
key of that name or else a path, as sources hold both.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import unused

# Names under which sources hold a text, a title, an id, an address, other titles, a date, makers.
TEXT_KEYS = "userPreferred romaji english native original name_cn name title_cn title label value text".split()
TITLES = {
    "bangumi": "name_cn name title title_cn title_jp originalTitle subject.name_cn subject.name subject.title".split(),
    "anilist": "title.userPreferred title.romaji title.english title.native title_userPreferred title_romaji title_english title_native romaji english native name media.title.userPreferred media.title.romaji media.title.english media.title.native".split(),
    "vndb": "title vn.title vntitle vn_title vndbTitle vndb_title original alttitle alt_title name label".split(),
}
ANY_TITLE = "sourceTitle source_title displayTitle display_title canonicalTitle canonical_title label".split()
IDS = {
    "bangumi": "bangumiId bangumi_id bgmId bgm_id subject_id subjectId subjectID subject.id id".split(),
    "anilist": "anilistId anilist_id mediaId media_id media.id id".split(),
    "vndb": "vndbId vndb_id vnid vn_id vn.id id vid vndb".split(),
}
ANY_ID = "sourceId source_id externalId external_id".split()
URLS = "sourceUrl source_url url siteUrl site_url link href vndbUrl vndb_url bangumiUrl bangumi_url anilistUrl anilist_url mediaUrl media_url".split()
ALIASES = "aliases alias synonyms names alternativeTitles alternative_titles altTitles alt_titles altname".split()
MORE_ALIASES = {
    "bangumi": "name name_cn title title_cn subject.name subject.name_cn".split(),
    "anilist": "title_romaji title_english title_native title.romaji title.english title.native romaji english native".split(),
    "vndb": "original alttitle alt_title".split(),
}
START_DATES = "startDate start_date startDateFuzzy start_date_fuzzy".split()
DATES = "releaseDate release_date released date startDate start_date airDate air_date publishedAt published_at year".split()
MAKERS = "creators creator authors author artists artist staff studios studio developers developer publishers publisher brand".split()
SITE_IDS = {"vndb": r"(?i)vndb\.org/(v\d+)", "anilist": r"(?i)anilist\.co/(?:anime|manga)/(\d+)", "bangumi": r"(?i)(?:bgm\.tv|bangumi\.tv|chii\.in)/subject/(\d+)"}


def _at(record: Column, name: str, kind: str = "variant") -> Column:
    """The value under a name: of a key that is spelled so, or at the path."""
    quoted = F.try_variant_get(record, f"$['{name}']", kind)
    return F.coalesce(quoted, F.try_variant_get(record, "$." + name, kind)) if "." in name else quoted


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _some(text: Column) -> Column:
    """A text with its white space evened out; null where nothing is left."""
    return F.nullif(_spaced(text), F.lit(""))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def pick(record: Column, names: Iterable[str]) -> Column:
    """The text of the first name that holds one, or something in a list or object (as JSON)."""
    held = F.array_compact(F.array(*[_at(record, n, "string") for n in names]))
    return F.get(F.filter(F.transform(held, _spaced), lambda x: ~x.isin("", "[]", "{}")), F.lit(0))


def texts(value: Column) -> Column:
    """Texts of a value: a list's items, split texts, and of objects the known names, else all values.

    Lists and objects are looked into two levels deep, which is as deep as sources nest names.
    """
    own = lambda x: F.try_variant_get(x, "$", "string")
    kind = lambda x: F.substring(F.coalesce(F.schema_of_variant(x), F.lit("")), 1, 5)
    none = F.array().cast("array<string>")

    def of_object(x: Column) -> Column:
        known = F.array_compact(F.array(*[F.try_variant_get(x, f"$['{k}']", "string") for k in TEXT_KEYS]))
        every = F.map_values(F.coalesce(F.try_variant_get(x, "$", "map<string,string>"), F.create_map().cast("map<string,string>")))
        return F.when(F.size(known) > 0, known).otherwise(every)

    def item(x: Column) -> Column:
        return F.when(kind(x) == "OBJEC", of_object(x)).otherwise(F.array(own(x)))

    listed = lambda x: F.flatten(F.transform(F.try_variant_get(x, "$", "array<variant>"), item))
    split = lambda x: F.split(F.coalesce(own(x), F.lit("")), r"[;|,\n]")
    found = _let(value, lambda x: _let(kind(x), lambda k: F.when(k == "ARRAY", listed(x)).when(k == "OBJEC", of_object(x)).otherwise(split(x))))
    return F.filter(F.transform(F.coalesce(found, none), _spaced), lambda x: x != "")


def _by_source(source: Column, names: Mapping[str, list[str]], common: list[str], body) -> Column:
    """``body`` of the source's own names and the common ones."""
    out = body(common)
    for name, own in names.items():
        out = F.when(source == name, body([*own, *common])).otherwise(out)
    return out


def picked(records: DataFrame, document: str, source: str) -> DataFrame:
    """``records`` with title, source_id, source_url, aliases, release_date and creators of each JSON text.

    What is not JSON has none of them, and empty lists.  An id falls back on the record's addresses; dates
    of objects are as exact as these say.  Aliases and creators keep their first occurrence.
    """
    parsed, held, named, own = unused(records, "parsed_of", "title_object_of", "title", "source_id")
    v, s = F.col(parsed), F.lower(F.coalesce(F.col(source), F.lit("")))
    title_object = texts(_let(_at(v, "title"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), x)))
    title = F.coalesce(F.get(held, F.lit(0)), _by_source(s, TITLES, ANY_TITLE, lambda names: pick(v, names)))
    urls = F.regexp_extract_all(F.coalesce(F.col(document), F.lit("")), F.lit(r"(?i)(https?://[^\s\"'<>\\]+)"), F.lit(1))
    by_url = F.lit(None).cast("string")
    for name, pattern in SITE_IDS.items():
        by_url = F.when(s == name, F.get(F.filter(_extracted(urls, pattern), lambda x: x != ""), F.lit(0))).otherwise(by_url)
    own_id = F.coalesce(_by_source(s, IDS, ANY_ID, lambda names: pick(v, names)), by_url)
    # Each of these is read more than once below, so it is a column and not an expression.
    rows = records.withColumn(parsed, F.try_parse_json(document)).withColumn(held, title_object)
    rows = rows.withColumns({named: title, own: own_id})
    own_id = F.when((s == "vndb") & F.col(own).rlike(r"^(?i)v?\d+$"), F.concat(F.lit("v"), F.regexp_extract(own, r"\d+", 0))).otherwise(F.col(own))
    more = lambda names: F.filter(F.transform(F.array_compact(F.array(*[_at(v, n, "string") for n in names])), _spaced), lambda x: x != "")
    aliases = F.concat(texts(F.coalesce(*[_at(v, n) for n in ALIASES])), _by_source(s, MORE_ALIASES, [], lambda names: more(names) if names else F.array().cast("array<string>")))

    def exact(start: Column) -> Column:
        part = lambda k: _some(F.try_variant_get(start, f"$['{k}']", "string"))
        month, day = F.lpad(part("month"), 2, "0"), F.lpad(part("day"), 2, "0")
        dated = F.when(part("year").isNotNull(), F.concat_ws("-", part("year"), month, F.when(month.isNotNull(), day)))
        return F.when(F.schema_of_variant(start).startswith("OBJECT"), dated)

    dated = _let(F.coalesce(*[_at(v, n) for n in START_DATES]), exact)
    makers = F.flatten(F.transform(F.array_compact(F.array(*[_at(v, n) for n in MAKERS])), texts))
    every = F.filter(F.array_distinct(F.concat(F.col(held), aliases)), lambda x: x != F.coalesce(F.col(named), F.lit("")))
    return rows.select(
        *records.columns, F.col(named).alias("title"), own_id.alias("source_id"), pick(v, URLS).alias("source_url"), every.alias("aliases"),
        F.coalesce(dated, pick(v, DATES)).alias("release_date"), F.array_distinct(makers).alias("creators"),
    )


def _extracted(urls: Column, pattern: str) -> Column:
    return F.transform(urls, lambda u: F.regexp_extract(u, pattern, 1))
