"""Text keys for matching, one function for each normalisation.

They differ on purpose: what a key drops decides what it can match, so no two are merged.  All are
column functions.  NFKC has no built-in function; ``nfkc`` sends to Python only the texts that hold a
character that it may change, and ``key(..., compose=False)`` leaves it out where input is known to be
composed already.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode and scripts on the web mean it; Java's own class misses wide spaces.
SPACE = r"[\s\p{Z}\x{FEFF}]"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _strip_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.category(c).startswith("M")))


@cache
def _changeable() -> str:
    """Pattern of the characters that NFKC may change: those it maps, marks, and second parts of composed ones.

    A text without any of them is composed already.  Ranges are nested by halves, since a class of
    hundreds of ranges tries one after the other on every character of every text.
    """
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals, composed by rule
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c:
            found.add(i)
        if len(parts := unicodedata.decomposition(c).split()) == 2 and parts[0][0] != "<":
            found.add(int(parts[1], 16))
    found = sorted(i for i in found if i >= 0x80)
    starts = [i for n, i in enumerate(found) if not n or found[n - 1] != i - 1]
    ends = [i for n, i in enumerate(found) if n + 1 == len(found) or found[n + 1] != i + 1]

    def one_of(ranges: list[tuple[int, int]]) -> str:
        whole = rf"\x{{{ranges[0][0]:X}}}-\x{{{ranges[-1][1]:X}}}"
        half = len(ranges) // 2
        return f"[{whole}&&{one_of(ranges[:half])}{one_of(ranges[half:])}]" if half else f"[{whole}]"

    return one_of(list(zip(starts, ends, strict=True)))


def nfkc(text: Column) -> Column:
    return F.coalesce(_compose(F.when(text.rlike(_changeable()), text)), text)


def blank_to_null(text: Column) -> Column:
    """Null for text that is empty after trimming: absent and blank mean the same here."""
    trimmed = F.regexp_replace(text.cast("string"), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed != "", trimmed)


# The characters that each key drops.
MATCH_SYMBOLS = "!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~，。！？、；：“”‘’《》〈〉【】（）［］「」『』・…·"
MATCH_EDITIONS = r"(?iu)[\[\(（【［「『].*?(第[一二三四五六七八九十0-9]+季|season\s*\d+|ova|ona|movie|剧场版|劇場版|特别篇|特別篇|special|edition|version).*?[\]\)）】］」』]"
INGEST_BRACKETS = "「」『』【】\\[\\]（）()〈〉《》"
INGEST_MARKS = ",:;，。！？!?.·・~〜ー—–_\\-"
MERGE_SYMBOLS = "『』「」《》〈〉【】\\[\\]()（）{}｛｝!！?？:：;；,，.。・･·'’`｀\"“”~〜～_＿\\-ー—–"
DUP_SYMBOLS = "\\-‐‑‒–—―~〜～・:：;；,，.。!！?？'\"“”‘’「」『』【】\\[\\]（）()<>＜＞"
PAYLOAD_SYMBOLS = "\\-‐‑‒–—―~〜～・:：;；,，.。!！?？'\"“”‘’「」『』【】\\[\\]（）()"
VOLUME_ENDINGS = (r"\s*[（(]\s*\d+\s*[）)]\s*$", r"\s+第?\s*\d+\s*[巻卷册集]?\s*$", r"\s*第\s*\d+\s*[巻卷册集]\s*$")

#: Each key: patterns removed in order from the lower-case composed text (pairs replace).
STEPS: dict[str, list] = {
    "merge_title": [rf"[\p{{P}}\p{{S}}\s\p{{Z}}\x{{FEFF}}]+"],
    "identity_title": [f"{SPACE}+"],
    "descriptive": [(f"{SPACE}+", " ")],
    "match_title": [MATCH_EDITIONS, rf"[\s\p{{Z}}{MATCH_SYMBOLS}]"],
    "ingest_title": [(f"{SPACE}+", " "), f"[{INGEST_BRACKETS}]", (f"[{INGEST_MARKS}]+", " "), (f"{SPACE}+", " ")],
    "merge_plan_title": [f"{SPACE}+", f"[{MERGE_SYMBOLS}]+"],
    "duplicate_title": [f"{SPACE}+", f"[{DUP_SYMBOLS}]"],
    "summary": [r"[\s\p{Z}\x{FEFF}\p{P}\p{S}]+"],
    "identity_part": [r"[\p{Cc}]+", (f"{SPACE}+", " ")],
    "alnum_title": [r"[^\p{L}\p{N}]+"],
    "volume_title": [*VOLUME_ENDINGS, r"[\s\p{Z}\x{FEFF}\p{P}\p{S}]+"],
    "payload_title": [f"{SPACE}+", f"[{PAYLOAD_SYMBOLS}]"],
}
TRIMMED = frozenset(("descriptive", "ingest_title", "identity_part", "match_title"))


def key(name: str, text: Column, *, compose: bool = True) -> Column:
    """The key ``name`` of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    if name == "ingest_title":  # lower case comes before composition in this one
        out = F.lower(text)
        out = nfkc(out) if compose else out
    else:
        out = F.lower(nfkc(text) if compose else text)
    for step in STEPS[name]:
        pattern, new = step if isinstance(step, tuple) else (step, "")
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out) if name in TRIMMED else out


def slug(text: Column, fallback: str = "item") -> Column:
    """Lower-case letters and digits of any script, all else as single dashes."""
    plain = F.lower(_strip_marks(nfkc(F.trim(F.coalesce(text, F.lit(""))))))
    dashed = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", fallback).otherwise(dashed)


def url_key(url: Column) -> Column:
    """Host without www and path without a last slash; query and fragment do not count."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), r"^www\.", "")
    return F.concat(F.regexp_replace(host, r":\d+$", ""), F.regexp_replace(F.regexp_extract(bare, "^[^/]*(/.*)?$", 1), "/+$", ""))


def media_bucket(kind: Column) -> Column:
    """Media kinds that may stand for one work."""
    return F.when(kind.isin("game", "visual_novel"), "game").when(kind.isNull() | kind.isin("other", "unknown"), "unknown").otherwise(kind)


def exact_identity(state: Column, provider: Column, site_id: Column) -> Column:
    """provider|site id where the identity is exact and both are there, else null."""
    both = (state == "exact") & blank_to_null(provider).isNotNull() & blank_to_null(site_id).isNotNull()
    return F.when(both, F.concat_ws("|", F.lower(F.trim(provider)), F.trim(site_id)))


def split_list(text: Column) -> Column:
    """Items of a text that separates them by semicolon, bar, comma or line; blanks go."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[;|,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")


def latin_tokens(text: Column, least: int = 6) -> Column:
    """Distinct lower-case runs of Latin letters of ``least`` characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


# Words too common to tell titles apart, and tokens too common to tell families apart.
STOP_WORDS = """about after again anime another before black blue chronicles episode first flower game girl girls heart hero light little
love manga novel official online project red season second special story sweet white world yuri""".split()
COMMON_TOKENS = "学園 学校 高校 少女 女子 漫画 作品 登場 大人気 待望 生活 毎日 青春 恋愛 主人公 物語 内容 発売 収録 コミック ドラマ".split()


def title_words(text: Column, least: int = 6) -> Column:
    """Distinct lower-case words of a Latin letter and further letters or digits, without stop words."""
    words = F.regexp_extract_all(F.lower(nfkc(F.coalesce(text, F.lit("")))), F.lit(rf"[a-z][a-z0-9]{{{least - 1},}}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def lexical_tokens(text: Column) -> Column:
    """Distinct Han runs of 2 to 8 (longer ones in pieces of 8) and, of those over 4, their grams of 2 to 4;
    katakana runs and lower-case Latin words of 3 or more; without common tokens."""
    text = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    runs = found(r"[\u3400-\u9fff]{2,8}")

    def grams(run: Column) -> Column:
        def sized(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.char_length(run) - n + 1), lambda s: F.substring(run, s, F.lit(n)))

        return F.when(F.char_length(run) > 4, F.concat(sized(2), sized(3), sized(4))).otherwise(F.array().cast("array<string>"))

    latin = F.transform(found("[A-Za-z]{3,}"), lambda x: F.lower(x))
    every = F.concat(runs, F.flatten(F.transform(runs, grams)), found(r"[\u30a0-\u30ff]{3,}"), latin)
    return F.array_except(every, F.array(*[F.lit(w) for w in COMMON_TOKENS]))


def han_grams(text: Column, least: int = 2, most: int = 4) -> Column:
    """All runs of ``least`` to ``most`` neighbouring Han characters."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{IsHan}{2,}"), F.lit(0))

    def grams(run: Column) -> Column:
        def sized(n: Column) -> Column:
            starts = F.when(F.char_length(run) >= n, F.sequence(F.lit(1), F.char_length(run) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda s: F.substring(run, s, n))

        return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), sized))

    return F.array_distinct(F.flatten(F.transform(runs, grams)))


def year_of(text: Column) -> Column:
    """First four digits that no digit touches, from 1800 to 2199."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<!\d)((?:18|19|20|21)\d{2})(?!\d)", 1)
    return F.when(found != "", found.cast("int"))


def first_year(text: Column) -> Column:
    """First four digits in a row, whatever they are."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4})", 1)
    return F.when(found != "", found.cast("int"))


def title_similarity(left: Column, right: Column, jaccard: Column | None = None) -> Column:
    """1 if equal; length ratio if one of four or more characters lies in the other; else Jaccard of characters, where that is not given."""
    short, long_ = F.when(F.char_length(left) <= F.char_length(right), left).otherwise(right), F.when(F.char_length(left) > F.char_length(right), left).otherwise(right)
    if jaccard is None:
        chars = [F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")) for x in (left, right)]
        jaccard = F.size(F.array_intersect(*chars)) / F.size(F.array_union(*chars))
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when(F.contains(long_, short) & (F.char_length(short) >= 4), F.char_length(short) / F.char_length(long_))
        .otherwise(jaccard)
    )


def natural_key(text: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


# Labels before a credited name, words of a publication note, letters of badly decoded text.
CREDIT_LABELS = """音乐制作协力 音樂製作協力 音楽制作協力 音楽製作協力 音乐协力 音樂協力 音楽協力 音乐制作 音樂製作 音楽制作 音楽製作 协力 協力 製作协力 製作協力
制作协力 制作協力 原案协力 原案協力 故事原案 漫画 漫畫 漫画版 漫畫版 原著 动画人物设定 動畫人物設定 動画人物設定 人物设定 人物設定 角色设计 角色設計 キャラクターデザイン キャラクター原案""".split()
PUBLICATION_WORDS = "刊 連載 连载 掲載 コミック COMIC まんが 漫画 月刊 芳文社 KADOKAWA 一迅社 SBクリエイティブ マッグガーデン".split()
BADLY_DECODED = "ÃÂãäåæçèéêëìíîïðñòóôõöøùúûüýþ�"


def credit_name(text: Column) -> Column:
    """A credited name without labels, notes in brackets, titles and footnotes; empty if nothing else is there."""
    name = F.trim(F.coalesce(text, F.lit("")))
    for label in CREDIT_LABELS:
        name = F.regexp_replace(name, rf"(?U)^{label}[:：]\s*", "")
    for pattern, by in (
        (rf"(?iuU)[（(][^（）()]*(?:{'|'.join(PUBLICATION_WORDS)})[^（）()]*[）)]?", ""),
        (r"(?U)[（(]\s*[0-9]+(?:\s*-\s*[0-9]+)?\s*[）)]?$", ""),
        (r"(?U)^(.+?)\s*[（(][^（）()]+[）)]$", "$1"),
        (r"(?U)^(.+?)\s*[［\[][^\[\]［］]+[］\]]$", "$1"),
        (r"(?U)\s*[（(][^（）()]+$", ""),
        ("^(.+?)[「『《][^」』》]+[」』》]$", "$1"),
        ("^[（(]+|[）)]+$", ""),
        (r"(?U)\s+", " "),
    ):
        name = F.regexp_replace(name, pattern, by)
    name = F.trim(name)
    note = name.rlike(r"(?U)^[0-9]+(?:\s*-\s*[0-9]+)?[）)]?$") | name.rlike(r"(?U)^[\p{L}ー・\s]+刊[）)]?$")
    return F.when(note, "").otherwise(name)


def badly_decoded(text: Column) -> Column:
    """Whether text looks decoded in a wrong charset: three such letters or more, and over 8 % of all."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    bad = F.char_length(plain) - F.char_length(F.translate(plain, BADLY_DECODED, ""))
    return (bad >= 3) & (bad > 0.08 * F.char_length(plain))
