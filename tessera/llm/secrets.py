"""Secrets, told from examples by how widely the corpus shares them.

Each text is searched for credential patterns once.  A candidate's value is hashed, and the hashes
of the whole corpus are counted by distinct repositories and distinct owners.  A value that many
owners hold is a copied example; one that few hold looks live.  Looser patterns become spans only
where that count says live.  Only candidates, never texts, are shuffled; counts are pre-aggregated
by (hash, owner, repository), so a value copied everywhere costs each task one row per repository.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import with_columns
from tessera.llm.spans import Span, counts, sha256, written
from tessera.operators.skew import join_facts
from tessera.session import cut_lineage, unused

KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of one or more, without the short ones
#: Looser shapes: other assignments and other providers' key prefixes.
LOOSE = (
    re.compile(r"""(?:pwd|passphrase|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.ASCII | re.IGNORECASE),
    re.compile(r"(?:gh[opsu]_|glpat-|xox[abp]-|[sr]k_live_|AIza)([A-Za-z0-9_-]{16,})"),
)
LOOSE_WORDS = ("pwd", "passphrase", "credential", "privatekey", "private_key", "accesskey", "access_key", "gho_", "ghp_", "ghs_", "ghu_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "k_live_", "aiza")
TO_X = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))

FOUND = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.binary())])


def candidates(text: str) -> tuple[list[Span], list[dict]]:
    """Plain spans of a text, and all candidates with the hash of their value."""
    coded = text.encode()
    lower = coded.lower()
    base: list[Span] = []
    out: list[dict] = []

    def add(m: re.Match, kind: int, group: int, is_base: bool) -> None:
        if is_base:
            base.append((m.start(), kind, m.end()))
        out.append({"start": m.start(), "kind": kind, "end": m.end(), "base": is_base, "value": hashlib.sha256(m[group].encode()).digest()})

    if any(w.encode() in lower for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= 12:
                add(m, 0, 1, True)
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            add(m, 1, 0, True)
    if b"x" * 16 in coded.translate(TO_X):
        for m in HEX.finditer(text):
            add(m, 2, 0, True)
    if any(w.encode() in lower for w in LOOSE_WORDS):
        for kind, pattern in enumerate(LOOSE):
            for m in pattern.finditer(text):
                if not any(a < m.end() and m.start() < b for a, k, b in base):
                    add(m, kind, 1, False)
    return base, out


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the numbers and digest of plain spans, and the array ``found`` of candidates."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for x in part.column("text_of").to_pylist():
            base, found = candidates(x or "")
            rows.append((*counts(base, 3), sha256(written(base, KINDS)), found))
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(FOUND)]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]

    item = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("value", T.BinaryType())])
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(item))]
    return with_columns(docs.select(*keep, F.col(text).alias("text_of")), "text_of", compute, fields)


def ownership(candidates_of: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each ``value`` of (value, owner, repository) rows."""
    held = candidates_of.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _written(spans: F.Column) -> F.Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judge(docs: DataFrame, ids: list[str], text: str, owner: str, repository: str, row: F.Column, example_owners: int = 3, example_repositories: int = 10) -> tuple[DataFrame, DataFrame]:
    """What ``find`` gives, with ``row`` as ``row_of``, and for each row with candidates its spans after the verdict."""
    keep = docs.select(*ids, row.alias("row_of"), F.col(owner).alias("owner_of"), F.col(repository).cast("string").alias("repository_of"), F.col(text).alias("text_of"))
    found = cut_lineage(find(keep, [*ids, "row_of", "owner_of", "repository_of"], "text_of"))
    each = found.where(F.size("found") > 0).select("row_of", F.col("owner_of").alias("owner"), F.col("repository_of").alias("repository"), F.explode("found").alias("s"))
    each = each.select("row_of", "owner", "repository", "s.base", "s.value", F.struct("s.start", "s.kind", "s.end").alias("span"))
    live = ~((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories))
    judged = join_facts(each, ownership(each).select("value", live.alias("is_live")), "value")
    by_row = judged.groupBy("row_of").agg(
        F.collect_set(F.when(F.col("base") | F.col("is_live"), F.col("span"))).alias("all_spans"),
        F.collect_set(F.when(F.col("is_live"), F.col("span"))).alias("live_spans"),
        F.count_if("is_live").alias("n_live"),
        F.count_if(~F.col("is_live")).alias("n_example"),
    )
    return found, by_row


def secrets(docs: DataFrame, ids: list[str], text: str = "text", *, owner: str = "source", repository: str = "doc_id", **options) -> DataFrame:
    """Secrets in every whole text, with the corpus's verdict.

    A value is an example where at least ``example_owners`` distinct owners or
    ``example_repositories`` distinct repositories hold it, else live.  A null owner or repository
    counts as one of its own.  Returns ``ids``; ``n_assign``, ``n_access``, ``n_hex`` and
    ``base_sha256`` of the plain spans; ``spans``, these and the live looser ones; ``live``, the
    written live spans; ``n_live`` and ``n_example``.  A null text counts as empty.  Repeated rows
    stay one for one and do not raise a count.  No column of ``ids`` may be named like one of the
    results or ``row_of``, ``owner_of``, ``repository_of``; other columns are not read.
    """
    found, by_row = judge(docs, ids, text, owner, repository, F.monotonically_increasing_id(), **options)
    none, zero = F.lit(""), F.lit(0).cast("long")
    return found.join(by_row, "row_of", "left").select(
        *ids, "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(_written(F.col("all_spans")), none).alias("spans"),
        F.coalesce(_written(F.col("live_spans")), none).alias("live"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
    )


def _redact(text: F.Column, spans: F.Column, mark: str) -> F.Column:
    """The text with each span, overlapping ones as one, replaced by ``mark``.

    What is kept is cut out piece by piece and joined once.
    """
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("done"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        piece = F.array(F.struct(acc["done"].alias("start"), s["start"].cast("int").alias("end")))
        kept = F.when(s["start"] >= acc["done"], F.concat(acc["kept"], piece)).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.greatest(acc["done"], s["end"].cast("int")).alias("done"))

    def finish(acc: F.Column) -> F.Column:
        return F.concat(acc["kept"], F.array(F.struct(acc["done"].alias("start"), F.length(text).alias("end"))))

    pieces = F.aggregate(F.array_sort(spans), start, step, finish)
    return F.array_join(F.transform(pieces, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])), mark)


ASSIGNED = "(?i)password|passwd|secret|token|api_?key|pwd|passphrase|credential|private_?key|access_?key"
PREFIXES = ("AKIA", "gho_", "ghp_", "ghs_", "ghu_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "k_live_", "AIza")


def may_hold(text: F.Column) -> F.Column:
    """True for each text in which ``candidates`` finds something, and for few others."""
    assigned = (text.contains("=") | text.contains(":")) & text.rlike(ASSIGNED)
    other = text.rlike("[0-9a-f]{16}")
    for x in PREFIXES:
        other = other | text.contains(x)
    return F.coalesce(assigned | other, F.lit(False))


def redacted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, owner: str = "source", length: str | None = "n_chars", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with live secrets replaced; examples and all other rows and columns stay.

    ``length``, if given, is set to the new number of characters where the text changes.  Rows that
    agree in id and text are judged together and all stay; null texts and an empty table stay as
    they are.  Columns may have any names.  Only texts that a secret's shape may be in are shuffled.
    """
    spans, key, row = unused(docs, "spans_of_doc", "key_of_doc", "row_of")
    own_key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))  # rows that agree in both have the same spans
    maybe = may_hold(F.col(text))
    judged = judge(docs, [], text, owner, id_col, own_key, **options)[1]
    judged = judged.where("n_live > 0").select(F.col("row_of").alias(row), F.col("live_spans").alias(spans))
    joined = docs.where(maybe).withColumn(key, own_key).join(judged, F.col(key) == F.col(row), "left")
    hit = F.col(spans).isNotNull()
    joined = joined.withColumn(text, F.when(hit, _redact(F.col(text), F.col(spans), mark)).otherwise(F.col(text)))
    if length:  # in a step of its own, over the finished text
        joined = joined.withColumn(length, F.when(hit, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return docs.where(~maybe).unionByName(joined.select(*docs.columns))
