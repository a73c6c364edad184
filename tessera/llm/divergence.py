"""How far the sources of each language lie apart, audited over all terms.

1. *Count.*  Each task counts terms by language and source and sends sums; a term in at least
   ``least_docs`` documents of its language is kept, with its counts by source as a sparse vector.
2. *Deduplicate count columns.*  Terms of a language with the same vector are one row with their
   number.  A pair of sources is evaluated once for each such row in which both have counts, times
   that number.  Where a source has no count its share is the same for all terms, so the rest comes
   from each source's histogram of counts: ``V * f(0, 0)``, plus what each count alone adds.
3. *Rank.*  Pairs by their sums, original terms by their own values, the first ``most_terms``.

All arithmetic is on integers.  A row holds at most one entry for each source of a language; the
result itself has one for each pair of these.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import raw, slices
from tessera.operators.skew import join_facts
from tessera.session import stored

#: Distinct (language, source, term) that a task holds before it sends their sums.
HELD_TERMS = 1 << 19
#: Groups up to this many are broadcast, counted before; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: What a share of 1 is written as.
WHOLE = 1_000_000_000
#: A-Z to a-z, other ASCII bytes than letters to spaces; bytes from 128 on belong to terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches):
    """(lang, source, term, times, documents) sums of a task's rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (times, within) in held.items():
            terms = list(times)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(list(times.values()), pa.int64()), pa.array([within[x] for x in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            for start in range(0, len(terms), 1 << 16):
                yield whole.slice(start, 1 << 16)
        held.clear()

    for batch in batches:
        for part in slices(batch, "text_of"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), raw(part.column("text_of")), strict=True):
                terms = text.translate(TERM_BYTES).split()
                if terms:
                    times, within = held.setdefault((lang, source), (Counter(), Counter()))
                    times.update(terms)
                    within.update(set(terms))
            if sum(len(x) for x, _ in held.values()) > HELD_TERMS:
                yield from rows()
    yield from rows()


def _share(count: str, total: str, kinds: str) -> str:
    """1 + floor(WHOLE * (count + 1) / (total + kinds)); decimals where 64 bits would not do."""
    wide = f"CAST((CAST({count} + 1 AS DECIMAL(20,0)) * {WHOLE}) DIV CAST({total} + {kinds} AS DECIMAL(20,0)) AS BIGINT)"
    return f"(1 + CASE WHEN {count} < 9000000000 THEN ({WHOLE}L * ({count} + 1)) DIV ({total} + {kinds}) ELSE {wide} END)"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV ({q}))"


def kept_terms(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3) -> DataFrame:
    """Terms in at least ``least_docs`` documents of their language, with their counts by source.

    Returns ``lang``, ``term``, ``total`` and ``counts`` (array of source and n, by source).
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text_of"))
    sums = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    # Both aggregations are served by the one exchange by language and term.
    single = sums.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = single.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "total", "counts")


def divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """Divergence of each source from the others of its language, and the terms that set it apart.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  Returns ``lang``,
    ``source``, ``part``, ``item``, ``value`` and ``rank``: ``pair`` rows name every other source of
    the language, ``term`` rows the terms more frequent there than in the language as a whole.

    Null texts, languages and sources are the empty string.  A group without terms still stands in
    pairs; a language without kept terms has pairs of value 0.  A lone source has no pairs.  Each row
    counts as a document, repeated ones too; ties rank by the item's UTF-8 bytes; an empty table
    gives no rows.  Columns beyond the three are not read, so that names cannot clash.
    """
    terms = stored(kept_terms(docs, lang=lang, source=source, text=text, least_docs=least_docs))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entries = terms.select("lang", "term", "total", F.explode("counts").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    by_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("whole"))
    groups = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kinds", "whole")]))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS

    def with_group(rows: DataFrame, own: str, size: str, *more: str) -> DataFrame:
        """Adds the size of the group of ``lang`` and column ``own``, and ``more`` of its language."""
        facts = groups.select("lang", F.col("source").alias(own), F.col("size").alias(size), *more)
        if few:
            return rows.join(F.broadcast(facts), ["lang", own])
        key = F.struct("lang", own)
        return join_facts(rows.withColumn("key", key), facts.select(key.alias("key"), size, *more), "key").drop("key")

    # Every pair of a language, and what it is worth per term without counts on either side.
    p, q = groups.select("lang", "kinds", F.col("source").alias("s"), F.col("size").alias("size_s")), groups.select("lang", F.col("source").alias("t"), F.col("size").alias("size_t"))
    pairs = p.join(q, "lang").where("s <> t")
    none_s, none_t = _share("0L", "size_s", "kinds"), _share("0L", "size_t", "kinds")
    some_s, some_t = _share("n_s", "size_s", "kinds"), _share("n_t", "size_t", "kinds")
    value = lambda sql: F.expr(f"CAST({sql} AS DECIMAL(38,0))").alias("value")
    neither = pairs.select("lang", "s", "t", value(f"CASE WHEN kinds = 0 THEN 0 ELSE kinds * {_apart(none_s, none_t)} END"))

    histogram = stored(entries.groupBy("lang", "source", "n").agg(F.count("*").alias("m")))
    in_s, in_t = (histogram.select("lang", F.col("source").alias(x), F.col("n").alias(f"n_{x}"), "m") for x in "st")
    only_s = in_s.join(pairs, ["lang", "s"]).select("lang", "s", "t", value(f"m * ({_apart(some_s, none_t)} - {_apart(none_s, none_t)})"))
    only_t = in_t.join(pairs, ["lang", "t"]).select("lang", "s", "t", value(f"m * ({_apart(none_s, some_t)} - {_apart(none_s, none_t)})"))

    columns = terms.groupBy("lang", "counts").agg(F.count("*").alias("m")).where(F.size("counts") > 1)
    both = columns.select("lang", "m", "counts", F.explode("counts").alias("a")).select("lang", "m", F.col("a.source").alias("s"), F.col("a.n").alias("n_s"), F.explode("counts").alias("b"))
    both = both.select("lang", "m", "s", "n_s", F.col("b.source").alias("t"), F.col("b.n").alias("n_t")).where("s <> t")
    both = with_group(with_group(both, "s", "size_s", "kinds"), "t", "size_t")
    both = both.select("lang", "s", "t", value(f"m * ({_apart(some_s, some_t)} - {_apart(some_s, none_t)} - {_apart(none_s, some_t)} + {_apart(none_s, none_t)})"))

    parts = [x.groupBy("lang", "s", "t").agg(F.sum("value").alias("value")) for x in (only_s, only_t, both)]
    sums = neither
    for x in parts:
        sums = sums.unionByName(x.select("lang", "s", "t", F.col("value").cast("decimal(38,0)").alias("value")))
    sums = sums.groupBy("lang", "s", "t").agg(F.sum("value").cast("long").alias("value"))
    pair_rows = sums.select("lang", F.col("s").alias("source"), F.lit("pair").alias("part"), F.col("t").alias("item"), "value")

    own = with_group(entries, "source", "size", "kinds", "whole")
    own = own.withColumn("p", F.expr(_share("n", "size", "kinds"))).withColumn("q", F.expr(_share("total", "whole", "kinds"))).where("p > q")
    term_rows = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))

    # A group's rows are cut to the first ranks before they are dealt, so no task gets a group's terms.
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair_rows.withColumn("rank", rank).unionByName(term_rows.withColumn("rank", rank).where(F.col("rank") <= most_terms))
