"""Mixing sources to target weights by hash thresholds.

A source's target is a number of words.  Its documents are all taken ``floor(target / size)``
times; which of them are taken once more is decided by a threshold on a hash of the document:

1. Words are summed by source and hash bucket, the top ``BITS`` bits of the hash.
2. Running sums over the buckets of a source find the one in which its budget runs out.
3. Only that bucket is refined: its documents are summed by the next ``BITS`` bits, and so on; those
   of the last bucket, a 16-millionth of the source, by the whole hash.  The result is one threshold
   for each source.
4. What the budget still lacks, less than the document at the threshold, is a smaller budget for
   the documents past it that fit in; their threshold is found the same way, and so on.

The decision on a document compares its hash and size with its source's few numbers.  Nothing is
sorted but the bucket sums, ``2**BITS`` for each source and step at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, unused

#: Bits of the hash (60 in all) that a bucket stands for, at each of LEVELS levels.
BITS = 8
LEVELS = 3
#: Sources whose thresholds are broadcast; more than that are joined by a shuffle.
BROADCAST_SOURCES = 10_000
HASH_BITS = 60
#: Nested budgets for each source.
ROUNDS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """The hash that orders documents: of the id, or of the text where there is none."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, ids: list[str], doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(*ids, F.col(source).alias("source_of"), words(F.col(text)).alias("size"), place(F.col(doc_id), F.col(text)).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """``source_of``, ``source_size`` and ``target`` from one row of each source.

    Sources by code point, null last, have the weights in turn and share all words.  No target
    passes ``most`` times its source's size: by rising ratio of that cap to the weight, caps hold as
    long as the rest, dealt by weight, would pass the next one.  The only sort without a partition
    is over sources, not documents.
    """
    order = Window.orderBy(F.col("source_of").asc_nulls_last())
    numbered = sizes.withColumn("n", F.row_number().over(order) - 1)
    numbered = numbered.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.pmod("n", F.lit(len(weights))).cast("int")]).withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    dealt = numbered.withColumn("level", level)
    # The first source that its cap does not hold sets the level of all from there on.
    dealt = dealt.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(everything)["level"])
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
    return dealt.select("source_of", "source_size", target.alias("target"))


def _crossing(sums: DataFrame, key: str, *carried: str) -> DataFrame:
    """For each source, the first ``key`` by whose end its words pass the budget: the key, what was
    spent before it and with it, and carried columns."""
    run = Window.partitionBy("source_of").orderBy(key)
    passed = sums.withColumn("upto", F.col("base") + F.sum("words").over(run)).where("upto > budget")
    first = passed.groupBy("source_of").agg(F.min_by(F.struct(key, (F.col("upto") - F.col("words")).alias("spent"), "upto", *carried), key).alias("c"))
    return first.select("source_of", "c.*")


def _threshold(rows: DataFrame) -> DataFrame:
    """``source_of``, ``threshold``, ``spent``, ``upto``: rows below the threshold fit the budget.

    ``rows`` has source_of, size, place and its source's budget.  Sources whose rows all fit are
    left out.
    """
    near = rows.withColumn("base", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("place", HASH_BITS - BITS * level)
        sums = near.groupBy("source_of", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("base").alias("base"))
        inside = cut_lineage(_crossing(sums, "bucket").select(F.col("source_of").alias("source_i"), "bucket", F.col("spent").alias("base")))
        near = _with_sources(rows, inside, (rows["source_of"].eqNullSafe(inside["source_i"])) & (bucket == F.col("bucket"))).drop("source_i", "bucket")
    exact = near.groupBy("source_of", "place").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("base").alias("base"))
    return _crossing(exact, "place").withColumnRenamed("place", "threshold")


def _with_sources(rows: DataFrame, facts: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their sources: one row for each, broadcast unless they are very many."""
    few = facts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(facts) if few else facts, on, how)


def plan(rows: DataFrame, goals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each source: how often all documents are taken, and up to which thresholds once more.

    Adds ``times`` and, for each round k, ``upto_k`` (places below it are taken) and ``fit_k`` (of
    documents not taken before, only those of that size or less).
    """
    times = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    out = cut_lineage(goals.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")))
    end = F.lit(1 << HASH_BITS).cast("long")
    for k in range(rounds):
        out = out.withColumn(f"fit_{k}", F.col("left") if k else F.lit(float("inf")))
        budgets = out.select(F.col("source_of").alias("source_b"), F.col("left").alias("budget"), *[f"upto_{i}" for i in range(k)], *[f"fit_{i}" for i in range(k + 1)])
        free = _with_sources(rows, budgets, rows["source_of"].eqNullSafe(budgets["source_b"])).where((F.col("size") > 0) & (F.col("size") <= F.col(f"fit_{k}")) & ~_taken(k)).select("source_of", "size", "place", "budget")
        found = _threshold(free).select(F.col("source_of").alias("source_f"), "threshold", "spent", "upto")
        # The last round may pass the budget where that comes nearer to it.
        nearer = (F.col("spent") + F.col("upto") <= 2 * F.col("left")) if k == rounds - 1 else F.lit(False)
        out = out.join(found, out["source_of"].eqNullSafe(found["source_f"]), "left")
        out = out.withColumn(f"upto_{k}", F.coalesce(F.col("threshold") + nearer.cast("long"), end)).withColumn("left", F.when(F.col("threshold").isNull(), 0.0).otherwise(F.col("left") - F.col("spent")))
        out = cut_lineage(out.drop("source_f", "threshold", "spent", "upto"))
    return out.drop("left")


def _taken(rounds: int) -> Column:
    """Whether one of the rounds takes a document of ``size`` and ``place``."""
    hit = F.lit(False)
    for k in range(rounds):
        hit = hit | ((F.col("place") < F.col(f"upto_{k}")) & (F.col("size") <= F.col(f"fit_{k}")))
    return hit


def mixture(docs: DataFrame, ids: list[str], *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """How often the mix takes each document.

    Returns ``ids``, ``size`` (words), ``source_size``, ``target`` (words its source should give),
    ``times`` (0 to ``most``) and ``taken`` (times x size).  Null texts and sources without a word
    have size 0 and take nothing; a null source is one like any other.  Documents with equal hashes,
    so all rows of one id, or of one text without id, stand or fall together in a round.  The hash
    has no other input, so reruns agree.  No documents give no rows.  Other columns are not read, and ``ids`` must not
    be named like a result, ``place`` or ``source_of``.
    """
    rows = cut_lineage(sized(docs, ids, doc_id, text, source))
    planned = _planned(rows, weights, most, rounds)
    times = F.col("times") + ((F.col("size") > 0) & _taken(rounds)).cast("long")
    joined = _with_sources(rows, planned, rows["source_of"].eqNullSafe(planned["source_p"]))
    return joined.select(*ids, "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def _planned(rows: DataFrame, weights: tuple[float, ...], most: int, rounds: int) -> DataFrame:
    goals = targets(rows.groupBy("source_of").agg(F.sum("size").alias("source_size")), weights, most)
    return plan(rows.select("source_of", "size", "place"), goals, rounds).withColumnRenamed("source_of", "source_p")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns stay, whatever their names.

    A row's hash and size are compared with its source's thresholds as it is read: texts are neither
    shuffled nor sorted.  Rows are taken as in ``mixture``: those without a word (null texts too) are
    left out, repeated rows stand or fall together.  An empty table gives no rows.
    """
    (held,) = unused(docs, "row_held")
    # Every level reads these short rows again, so they go from the texts' many tasks to few files.
    planned = _planned(cut_lineage(sized(docs, [], doc_id, text, source).hint("rebalance")), weights, most, rounds)
    rows = docs.select(F.struct(*docs.columns).alias(held), F.col(source).alias("source_of"), words(F.col(text)).alias("size"), place(F.col(doc_id), F.col(text)).alias("place"))
    times = F.col("times") + ((F.col("size") > 0) & _taken(rounds)).cast("long")
    joined = _with_sources(rows, planned, rows["source_of"].eqNullSafe(planned["source_p"])).withColumn("often", times).where("often > 0")
    return joined.select(held, F.explode(F.sequence(F.lit(1).cast("long"), F.col("often")))).select(f"{held}.*")
