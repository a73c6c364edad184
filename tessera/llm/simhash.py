"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two
fingerprints are linked at ``radius`` or fewer differing bits; linked groups are components.

Finding the links, all of them:

1. Documents collapse to distinct fingerprints, so exact copies cost one row.
2. The 64 bits are cut into ``radius + 2`` pieces.  Fingerprints within the radius agree in at
   least two whole pieces, so they meet in at least one of the buckets keyed by two pieces.
3. Buckets hold few rows as a rule.  Larger ones are cut into tiles of ``TILE`` fingerprints and
   each pair of tiles is a row of its own, so that no task gets a whole large bucket.
4. In a task, rows are stored as bit planes.  Distances of 64 queries to a block grow plane by
   plane in carry-save counters, and a block is left once all its distances exceed the radius.
   A bucket's links leave as a spanning forest: at most one row per fingerprint, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import raw, with_columns
from tessera.operators.components import connected_components
from tessera.operators.skew import join_facts
from tessera.session import cut_lineage, unused

#: Fingerprints of a bucket that one task compares with each other.
TILE = 4096
#: Fingerprints per block of bit planes; small buckets share one.
BLOCK = 1024


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    return bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)


def _pieces(text: bytes, size: int = 4 << 20):
    """Runs of whole words of a long text."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as an unsigned integer; 0 without words."""
    votes, n, carried = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for piece in _pieces((text or b"").lower()):
        found = carried + piece.split()
        if len(found) >= words:
            flat = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            for at in range(0, len(found) - words + 1, 1 << 16):
                last = min(at + (1 << 16), len(found) - words + 1)
                got = np.array([hashed(flat[a:b], seed) for a, b in zip(starts[at:last].tolist(), ends[at + words - 1 : last + words - 1].tolist(), strict=True)], np.uint64)
                votes += _votes(got)
                n += len(got)
        carried = found[-(words - 1) :] if words > 1 else []
    if not n:
        if not carried:
            return 0
        votes, n = _votes(np.array([hashed(b" ".join(carried), seed)], np.uint64)), 1
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, ids: list[str], text: str = "text", *, words: int = 4, seed: int = 42) -> DataFrame:
    """Columns ``ids`` and ``print``, the fingerprint as the signed long of the same bits."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(x, words, seed) for x in raw(part.column("text_of"))], np.uint64).view(np.int64))]

    rows = docs.select(*ids, F.col(text).alias("text_of"))
    return with_columns(rows, "text_of", compute, [T.StructField("print", T.LongType())])


def hex_of(column: str) -> F.Column:
    """The 16 hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _planes(prints: np.ndarray) -> np.ndarray:
    """64 bit planes, each of ceil(n / 64) words."""
    wide = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    wide[: len(prints)] = prints
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix: which of the ``n`` stored fingerprints differ from each query in ``radius`` or fewer bits.

    ``ones``, ``twos`` and ``fours`` are vertical counters of 64 distances per word; ``over`` marks
    distances past the radius.
    """
    asked = np.where(np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool), ~np.uint64(0), np.uint64(0))
    shape = (len(queries), planes.shape[1])
    digits = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(shape, np.uint64)
    for k in range(64):
        carry = planes[k][None, :] ^ asked[k][:, None]
        for d in digits:
            d ^= carry
            carry &= ~d  # the digit was set and is not now: carry on
        over |= carry
        if k >= radius and k % 4 == 3:
            past = over | _above(digits, radius)
            if k < 63 and bool((past == ~np.uint64(0)).all()):
                return np.zeros((len(queries), n), bool)
    past = over | _above(digits, radius)
    return ~np.unpackbits(past.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def _above(digits: list[np.ndarray], limit: int) -> np.ndarray:
    """Where the vertical counters exceed ``limit``."""
    above, equal = np.zeros_like(digits[0]), np.full_like(digits[0], ~np.uint64(0))
    for i in reversed(range(len(digits))):
        if limit >> i & 1:
            equal = equal & digits[i]
        else:
            above = above | equal & digits[i]
            equal = equal & ~digits[i]
    return above


def forest(prints: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """The least index linked to each fingerprint within its group, by chains of links."""
    label, planes = np.arange(len(prints)), _planes(prints)
    for start in range(0, len(prints), 64):  # later rows only: links go both ways
        near = within(planes[:, start // 64 :], len(prints) - start, prints[start : start + 64], radius)
        near &= group[None, start:] == group[start : start + 64, None]
        for q in np.flatnonzero(near.sum(axis=1) > 1):
            met = np.unique(label[start:][near[q]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def _links(radius: int):
    """Arrow function from rows of ``prints`` (one row per bucket or pair of tiles) to links."""

    def block(lists: list[np.ndarray]) -> pa.RecordBatch:
        prints, group = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        label = forest(prints.view(np.uint64), group, radius)
        moved = np.flatnonzero(label != np.arange(len(prints)))
        return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[label[moved]])], ["src", "dst"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column("prints")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if held and n + b - a > BLOCK:
                    yield block(held)
                    held, n = [], 0
                held.append(flat[a:b])
                n += b - a
        if held:
            yield block(held)

    return run


def links(prints: DataFrame, column: str = "print", *, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (src, dst) that join all distinct fingerprints within the radius, directly or by chains."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    piece = [F.shiftrightunsigned(F.col("p"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    keys = F.array(*[F.lit(n << 48) + F.shiftleft(piece[i], 24) + piece[j] for n, (i, j) in enumerate(combinations(range(radius + 2), 2))])
    rows = prints.select(F.col(column).alias("p")).select("p", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = join_facts(rows, shared, "key")
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / tile)).withColumn("mine", F.pmod(F.xxhash64("p"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "p")
    packed = rows.repartition("key", "a", "b").groupBy("key", "a", "b").agg(F.collect_list("p").alias("prints"))
    return packed.select("prints").mapInArrow(_links(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, ids: list[str], text: str = "text", *, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every row of ``docs``.

    Returns ``ids``, ``print`` (long) and ``component``: the least ``ids`` (the column itself for
    one id, a struct for several) of all rows linked to this one by chains, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows with a null id
    belong to components and never name one unless all its ids are null.  Repeated rows stay
    repeated.  An empty table gives no rows.  Columns of ``docs`` beyond ``ids`` and ``text`` are
    not read; ``ids`` must not be named like a result.
    """
    prints = cut_lineage(fingerprints(docs, ids, text, words=words, seed=seed))
    name = F.min(F.col(ids[0]) if len(ids) == 1 else F.struct(*[c for i in ids for c in (F.col(i).isNull().alias(f"{i}_none"), F.col(i))]))
    distinct = cut_lineage(prints.groupBy("print").agg(name.alias("first")))
    linked = connected_components(links(distinct, radius=radius)).select(F.col("node").alias("print"), F.col("component").alias("root"))
    labelled = join_facts(distinct, linked, "print", "left")
    least = labelled.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = join_facts(labelled, least, "root", "left").select("print", F.coalesce("least", "first").alias("component"))
    return join_facts(prints, named, "print").select(*ids, "print", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the least id, nulls last.

    Of rows that share that id, the least hash of text and then of all columns decides, so one
    stays even of repeated rows.  All columns stay, whatever their names.  Null and empty texts are
    near duplicates of each other.  An empty table gives no rows.
    """
    key, kept_key, place = unused(docs, "key_of_doc", "key_kept", "place_of_row")
    (mark,) = unused(docs, "hash_of_text")
    near = near_duplicates(docs.withColumn(mark, F.xxhash64(text)), [id_col, mark], text, words=words, seed=seed, radius=radius)
    own = F.col(f"component.{id_col}").eqNullSafe(F.col(id_col)) & (F.col(f"component.{mark}") == F.col(mark))
    row_key = F.struct(F.col(id_col).alias("id"), F.col(mark).alias("text"))
    # Only here do texts move, and once: the join and the window are dealt by the same key.
    keep = near.where(own).select(row_key.alias(kept_key)).distinct().hint("shuffle_hash")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")))
    kept = keyed.join(keep, F.col(key) == F.col(kept_key), "left_semi")
    first = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
