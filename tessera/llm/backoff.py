"""Katz backoff language model, learnt from the corpus and evaluated on all of it.

P(w | h) is ``d(n) * n / c(h)`` where w followed h in training n times, else ``alpha(h) * P(w | h')``
with h' one word shorter; a word never seen shares what the discounts of all words leave.  Discounts
are Good-Turing's up to counts of ``MOST_DISCOUNTED``, from the counts of counts of the whole corpus.
``alpha(h)`` is what the discounts leave of h over ``1 - sum P(w | h')`` for the w seen behind it, so
that every context sums to 1.

1. *Blocks.*  Documents are read in blocks of about ``BLOCK_BYTES``; a block keeps its distinct words and
   each text's positions in them.
2. *Tables, one for each order.*  A block's distinct n-grams with their counts are dealt over the cluster
   by context, hot contexts by word as well.  Each part sums what all blocks sent and stores the totals for
   each block, with each context's count, its small counts and its sum of lower probabilities.
3. *Hot contexts* lie in several parts; their sums are added up and joined to the blocks that use them.
4. *Score.*  Each block looks its n-grams up, from single words to the highest order, and adds
   logarithms by document.

Lists travel packed: a row for every n-gram of a block would take more room than the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import raw, slices
from tessera.llm.common import release as _release
from tessera.operators.skew import join_facts
from tessera.session import stored

#: UTF-8 bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Bytes of text for each part that n-grams are dealt to, and the most parts.
PART_BYTES, MOST_PARTS = 8 << 20, 1 << 16
#: A context with more occurrences is dealt over several parts, one for each so many.
HOT_CONTEXT = 1 << 18
#: Counts above this are not discounted.
MOST_DISCOUNTED = 5
#: The context of a text's first word.
BEGIN = -1
#: What ends every text; no word is empty.
END = b""


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, compressed byte plane by byte plane."""
    body = b"".join(len(x).to_bytes(8, "little") + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(body, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    body, out, at = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, at + 8).reshape(8, n).T).view(np.int64).reshape(-1))
        at += 8 + 8 * n
    return out


def _pack_words(words: list[bytes], *arrays: np.ndarray) -> bytes:
    """Words, and arrays with a number for each."""
    lengths, body = _pack(np.fromiter(map(len, words), np.int64, len(words)), *arrays), b"".join(words)
    return len(lengths).to_bytes(8, "little") + len(body).to_bytes(8, "little") + lengths + pa.Codec("zstd", compression_level=5).compress(body, asbytes=True)


def _unpack_words(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    a, b = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    lengths, *arrays = _unpack(blob[16 : 16 + a])
    body = pa.decompress(blob[16 + a :], b, codec="zstd", asbytes=True) if b else b""
    ends = np.cumsum(lengths)
    return [body[s:e] for s, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], arrays


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scattered 64-bit values of numbers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _parts_of(context: np.ndarray, word: np.ndarray, seen: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram: its context's, or one of several where the context is hot."""
    salt = _mixed(word) % (seen // HOT_CONTEXT + 1).astype(np.uint64)
    return (_mixed(_mixed(context) + salt) % np.uint64(parts)).astype(np.int64)


class _Numbers(dict):
    """Numbers of words, the next one for a word not met before."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Level:
    """Discounts of one order: ``rate[n]`` for counts up to MOST_DISCOUNTED, 1 above."""

    rate: np.ndarray
    total: int
    kinds: int
    #: For single words only: what counts are divided by, and the probability of a word never seen.
    base: float = 1.0
    unseen: float = 1.0

    def discounted(self, n: np.ndarray) -> np.ndarray:
        return n * self.rate[np.minimum(n, MOST_DISCOUNTED + 1)]

    def weights(self, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What counts behind contexts are divided by, and the contexts' backoff weights, 1 where never seen.

        Where no count of a context is discounted, one more is added to what counts are divided by.
        """
        n, *small, lower = sums
        held = sum((1 - self.rate[r]) * r * x for r, x in enumerate(small, 1))
        base = n + np.where(held > 0, 0.0, 1.0)
        return base, np.where(n > 0, np.where(held > 0, held, 1.0) / base / (1 - lower), 1.0)

    def single(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, self.discounted(n) / self.base, self.unseen)


def discounts(tally: list[int]) -> np.ndarray:
    """Rates for counts 0 to MOST_DISCOUNTED + 1 from how many n-grams have count 1, 2, ...

    Good-Turing's where they lie between 0 and 1, else counts less a constant: so do small or odd corpora.
    """
    k, n = MOST_DISCOUNTED, [0, *tally]
    rate = np.ones(k + 2)
    if all(n[r] > 0 for r in range(1, k + 1)):
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            for r in range(1, k + 1):
                rate[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
    if not all(0 < x < 1 for x in rate[1 : k + 1]):
        less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        rate[1 : k + 1] = [(r - less) / r for r in range(1, k + 1)]
    return rate


def _level(tally: list[int], total: int, kinds: int) -> Level:
    rate = discounts(tally)
    held = sum((1 - rate[r]) * r * tally[r - 1] for r in range(1, MOST_DISCOUNTED + 1))
    base = float(total) if held > 0 else total + 1.0
    return Level(rate, total, kinds, base, (held if held > 0 else 1.0) / base)


def _tallied(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ... MOST_DISCOUNTED + 1, their sum, and how many are above 0."""
    return [*(int((n == r).sum()) for r in range(1, MOST_DISCOUNTED + 2)), int(n.sum()), int((n > 0).sum())]


def _block_rows(kinds: int, parts: int):
    """Arrow function from documents to one row for each block."""

    def run(batches):
        task, blocks, size = TaskContext.get().partitionId(), 0, 0
        number = _Numbers()
        lists: list[np.ndarray] = []
        held: list[list[pa.Array]] = []

        def row() -> pa.RecordBatch:
            nonlocal number, lists, held, size, blocks
            _release()
            words, at, lengths = list(number), np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
            train = np.concatenate([h[-1].to_numpy(zero_copy_only=False) for h in held])
            every = np.bincount(at, minlength=len(words))
            order = np.argsort(-every, kind="stable")  # small numbers are common words and pack well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at, every, words = rank[at], every[order], [words[i] for i in order.tolist()]
            learnt = np.bincount(at[np.repeat(train, lengths)], minlength=len(words))
            part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
            by_part = np.argsort(part, kind="stable")
            dealt = []
            for own in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
                dealt.append({"p": int(part[own[0]]), "sent": _pack_words([words[i] for i in own.tolist()], learnt[own], every[own])})
            columns = [pa.array([(task << 32) + blocks])]
            for i in range(kinds + 1):
                whole = pa.concat_arrays([h[i] for h in held])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole))
            columns += [pa.array([_pack(lengths, at, part)], pa.binary()), pa.array([dealt], pa.list_(pa.struct([("p", pa.int32()), ("sent", pa.binary())])))]
            number, lists, held, size = _Numbers(), [], [], 0
            blocks += 1
            return pa.RecordBatch.from_arrays(columns, ["block", *[f"id_{i}" for i in range(kinds)], "train", "at", "dealt"])

        for batch in batches:
            for chunk in slices(batch, "text_of", BLOCK_BYTES // 4):
                more = pc.sum(pc.binary_length(chunk.column("text_of"))).as_py() or 0
                if lists and size + more > BLOCK_BYTES:
                    yield row()
                for x in raw(chunk.column("text_of")):
                    words = (x or b"").lower().split()  # bytes: only A-Z, white space of ASCII
                    words.append(END)
                    lists.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                held.append([chunk.column(c) for c in [*(f"id_{i}" for i in range(kinds)), "train"]])
                size += more
        if lists:
            yield row()

    return run


SUMS = ("n", *(f"r{r}" for r in range(1, MOST_DISCOUNTED + 1)), "lower")
_KINDS = [pa.int64()] * (MOST_DISCOUNTED + 1) + [pa.float64()]
_STATS = pa.struct([("context", pa.int64()), *zip(SUMS, _KINDS, strict=True)])
STATS = "struct<context:bigint," + ",".join(f"{c}:{'double' if c == 'lower' else 'bigint'}" for c in SUMS) + ">"
#: Rows of a table: a block's totals and hot contexts, or (block null) a part's hot contexts and counts of counts.
TABLE = f"block long, p int, back binary, hot array<bigint>, stats array<{STATS}>, tally array<bigint>"
_ARROW_TABLE = pa.schema([("block", pa.int64()), ("p", pa.int32()), ("back", pa.binary()), ("hot", pa.list_(pa.int64())), ("stats", pa.list_(_STATS)), ("tally", pa.list_(pa.int64()))])


def _rows(p: int, blocks: list[int], backs: list[bytes], hot: list[np.ndarray] | None, stats: pa.Array | None, tally: list[int]) -> pa.Table:
    n = len(blocks)
    own = pa.array([*(hot if hot is not None else [None] * n), None], pa.list_(pa.int64()))
    offsets = pa.array([0] * (n + 1) + [len(stats) if stats is not None else 0], pa.int32())
    listed = pa.ListArray.from_arrays(offsets, stats if stats is not None else pa.array([], _STATS))
    return pa.Table.from_arrays([pa.array([*blocks, None], pa.int64()), pa.array([p] * (n + 1), pa.int32()), pa.array([*backs, None], pa.binary()), own, listed, pa.array([*[None] * n, tally], pa.list_(pa.int64()))], schema=_ARROW_TABLE)


def _sum_words(table: pa.Table) -> pa.Table:
    """Totals of a part's words; numbers go by falling count."""
    p, sent = table.column("p")[0].as_py(), [_unpack_words(x) for x in table.column("sent").to_pylist()]
    number = _Numbers()
    at = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words, _ in sent]
    learnt, every = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for own, (_, (n, m)) in zip(at, sent, strict=True):
        learnt[own] += n
        every[own] += m
    ids = np.empty(len(number), np.int64)
    words = list(number)
    ids[np.array(sorted(range(len(words)), key=lambda i: (-every[i], words[i])), np.int64)] = (p << 32) + np.arange(len(words))
    return _rows(p, table.column("block").to_pylist(), [_pack(ids[own], learnt[own], every[own]) for own in at], None, None, _tallied(learnt))


def _sum_grams(last: bool):
    """Arrow function from what blocks sent to a part to its rows of the table."""

    def run(table: pa.Table) -> pa.Table:
        p, sent = table.column("p")[0].as_py(), [_unpack(x) for x in table.column("sent").to_pylist()]
        # Of each list: contexts, how many n-grams each has there, whether it is hot; words, counts, lower probabilities.
        context = np.concatenate([np.repeat(x[0], x[1]) for x in sent])
        word, learnt, every = (np.concatenate([x[i] for x in sent]) for i in (3, 4, 5))
        lower = np.concatenate([x[7].view(np.float64)[x[6]] for x in sent])
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        starts, gram = np.flatnonzero(new), np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        n, m = np.add.reduceat(learnt[order], starts), np.add.reduceat(every[order], starts)
        owner, below = context[order][starts], lower[order][starts]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sums = [np.add.reduceat(x, first) for x in (n, *((n == r).astype(np.int64) for r in range(1, MOST_DISCOUNTED + 1)), np.where(n > 0, below, 0.0))]
        owner = owner[first]
        hot = [x[0][x[2] > 0] for x in sent]
        partial = np.isin(owner, np.concatenate(hot))
        stats = pa.StructArray.from_arrays([pa.array(owner[partial]), *(pa.array(x[partial], k) for x, k in zip(sums, _KINDS, strict=True))], fields=list(_STATS))
        backs = []
        for x, own in zip(sent, np.split(gram, np.cumsum([len(x[3]) for x in sent])[:-1]), strict=True):
            at = np.searchsorted(owner, x[0])
            backs.append(_pack(*(y[at].view(np.int64) for y in sums), n[own], *([] if last else [m[own], (p << 32) + own])))
        rows = _rows(p, table.column("block").to_pylist(), backs, hot, stats, _tallied(n))
        del sent, context, word, learnt, every, lower, order, new, gram
        _release()
        return rows

    return run


def _returned(rows: list[dict]) -> list[np.ndarray]:
    """The arrays that parts sent back, part after part."""
    return [np.concatenate(x) for x in zip(*(_unpack(r["back"]) for r in sorted(rows, key=lambda r: r["p"])), strict=True)]


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values in the order of parts, put where they were dealt from."""
    out = np.empty(len(place), values.dtype)
    out[place] = values
    return out


class _Walk:
    """A block's tokens with their probabilities, raised one order at a time."""

    def __init__(self, row: dict, known: Level) -> None:
        self.row = row
        self.lengths, word, part = _unpack(row["at"])
        self.word = word.astype(np.int32)
        place = np.argsort(part, kind="stable")
        self.ids, self.n, self.seen = (_placed(x, place) for x in _returned(row["back_1"]))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.prob = known.single(self.n)[self.word]
        self.docs = int(self.seen[self.word[self.first[0] + self.lengths[0] - 1]])  # ends, so texts, of the corpus
        self.behind(self.word, self.ids, self.seen)

    def behind(self, gram: np.ndarray, ids: np.ndarray, seen: np.ndarray) -> None:
        """Grams become the contexts of the tokens that follow them."""
        self.context = np.empty(len(gram), np.int32)
        self.context[1:] = gram[:-1] + 1
        self.context[self.first] = 0
        self.context_ids, self.context_seen = np.concatenate(([BEGIN], ids)), np.concatenate(([self.docs], seen))

    def grams(self, parts: int) -> None:
        """The distinct n-grams of the next order."""
        unique, gram = np.unique(self.context * np.int64(len(self.ids)) + self.word, return_inverse=True)
        self.gram = gram.astype(np.int32)
        self.of, self.last = unique // len(self.ids), unique % len(self.ids)
        self.lower = np.empty(len(unique))
        self.lower[self.gram] = self.prob
        part = _parts_of(self.context_ids[self.of], self.ids[self.last], self.context_seen[self.of], parts)
        self.by_part = np.argsort(part, kind="stable")
        part, of = part[self.by_part], self.of[self.by_part]
        # Where parts begin among the n-grams as dealt, and where contexts do within parts.
        self.cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        self.runs = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (of[1:] != of[:-1]))))
        self.part, self.run_of = part[self.cuts], of[self.runs]

    def raise_to(self, order: int, known: Level, parts: int) -> None:
        self.grams(parts)
        *sums, lower, n = (back := _returned(self.row[f"back_{order}"]))[: len(SUMS) + 1]
        sums = [*sums, lower.view(np.float64)]
        facts = self.row[f"hot_{order}"]
        if len(facts):
            own, context = self.context_ids[self.run_of], facts.field("context").to_numpy()
            by = np.argsort(context)
            at = np.minimum(np.searchsorted(context[by], own), len(by) - 1)
            found = context[by][at] == own
            sums = [np.where(found, facts.field(c).to_numpy()[by][at], x) for c, x in zip(SUMS, sums, strict=True)]
        base, alpha = known.weights(sums)
        many = np.diff(np.append(self.runs, len(self.by_part)))
        base, alpha, n = (_placed(x, self.by_part) for x in (np.repeat(base, many), np.repeat(alpha, many), n))
        self.prob = np.where(n > 0, known.discounted(n) / base, alpha * self.lower)[self.gram]
        if len(back) > len(SUMS) + 1:
            seen, ids = (_placed(x, self.by_part) for x in back[len(SUMS) + 1 :])
            self.behind(self.gram, ids, seen)


def _walks(batches, levels: list[Level], parts: int):
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].values if c.startswith("hot_") else batch.column(c)[r].as_py() for c in batch.schema.names if not c.startswith("id_")}
            walk = _Walk(row, levels[0])
            for k, known in enumerate(levels[1:]):
                walk.raise_to(k + 2, known, parts)
            yield batch, r, walk
            del walk, row
            _release()


def _deal(levels: list[Level], parts: int):
    """Arrow function from blocks to the n-grams of the next order, by part."""

    def run(batches):
        for batch, r, walk in _walks(batches, levels, parts):
            walk.grams(parts)
            train = np.repeat(np.array(walk.row["train"], bool), walk.lengths)
            learnt, every = np.bincount(walk.gram[train], minlength=len(walk.of)), np.bincount(walk.gram, minlength=len(walk.of))
            many = np.diff(np.append(walk.runs, len(walk.by_part)))
            hot = (walk.context_seen[walk.run_of] >= HOT_CONTEXT).astype(np.int64)
            cuts, runs = walk.cuts[1:], np.searchsorted(walk.runs, walk.cuts[1:])
            lists = zip(walk.part.tolist(), np.split(walk.by_part, cuts), *(np.split(x, runs) for x in (walk.run_of, many, hot)), strict=True)
            for p, own, of, times, warm in lists:
                values, at = np.unique(walk.lower[own], return_inverse=True)
                sent = _pack(walk.context_ids[of], times, warm, walk.ids[walk.last[own]], learnt[own], every[own], at, values)
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), pa.array([p], pa.int32()), pa.array([sent], pa.binary())], ["block", "p", "sent"])

    return run


def _score(levels: list[Level], parts: int, kinds: int, names: list[str]):
    """Arrow function from blocks to their documents' scores."""

    def run(batches):
        words = levels[0]
        for batch, r, walk in _walks(batches, levels, parts):
            base = np.log10((walk.n + 0.1) / (words.total + 0.1 * (words.kinds + 1)))[walk.word]
            sums = [np.add.reduceat(x, walk.first) for x in ((walk.n > 0).astype(np.int64)[walk.word], base, np.log10(walk.prob))]
            kept = [batch.column(c)[r].values for c in [*(f"id_{i}" for i in range(kinds)), "train"]]
            del base
            yield pa.RecordBatch.from_arrays([*kept, pa.array(walk.lengths), pa.array(sums[0]), pa.array(np.full(len(walk.lengths), words.total)), pa.array(sums[1]), pa.array(sums[2])], names)

    return run


def scored(docs: DataFrame, ids: list[str], train: Column, text: str = "text", *, order: int = 2) -> DataFrame:
    """Log10 probability of every whole text, by a model of the texts for which ``train`` is true.

    Tokens are runs other than ASCII white space, A-Z lower-cased, and one end for each text.  Returns
    ``ids``, ``train``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (single words with 0.1 added to each count) and ``score`` (backoff of ``order`` words).

    Null and empty texts are just their end; a null ``train`` counts as false.  Rows stay one for one,
    and repeated ones teach again.  Without training texts each token scores 0, as the one outcome left;
    an empty table gives no rows.  Columns beyond those named are not read; ``ids`` must not be
    named like a result.
    """
    rows = docs.select(*[F.col(c).alias(f"id_{i}") for i, c in enumerate(ids)], F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text_of"))
    size = rows.agg(F.sum(F.octet_length("text_of"))).first()[0] or 0
    parts = min(MOST_PARTS, max(8, -(-size // PART_BYTES)))
    kinds = [docs.schema[c].dataType for c in ids]
    dealt = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("sent", T.BinaryType())]))
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(f"id_{i}", T.ArrayType(k)) for i, k in enumerate(kinds)], T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("at", T.BinaryType()), T.StructField("dealt", dealt)])
    blocks = stored(rows.mapInArrow(_block_rows(len(ids), parts), schema))
    wide = min(20_000, max(1, 2 * blocks.count()))  # so that a task gets a block or two, however many there are

    levels: list[Level] = []
    whole = blocks.drop("dealt").repartition(wide, "block")
    for k in range(1, order + 1):
        sent = blocks.select("block", F.explode("dealt").alias("d")).select("block", "d.p", "d.sent") if k == 1 else whole.mapInArrow(_deal(levels, parts), "block long, p int, sent binary")
        table = stored(sent.groupBy("p").applyInArrow(_sum_words if k == 1 else _sum_grams(k == order), TABLE))
        counts = table.where("tally is not null").select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        tally = [0] * (MOST_DISCOUNTED + 3)
        for c in counts:
            tally[c["i"]] = c["n"]
        levels.append(_level(tally[: MOST_DISCOUNTED + 1], tally[-2], tally[-1]))
        own = table.where("block is not null")
        back = own.repartition(wide, "block").groupBy("block").agg(F.collect_list(F.struct("p", "back")).alias(f"back_{k}"))
        whole = whole.join(back, "block")
        if k > 1:
            sums = table.select(F.explode("stats").alias("s")).select("s.*").groupBy("context").agg(*[F.sum(c).alias(c) for c in SUMS])
            used = own.select("block", F.explode("hot").alias("context")).distinct()
            facts = join_facts(used, sums, "context").repartition(wide, "block").groupBy("block").agg(F.collect_list(F.struct("context", *SUMS)).alias("found"))
            whole = whole.join(facts, "block", "left").withColumn(f"hot_{k}", F.coalesce("found", F.array().cast(f"array<{STATS}>"))).drop("found")
    names = [*ids, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [*kinds, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    return whole.mapInArrow(_score(levels, parts, len(ids), names), T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))

