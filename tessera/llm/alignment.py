"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

1. *Tokenise.*  Texts are cut at spaces that no token of either vocabulary crosses.  Each task encodes
   the pieces that it meets once and sends, for every ``BLOCK_BYTES`` of text, the distinct pieces' ids,
   the distinct pairs of end arrays that pieces have (their shapes), and each text's places in the list
   of pieces.
2. *Align*, by higher-order functions only.  In each shape ``array_intersect`` of the end arrays gives
   the cuts.  Both arrays' ends sorted into one tell each B token how many A tokens end before and within
   it; ``sequence`` over these makes its links, ``transform`` over the cuts the groups, both as places of
   tokens.  Each piece puts its ids there.  Pieces end at a cut, so a text's groups and links are those of
   its pieces in turn.
3. *Count.*  Links are summed by id pair over the corpus.  The most frequent pairs, at most
   ``HEAD_PAIRS``, go back to the documents by a broadcast, all others by a join that splits hot keys.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import piece_rows
from tessera.llm.common import slices
from tessera.operators.skew import join_facts
from tessera.session import stored

#: UTF-8 bytes of text whose distinct pieces make a row; one longer text is a row of its own.
BLOCK_BYTES = 3 << 20
#: Pieces that a task remembers; past that it starts afresh with the next row.
REMEMBERED = 1 << 17
#: Pieces encoded in one call.
TOGETHER = 2048
#: Pairs broadcast at most, one row of two numbers each; the rest is joined by a shuffle.
HEAD_PAIRS = 1 << 20


def plain_rows(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of the byte-level vocabulary file without its special tokens."""
    with open(path, encoding="utf-8") as f:
        special = {t["id"] for t in json.load(f)["added_tokens"]}
    return [(i, b) for i, b in piece_rows(path) if i not in special]


def first_pieces(path: str) -> list[bytes]:
    """Bytes of each id of the byte-level vocabulary file."""
    return [b for _, b in piece_rows(path)]


def second_pieces(path: str) -> list[bytes]:
    """Bytes of each id of the piece model file: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
    return [bytes([int(m[1], 16)]) if (m := byte.fullmatch(x)) else x.replace("▁", " ").encode() for x in map(model.id_to_piece, range(model.get_piece_size()))]


class _Numbers(dict):
    """Numbers of pieces or shapes, the next one for what was not met before."""

    def __missing__(self, what: str | bytes) -> int:
        n = self[what] = len(self)
        return n


class _Ragged:
    """Lists of token ids, by number of piece."""

    def __init__(self) -> None:
        self.ids, self.used = np.empty(1 << 12, np.int32), 0
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(total, len(self.ids)), np.int32)])
        self.ids[self.used : self.used + total] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.used += total

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``at``, one after another, and where each piece's end."""
        many = self.counts[at]
        upto = np.cumsum(many)
        return self.ids[np.repeat(self.starts[at] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)], upto


class _Encoder:
    """Both tokenizers with a memory of pieces."""

    # A space after something else than white space, before something else than a space: both split there.
    CUT = re.compile(r"(?<=\S)(?= +[^ ])")
    ODD = re.compile(r"\s | $|^ ")
    ODD_ASCII = [c + " " for c in map(chr, range(128)) if c.isspace()]

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        # Ids of this family of vocabularies are in the order of their merges, so they serve as ranks.
        ranks = {b: i for i, b in plain_rows(first)}
        self.a = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.bytes = first_pieces(first), second_pieces(second)
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in self.bytes]
        # A piece with a space behind something else would reach over a cut.
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.lists, self.right = (_Ragged(), _Ragged()), np.empty(0, bool)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text, each without the space that it starts with."""
        if not self.cuts:
            return [text]
        if text.isascii():
            odd = text[0] == " " or text[-1] == " " or any(x in text for x in self.ODD_ASCII)
        else:
            odd = self.ODD.search(text) is not None
        if odd:
            return [x[1:] for x in self.CUT.split(" " + text)]
        return text.split(" ")

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
        """Ids and ends of both tokenizers for pieces one after another, and whether the bytes are these."""
        a = self.a.encode_ordinary(" " + " ".join(texts))
        b = self.b.encode(" ".join(texts))
        whole = b" " + " ".join(texts).encode()
        right = self.a.decode_bytes(a) == whole and b"".join([self.bytes[1][i] for i in b]) == whole
        ids = [np.array(x, np.int64) for x in (a, b)]
        return ids, [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)], right

    def _add(self, new: list[str]) -> None:
        """Remember pieces: many in one call, which cuts between them, or each alone where that fails."""
        lengths = np.fromiter((len(p.encode()) + 1 for p in new), np.int64, len(new))
        if len(new) > 1:
            ids, ends, right = self.encoded(new)
            stops = np.cumsum(lengths)
            at = [np.searchsorted(e, stops) for e in ends]
            if right and all((e[i] == stops).all() for e, i in zip(ends, at, strict=True)):
                for ragged, x, i in zip(self.lists, ids, at, strict=True):
                    ragged.add(x, np.diff(i + 1, prepend=0))
                self.right = np.concatenate([self.right, np.ones(len(new), bool)])
                return
            for p in new:
                self._add([p])
        elif new:
            ids, _, right = self.encoded(new)
            for ragged, x in zip(self.lists, ids, strict=True):
                ragged.add(x, np.array([len(x)]))
            self.right = np.append(self.right, right)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pieces; none for a text that its tokens do not spell."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, out = self.number, []

        def of(pieces: list[str]) -> np.ndarray:
            return np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))

        known = len(number)
        out = [of(self.pieces(t)) if t else np.empty(0, np.int64) for t in texts]
        self._learn(list(number)[known:])
        for r, t in enumerate(texts):
            if not self.right[out[r]].all():  # its pieces may not be those of the whole: take it as one
                known = len(number)
                out[r] = of([t])
                self._learn(list(number)[known:])
                if not self.right[out[r]].all():
                    out[r] = out[r][:0]
        return out

    def _learn(self, new: list[str]) -> None:
        batch: list[str] = []
        for p in new:
            # Only between a character and a space before a character are neighbours cut apart.
            if not p or p[0] == " " or p[-1].isspace() or not self.cuts:
                self._add(batch)
                self._add([p])
                batch = []
            else:
                batch.append(p)
                if len(batch) >= TOGETHER:
                    self._add(batch)
                    batch = []
        self._add(batch)

    def shapes(self, own: np.ndarray) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
        """The number of each piece's shape, and the shapes, each once: both sides' ends.

        A piece's ends are counted in byte offsets where a token of either side ends, so that pieces of other
        lengths have a shape in common if their tokens end in the same order.
        """
        if not len(own):
            return [], []
        counts = [ragged.counts[own] for ragged in self.lists]
        ends = [np.cumsum(sizes[ragged.take(own)[0]]) for ragged, sizes in zip(self.lists, self.sizes, strict=True)]
        rank = np.zeros(ends[0][-1] + 1, np.int32)
        for x in ends:
            rank[x] = 1
        rank = np.cumsum(rank, dtype=np.int32)
        before = np.concatenate(([0], rank[ends[0]][np.cumsum(counts[0]) - 1]))[:-1]
        stops = np.cumsum(1 + counts[0] + counts[1])
        starts = stops - 1 - counts[0] - counts[1]
        key = np.empty(stops[-1], np.int32)
        key[starts] = counts[0]
        for x, many, after in zip(ends, counts, (starts + 1, starts + 1 + counts[0]), strict=True):
            key[np.repeat(after - np.cumsum(many) + many, many) + np.arange(len(x))] = rank[x] - np.repeat(before, many)
        raw, number = key.tobytes(), _Numbers()
        shape = [number[raw[i:j]] for i, j in zip((starts * 4).tolist(), (stops * 4).tolist(), strict=True)]
        return shape, [(x[1 : x[0] + 1], x[x[0] + 1 :]) for x in (np.frombuffer(k, np.int32) for k in number)]


def _listed(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values.astype(np.int32)))


def _tokenised(kinds: int, first: str, second: str):
    """Arrow function from documents to one row for each block."""

    def run(batches):
        both, task, rows = _Encoder(first, second), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for chunk in slices(batch, "text_of", BLOCK_BYTES):
                found = both.numbers([x or "" for x in chunk.column("text_of").to_pylist()])
                flat = np.concatenate(found)
                place = np.zeros(len(both.number), np.int64)
                place[flat] = 1
                own = np.flatnonzero(place)
                place[own] = np.arange(len(own))
                shape, ends = both.shapes(own)
                pieces = pa.StructArray.from_arrays([*[_listed(ragged.take(own)[0], ragged.counts[own]) for ragged in both.lists], pa.array(shape, pa.int32())], ["a", "b", "shape"])
                shapes = pa.StructArray.from_arrays([pa.array([x[k] for x in ends], pa.list_(pa.int32())) for k in (0, 1)], ["a_end", "b_end"])
                many = np.fromiter(map(len, found), np.int64, len(found))
                upto = np.concatenate(([0], np.cumsum(many)))
                totals = [pa.array(np.diff(np.concatenate(([0], np.cumsum(ragged.counts[flat])))[upto])) for ragged in both.lists]
                number = pa.array(np.arange(len(found)) + task + rows)
                docs = pa.StructArray.from_arrays([*[chunk.column(f"id_{i}") for i in range(kinds)], number, *totals, _listed(place[flat], many)], [*[f"id_{i}" for i in range(kinds)], "row", "n_a", "n_b", "at"])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(docs), one(pieces), one(shapes)], ["docs", "pieces", "shapes"])
                rows += len(found)

    return run


def tokenised(docs: DataFrame, ids: list[str], first: str, second: str, text: str = "text") -> DataFrame:
    """Texts as places in a list of distinct pieces, the pieces' token ids, and their tokens' ends.

    Each row has ``shapes`` (``a_end``, ``b_end``, each pair once), ``pieces`` (``a``, ``b``, and ``shape``,
    a place in shapes) and ``docs``: columns ``ids`` as ``id_0`` ..., ``row`` (a number of the document),
    ``n_a``, ``n_b`` (tokens) and ``at`` (its pieces in turn).
    """
    rows = docs.select(*[F.col(c).alias(f"id_{i}") for i, c in enumerate(ids)], F.col(text).alias("text_of"))
    numbers = T.ArrayType(T.IntegerType())
    doc = T.StructType([*[T.StructField(f"id_{i}", docs.schema[c].dataType) for i, c in enumerate(ids)], *[T.StructField(c, T.LongType()) for c in ("row", "n_a", "n_b")], T.StructField("at", numbers)])
    piece = T.StructType([T.StructField("a", numbers), T.StructField("b", numbers), T.StructField("shape", T.IntegerType())])
    shape = T.StructType([T.StructField("a_end", numbers), T.StructField("b_end", numbers)])
    schema = T.StructType([T.StructField(c, T.ArrayType(x)) for c, x in (("docs", doc), ("pieces", piece), ("shapes", shape))])
    return rows.mapInArrow(_tokenised(len(ids), first, second), schema)


#: Tokens of both sides of a shape that are looked through for each place.
SHORT = 64
#: What stands between tokens in a written group, before the piece's own names: places 0, 1 and 2.
BETWEEN = (",", "|", ";")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def shaped(shape: Column) -> Column:
    """Links and written groups of pieces with these ends, as places; null where both sides end alike.

    ``links`` has the places of the A and the B token, ``written`` places among ``BETWEEN``, A's tokens
    and B's.  Numbers below count from 0.  ``ends`` holds both sides' ends in order, doubled, B's odd;
    ``at`` is where B's stand in it, so ``at[j] - j`` A tokens end by the end of B token j.
    """
    a_end, b_end = shape["a_end"], shape["b_end"]
    ends = F.sort_array(F.concat(F.transform(a_end, lambda e: e * 2), F.transform(b_end, lambda e: e * 2 + 1)))
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def linked(last: Column, first) -> Column:
        # From the first to the last A token that each B token meets.
        return F.flatten(F.transform(last, lambda n, j: F.transform(F.sequence(first(j), n), lambda i: F.struct(i.alias("a"), j.alias("b")))))

    def found(links: Column, a_stop: Column, b_stop: Column) -> Column:
        return F.struct(links.alias("links"), _let(a_stop, lambda x: _let(b_stop, lambda y: written(x, y))).alias("written"))

    def written(a_stop: Column, b_stop: Column) -> Column:
        a_first = F.lit(len(BETWEEN))
        group = lambda k: F.concat(side(a_stop, k, a_first), F.array(F.lit(1)), side(b_stop, k, a_first + F.size(a_end)), F.array(F.lit(2)))
        return _let(F.flatten(F.transform(a_stop, lambda _, k: group(k))), lambda x: F.slice(x, 1, F.size(x) - 1))

    def side(stop: Column, k: Column, first: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(stop[k - 1])
        # Commas stand between names.
        return F.transform(F.sequence(start * 2, stop[k] * 2 - 2), lambda i: F.when(i % 2 == 0, first + F.shiftright(i, 1)).otherwise(0))

    def placed(ends: Column) -> Column:
        return _let(F.filter(upto(F.size(ends)), lambda i: ends[i] % 2 == 1), lambda at: covered(ends, at))

    def covered(ends: Column, at: Column) -> Column:
        # The last A token that each B token meets: one that ends with it, or the one it ends within.
        return _let(F.transform(at, lambda p, j: p - j - F.when(F.get(ends, p - 1) == ends[p] - 1, 1).otherwise(0)), lambda last: parts(ends, at, last))

    def parts(ends: Column, at: Column, last: Column) -> Column:
        links = linked(last, lambda j: F.when(j == 0, 0).otherwise(at[j - 1] - j + 1))
        closing = F.filter(upto(F.size(b_end)), lambda j: F.get(ends, at[j] - 1) == ends[at[j]] - 1)
        return _let(closing, lambda closing: found(links, F.transform(closing, lambda j: last[j] + 1), F.transform(closing, lambda j: j + 1)))

    def short(cuts: Column, every: Column) -> Column:
        # As many A tokens end before the end of B token j as stand before it among all ends, less j.
        last = F.transform(b_end, lambda e, j: F.array_position(every, e).cast("int") - 1 - j)
        first = lambda last, j: F.when(j == 0, 0).otherwise(last[j - 1] + F.array_contains(cuts, b_end[j - 1]).cast("int"))
        stops = lambda ends: F.transform(cuts, lambda c: F.array_position(ends, c).cast("int"))
        return found(_let(last, lambda last: linked(last, lambda j: first(last, j))), stops(a_end), stops(b_end))

    # In few tokens a place is found by looking through them; in many, all places in one pass.
    few = _let(F.array_intersect(a_end, b_end), lambda cuts: _let(F.sort_array(F.concat(a_end, b_end)), lambda every: short(cuts, every)))
    return F.when(a_end == b_end, None).when(F.size(a_end) + F.size(b_end) <= SHORT, few).otherwise(_let(ends, placed))


def aligned(piece: Column, shapes: Column, pair) -> Column:
    """A piece's groups as text, and its links by ``pair`` of two ids."""
    a, b, shape = piece["a"], piece["b"], shapes[piece["shape"]]
    names = lambda ids: ids.cast("array<string>")
    # Where both end alike, each token is a group with its fellow.
    alike = F.array_join(F.zip_with(names(a), names(b), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    between = F.array(*map(F.lit, BETWEEN))
    text = _let(F.concat(between, names(a), names(b)), lambda names: F.array_join(F.transform(shape["written"], lambda i: names[i]), ""))
    links = F.transform(shape["links"], lambda x: pair(a[x["a"]], b[x["b"]]))
    one = lambda text, links: F.struct(text.alias("text"), links.alias("links"))
    return F.when(shape.isNull(), one(alike, F.zip_with(a, b, pair))).otherwise(one(text, links))


def alignment(docs: DataFrame, ids: list[str], first: str, second: str, text: str = "text") -> DataFrame:
    """How two tokenizers cut each text, and how usual the links between their tokens are.

    ``first`` is a byte-level vocabulary file, ``second`` a piece model file; each must be there on
    every executor.  Returns ``ids`` and ``n_a``, ``n_b`` (tokens), ``n_groups`` (runs between byte
    offsets where tokens of both end), ``n_links`` (token pairs that share bytes), ``n_best`` (links
    whose id pair no pair of the same B id exceeds corpus-wide), ``count_sum`` (corpus-wide links of
    the pair, over links) and ``groups_sha256``.

    Texts that are null, empty or not spelled again by both have no tokens: zeros and an empty digest.
    Rows stay one for one, repeated ones too; a text of any length is aligned whole.  An empty table
    gives no rows.  Columns beyond ``ids`` and ``text`` are not read; ``ids``
    must not be named like a result.
    """
    kinds = len(second_pieces(second))
    wide = "int" if kinds * len(first_pieces(first)) < 1 << 31 else "long"
    pair = lambda x, y: x.cast(wide) * F.lit(kinds).cast(wide) + y
    kept = [f"id_{i}" for i in range(len(ids))]

    def document(d: Column, own: Column) -> Column:
        digest = F.when(F.size(own) > 0, F.sha2(F.array_join(own["text"], ";"), 256)).otherwise("")
        return F.struct(*[d[c].alias(c) for c in [*kept, "row", "n_a", "n_b"]], digest.alias("digest"), F.flatten(own["links"]).alias("links"))

    tokens = tokenised(docs, ids, first, second, text)
    pieces = _let(F.transform("shapes", shaped), lambda shapes: F.transform("pieces", lambda p: aligned(p, shapes, pair)))
    whole = _let(pieces, lambda pieces: F.transform("docs", lambda d: _let(F.transform(d["at"], lambda i: pieces[i]), lambda own: document(d, own))))
    rows = stored(tokens.select(F.explode(whole).alias("d")).select("d.*"))

    links = rows.select("row", F.explode("links").alias("pair"))
    counts = links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.col("pair") % kinds)
    counts = stored(counts)
    # One row for each id of the second vocabulary, which bounds this side.
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    facts = counts.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    # The head: pairs of at least 2^k links, for the least k that leaves HEAD_PAIRS or fewer.
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= HEAD_PAIRS:
        least -= 1
        held += sizes.get(least, 0)
    in_head = F.floor(F.log2("n")) >= least
    head = F.broadcast(facts.where(in_head))
    summed = lambda x: x.groupBy("row").agg(F.sum("n").alias("n"), F.sum("best").alias("best"))
    sums = summed(links.join(head, "pair"))
    if least > 0:
        rest = links.join(head, "pair", "left_anti")
        sums = summed(sums.unionByName(summed(join_facts(rest, facts.where(~in_head), "pair"))))

    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    # A group of p and q tokens has p + q - 1 links.
    n_links = F.size("links").cast("long")
    counted = rows.select(*kept, "row", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - n_links).alias("n_groups"), n_links.alias("n_links"), "digest").join(sums, "row", "left")
    return counted.select(*[F.col(k).alias(c) for k, c in zip(kept, ids, strict=True)], "n_a", "n_b", "n_groups", "n_links", zero("best", "n_best"), zero("n", "count_sum"), F.col("digest").alias("groups_sha256"))
