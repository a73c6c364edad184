"""BPE encoding and decoding through a table of distinct words.

1. *Split.*  Documents are read in blocks of about ``BLOCK_BYTES``.  A block's texts are split into
   words as the tokenizer splits them; the block keeps its distinct words and, for every text, the
   positions of its words in that list.
2. *Encode.*  Distinct words are dealt over the cluster by their hash, so that all blocks' copies of
   a word meet in one task, which runs the merges for it once.
3. *Join back.*  Each block gets the ids of its words again and puts them at their positions.
4. *Decode.*  A block's distinct ids are joined with the table from id to piece, at most one row for
   each entry of the vocabulary, and the pieces are put at the same positions.

Texts themselves are never shuffled: what moves is a block's position lists, a byte or two a word,
and its distinct words.  Lists are packed and compressed, since a row for every word would take
more room than the corpus.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import release, slices
from tessera.session import cut_lineage

#: UTF-8 bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Bytes of text for each task that distinct words are dealt to, and the most such tasks.
ENCODED_BYTES, MOST_PARTS = 16 << 20, 4096
#: Distinct words that a task remembers; past that it starts afresh.  So many are encoded in one call.
REMEMBERED, TOGETHER = 1 << 20, 1 << 12
#: Words of a batch of decoded documents: its numbers, pieces and texts lie in memory together.
BATCH_WORDS = 1 << 17
#: Code points below this are split by the pattern below, others by the tokenizer's own splitter.
PLAIN_END = 0x250


def _small(body: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(body, asbytes=True)


def _class(keep) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if keep(chr(c)))


def splitter():
    """Function from a text to its words, as the byte-level tokenizer of the vocabulary file splits."""
    letters = _class(lambda c: unicodedata.category(c)[0] == "L")
    numbers = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = _class(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
    # Fixed value: the split of this family of vocabularies.
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
    rare = re.compile(f"[{chr(PLAIN_END)}-\U0010ffff]")
    return words, rare


def _pack(*arrays: np.ndarray) -> bytes:
    """Lists of small numbers, compressed byte plane by byte plane."""
    parts = []
    for x in arrays:
        planes = np.ascontiguousarray(x.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
        parts += [len(x).to_bytes(8, "little"), planes]
    body = b"".join(parts)
    del parts
    return len(body).to_bytes(8, "little") + _small(body)


def _unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        planes = np.frombuffer(body, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 8 + 4 * n
    return out


def _pack_words(words: list[bytes]) -> bytes:
    lengths = _pack(np.fromiter(map(len, words), np.int64, len(words)))
    body = b"".join(words)
    return len(lengths).to_bytes(8, "little") + len(body).to_bytes(8, "little") + lengths + _small(body)


def _unpack_words(blob: bytes) -> list[str]:
    a, b = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    (lengths,) = _unpack(blob[16 : 16 + a])
    body = pa.decompress(blob[16 + a :], b, codec="zstd", asbytes=True) if b else b""
    ends = np.cumsum(lengths.astype(np.int64))
    return [body[s:e].decode() for s, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def _special(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def piece_rows(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of the whole vocabulary; byte-level pieces spell each byte by one printable letter."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rows = {i: bytes(letter[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return sorted((rows | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}).items())


def _split(ids: list[str], parts: int, path: str):
    """Arrow function from documents to one row for each block."""

    def run(batches):
        words, rare = splitter()
        own = None
        special = _special(path)
        cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        task, blocks = TaskContext.get().partitionId(), 0
        number: dict[str, int] = {}
        lists: list[np.ndarray] = []
        held: list[list[pa.Array]] = []
        size = 0

        def pieces(text: str) -> list[str]:
            nonlocal own
            if not text.isascii() and rare.search(text):
                own = own or _tokenizer(path)
                return [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)]
            return words.findall(text)

        def all_pieces(text: str) -> list[str]:
            if cut and any(s in text for s in special):
                return [w for i, x in enumerate(cut.split(text)) for w in ([x] if i % 2 else pieces(x))]
            return pieces(text)

        def row() -> pa.RecordBatch:
            nonlocal number, lists, held, size, blocks
            coded = [w.encode() for w in number]
            part = np.fromiter(map(zlib.crc32, coded), np.uint32, len(coded)) % parts
            # Words by falling frequency: small numbers are common ones and pack well.
            lengths, at = np.fromiter(map(len, lists), np.int64, len(lists)), np.concatenate(lists)
            lists = []
            order = np.argsort(-np.bincount(at, minlength=len(coded)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            part = part[order]
            by_part = order[np.argsort(part, kind="stable")]
            bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
            dealt = [{"p": p, "words": _pack_words([coded[i] for i in by_part[bounds[p] : bounds[p + 1]].tolist()])} for p in range(parts) if bounds[p] < bounds[p + 1]]
            at = rank[at] if number else at
            columns = [pa.array([(task << 32) + blocks])]
            for i in range(len(ids)):
                whole = pa.concat_arrays([h[i] for h in held])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole))
            columns += [pa.array([_pack(lengths, at, part)], pa.binary()), pa.array([dealt], pa.list_(pa.struct([("p", pa.int32()), ("words", pa.binary())])))]
            number, held, size = {}, [], 0
            blocks += 1
            return pa.RecordBatch.from_arrays(columns, ["block", *[f"id_{i}" for i in range(len(ids))], "at", "dealt"])

        for batch in batches:
            for chunk in slices(batch, "text_of", BLOCK_BYTES // 4):
                more = pc.sum(pc.binary_length(chunk.column("text_of"))).as_py() or 0
                if lists and size + more > BLOCK_BYTES:
                    yield row()
                    release()
                for x in chunk.column("text_of").to_pylist():
                    found = all_pieces(x) if x else []
                    lists.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
                held.append([chunk.column(f"id_{i}") for i in range(len(ids))])
                size += more
        if lists:
            yield row()
        own = None
        release()

    return run


def _encode(path: str):
    """Arrow function from (block, p, words) to (block, p, ids): each word is encoded when first met."""

    def run(batches):
        tok, known = _tokenizer(path), {}  # ids as packed bytes: lists of numbers take several times their room
        for batch in batches:
            for block, p, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "p", "words")), strict=True):
                words = _unpack_words(blob)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, words
                for at in range(0, len(new), TOGETHER):
                    some = new[at : at + TOGETHER]
                    known.update(zip(some, (array("I", e.ids).tobytes() for e in tok.encode_batch(some, add_special_tokens=False)), strict=True))
                ids = [known[w] for w in words]
                packed = _pack(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([p], pa.int32()), pa.array([packed], pa.binary())], ["block", "p", "ids"])
        del tok, known
        release()

    return run


def _joined(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids and ids of a block's words, part by part."""
    both = [_unpack(x["ids"]) for x in sorted(parts, key=lambda x: x["p"])]
    return tuple(np.concatenate([b[i] for b in both] or [np.empty(0, np.uint32)]).astype(np.int64) for i in (0, 1))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _used(parts: pd.Series) -> pd.Series:
    """The distinct ids of each block."""
    return parts.map(lambda x: np.unique(_joined(list(x))[1]).astype(np.int32))


def _assemble(count: int, names: list[str]):
    """Arrow function from a block with its ids and pieces to its documents."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, at, part = _unpack(batch.column("at")[r].as_py())
                dealt, ids = _joined(batch.column("parts")[r].as_py() or [])
                place = np.argsort(part, kind="stable")
                numbers, ends = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
                numbers[place], ends[place] = dealt, np.cumsum(dealt)
                starts = ends - numbers
                del part, place, dealt
                found = batch.column("pieces")[r].values
                piece = dict(zip(found.field("id").to_pylist(), found.field("piece").to_pylist(), strict=True)) if found is not None else {}
                spelled = [piece[i] for i in ids.tolist()]
                word = [b"".join(spelled[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                del spelled, piece, ends
                last = np.cumsum(lengths.astype(np.int64)).tolist()
                columns = [batch.column(f"id_{i}")[r].values for i in range(count)]
                first = 0
                while first < len(last):
                    start = last[first - 1] if first else 0
                    stop = max(first + 1, int(np.searchsorted(last, start + BATCH_WORDS, side="right")))
                    own = at[start : last[stop - 1]].astype(np.int64)
                    many = numbers[own]
                    upto = np.cumsum(many)
                    tokens = ids[np.repeat(starts[own] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
                    marks = np.array([0, *(x - start for x in last[first:stop])])
                    offsets = np.concatenate(([0], upto))[marks]
                    texts, own = [], own.tolist()
                    for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                        texts.append(b"".join([word[w] for w in own[a:b]]).decode("utf-8", "replace"))
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))
                    yield pa.RecordBatch.from_arrays([c.slice(first, stop - first) for c in columns] + [lists, pa.array(texts, pa.string())], [*names, "tokens", "decoded"])
                    first = stop
                release()

    return run


def round_trip(docs: DataFrame, ids: list[str], path: str, text: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text that they decode to.

    Returns ``ids``, ``tokens`` (array of int) and ``decoded``.  The ids are those that the
    tokenizers library gives for the vocabulary file at ``path`` (byte-level BPE, no special tokens
    added; the file's own special tokens are recognised in texts).  Null and empty texts have no
    tokens and decode to the empty text.  Rows, repeated ones too, stay one for one; columns beyond
    ``ids`` and ``text`` are not read, and ``ids`` must not be named like a result.  The file must be at ``path`` on every executor.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(MOST_PARTS, max(8, -(-size // ENCODED_BYTES)))
    rows = docs.select(*[F.col(c).alias(f"id_{i}") for i, c in enumerate(ids)], F.col(text).alias("text_of"))
    kinds = [docs.schema[c].dataType for c in ids]
    dealt = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("words", T.BinaryType())]))
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(f"id_{i}", T.ArrayType(k)) for i, k in enumerate(kinds)], T.StructField("at", T.BinaryType()), T.StructField("dealt", dealt)])
    blocks = cut_lineage(rows.mapInArrow(_split(ids, parts, path), schema))
    wide = min(20_000, max(1, 2 * blocks.count()))  # so that a task gets a block or two, however many there are

    words = blocks.select("block", F.explode("dealt").alias("d")).select("block", "d.p", "d.words")
    encoded = words.repartition(parts, "p").mapInArrow(_encode(path), "block long, p int, ids binary")
    # Dealt by block from here on: what follows needs no further shuffle of it.
    encoded = encoded.repartition(wide, "block").groupBy("block").agg(F.collect_list(F.struct("p", "ids")).alias("parts"))

    pieces = spark.createDataFrame(pa.Table.from_pylist([{"id": i, "piece": b} for i, b in piece_rows(path)], pa.schema([("id", pa.int32()), ("piece", pa.binary())])))
    used = encoded.select("block", F.explode(_used("parts")).alias("id"))
    # The vocabulary bounds this side: one row for each of its entries.
    spelled = used.join(F.broadcast(pieces), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))

    whole = blocks.drop("dealt").repartition(wide, "block").join(encoded, "block", "left").join(spelled, "block", "left")
    out = T.StructType([*[T.StructField(c, k) for c, k in zip(ids, kinds, strict=True)], T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return whole.mapInArrow(_assemble(len(ids), ids), out)
