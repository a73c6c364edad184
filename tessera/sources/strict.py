"""Files read byte by byte: digests and receipts tied to the read, and JSON lines that must be canonical.

Spark lists the files and deals them to tasks.  Files of up to ``WHOLE_BYTES`` come as Spark reads them,
so from any store that it opens; larger ones are streamed in pieces through pyarrow's file systems, so no
file, however large, lies in one row or in memory.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are streamed; bytes of a piece; lines of a batch of rows.
WHOLE_BYTES, PIECE, BATCH = 64 << 20, 4 << 20, 4096
BOM = b"\xef\xbb\xbf"


class Fault(Exception):
    """What is wrong with a file, as one word."""


def _listed(spark: SparkSession, paths: str | list[str], whole: int) -> DataFrame:
    """path, length and content of files; content is null for files to be streamed."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    small = every.where(F.col("length") <= whole).select("path", "length", "content")
    # Spark's scan passes over empty files; its list of files, which the driver has anyway, names them.
    names = [re.sub(r"^file:/+", "file:/", unquote(x)) for x in every.inputFiles()]
    named = spark.createDataFrame(pa.table({"path": pa.array(names, pa.string())}))
    empty = named.join(every.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return small.unionByName(empty).unionByName(every.where(F.col("length") > whole).select("path", "length", F.lit(None).cast("binary").alias("content")))


def _pieces(path: str, content: bytes | None) -> Iterator[bytes]:
    if content is not None:
        for at in range(0, len(content), PIECE):
            yield content[at : at + PIECE]
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    with store.open_input_stream(inner, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def _unpacked(pieces: Iterator[bytes], most: int | None) -> Iterator[bytes]:
    """Content of a gzip file of one or more members, piece by piece; a fault past ``most`` bytes."""
    packed, total, started = zlib.decompressobj(31), 0, False
    for piece in pieces:
        while piece:
            if packed.eof:
                packed = zlib.decompressobj(31)
            started = True
            try:
                out = packed.decompress(piece, PIECE)
            except zlib.error:
                raise Fault("bad_gzip") from None
            total += len(out)
            if most is not None and total > most:
                raise Fault("unpacked_too_large")
            if out:
                yield out
            piece = packed.unused_data if packed.eof else packed.unconsumed_tail
    if not started or not packed.eof:
        raise Fault("bad_gzip")


def _relative(path: Column, root: str) -> Column:
    """A path below a root, or the path itself; both may or may not name their store."""
    bare = lambda x: re.sub(r"^\w+:/*", "/", x).rstrip("/") + "/"
    plain = F.regexp_replace(path, r"^\w+:/*", "/")
    return F.when(plain.startswith(bare(root)), F.substring(plain, F.lit(len(bare(root)) + 1), F.length(plain))).otherwise(path)


def receipts(spark: SparkSession, paths: str | list[str], root: str, *, most_unpacked: int | None = None, whole: int = WHOLE_BYTES) -> DataFrame:
    """``file`` (below ``root``), ``bytes``, ``sha256``, ``lines``, ``unpacked_bytes``, ``unpacked_sha256`` and ``fault``.

    A file is read once, in pieces, through all its digests.  Lines are those of the content, unpacked where
    the name ends in .gz; a last line counts without its end too.  ``fault`` is bad_gzip, or
    unpacked_too_large where a gzip file holds more than ``most_unpacked`` bytes: it is read no further
    then, and its figures are null but for the bytes.
    """

    def read(batches):
        for batch in batches:
            for path, length, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                outer, inner, lines, size, last, fault = hashlib.sha256(), hashlib.sha256(), 0, 0, b"\n", None

                def seen(outer=outer, path=path, content=content):
                    for piece in _pieces(path, content):
                        outer.update(piece)
                        yield piece

                try:
                    for piece in _unpacked(seen(), most_unpacked) if path.endswith(".gz") else seen():
                        inner.update(piece)
                        size, lines, last = size + len(piece), lines + piece.count(b"\n"), piece[-1:]
                except Fault as e:
                    fault = str(e)
                row = [path, length, None, None, None, None, fault] if fault else [path, length, outer.hexdigest(), lines + (last != b"\n"), size, inner.hexdigest(), None]
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["path", "bytes", "sha256", "lines", "unpacked_bytes", "unpacked_sha256", "fault"])

    schema = "path string, bytes long, sha256 string, lines long, unpacked_bytes long, unpacked_sha256 string, fault string"
    out = _listed(spark, paths, whole).mapInArrow(read, schema)
    return out.select(_relative(F.col("path"), root).alias("file"), *out.columns[1:])


def streamed_digest(rows: DataFrame, line: Column, *order: Column) -> DataFrame:
    """``n`` and ``sha256`` of the lines in order, each with an LF behind it.

    A digest is of one stream, so all lines pass one task, which sorts them with room on disk and holds
    none.  Give it short lines: keys and digests.
    """
    named = rows.select(line.alias("line"), *[o.alias(f"order_{i}") for i, o in enumerate(order)])
    ordered = named.repartition(1).sortWithinPartitions(*[f"order_{i}" for i in range(len(order))]).select("line")

    def digest(batches):
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                whole.update((x or "").encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.hexdigest()])], ["n", "sha256"])

    return ordered.mapInArrow(digest, "n long, sha256 string")


def root_receipt(found: DataFrame) -> DataFrame:
    """One digest for all files of ``receipts``: of their lines "sha256  file", by file name."""
    return streamed_digest(found, F.concat_ws("  ", "sha256", "file"), F.col("file"))


def document_set_digest(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """``n`` and SHA-256 of a set of documents: key, tab and digest of each, shorter keys first."""
    text = F.col(key).cast("string")
    return streamed_digest(rows, F.concat(text, F.lit("\t"), F.col(digest)), F.length(text), text)


def checked(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files against a list of file, bytes and sha256 (and lines, if it has them): ``status`` is same, changed, missing or extra."""
    facts = [c for c in ("bytes", "sha256", "lines") if c in expected.columns]
    a, b = found.select("file", F.struct(*facts).alias("is")), expected.select("file", F.struct(*[F.col(c).cast(found.schema[c].dataType).alias(c) for c in facts]).alias("should"))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "extra").when(F.col("is").eqNullSafe(F.col("should")), "same").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def canonical(value) -> bytes:
    """JSON with sorted keys, no white space, and characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def content_id(field: str, prefix: str) -> Callable[[dict], bool]:
    """Check that an object's ``field`` is prefix and SHA-256 of its canonical JSON without the field."""
    return lambda x: x.get(field) == prefix + hashlib.sha256(canonical({k: v for k, v in x.items() if k != field})).hexdigest()


def _no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Fault("repeated_key")
    return out


def _line_fault(line: bytes, fields: frozenset[str] | None, must: bool, right: Callable[[dict], bool] | None) -> str | None:
    if not line:
        return "blank_line"
    if b"\r" in line:
        return "carriage_return"
    try:
        value = json.loads(line.decode(), object_pairs_hook=_no_repeats, parse_constant=lambda x: (_ for _ in ()).throw(Fault("not_json")))
        if not isinstance(value, dict):
            return "not_an_object"
        if must and canonical(value) != line:
            return "not_canonical"
    except UnicodeError:
        return "not_utf8"
    except Fault as e:
        return str(e)
    except (ValueError, RecursionError):
        return "not_json"
    if fields is not None and set(value) != fields:
        return "other_fields"
    return None if right is None or right(value) else "other_id"


def strict_lines(spark: SparkSession, paths: str | list[str], *, fields: list[str] | None = None, must_be_canonical: bool = True, right: Callable[[dict], bool] | None = None, bom: bool = False, most_unpacked: int | None = None, whole: int = WHOLE_BYTES) -> DataFrame:
    """``path``, ``line`` (from 1), ``text`` and ``fault`` (null if there is none) of all lines of JSON objects.

    Lines end in LF, the last one too, and hold one object of the given fields, as canonical JSON, for
    which ``right`` holds.  Faults: empty_file, no_final_line_end, carriage_return, blank_line, not_utf8,
    not_json, repeated_key, not_an_object, not_canonical, other_fields, other_id, byte_order_mark (unless
    ``bom`` takes it off), and those of unpacking, at the line where reading ends.  Text that is not UTF-8
    is null.  A task holds one line and one piece of its file.
    """
    names = frozenset(fields) if fields is not None else None

    def lines_of(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
        rest: list[bytes] = []
        for piece in pieces:
            head, *more = piece.split(b"\n")
            rest.append(head)
            for x in more:
                yield b"".join(rest), True
                rest = [x]
        if any(rest):
            yield b"".join(rest), False

    def rows_of(path: str, content: bytes | None) -> Iterator[tuple]:
        n = 0
        try:
            pieces = _pieces(path, content)
            for line, ended in lines_of(_unpacked(pieces, most_unpacked) if path.endswith(".gz") else pieces):
                n += 1
                marked = n == 1 and line.startswith(BOM)
                line = line[len(BOM) :] if marked else line
                fault = "byte_order_mark" if marked and not bom else _line_fault(line, names, must_be_canonical, right) or (None if ended else "no_final_line_end")
                yield path, n, None if fault == "not_utf8" else line.decode("utf-8", "replace"), fault
            if n == 0:
                yield path, 0, None, "empty_file"
        except Fault as e:
            yield path, n + 1, None, str(e)

    def read(batches):
        held: list[tuple] = []

        def sent():
            types = [pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], ["path", "line", "text", "fault"])

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for row in rows_of(path, content):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield sent()
                        held = []
        if held:
            yield sent()

    return _listed(spark, paths, whole).mapInArrow(read, "path string, line long, text string, fault string")


def first_fault(lines: DataFrame) -> str | None:
    """File, line and kind of the first fault, files by name."""
    row = lines.where("fault is not null").agg(F.min(F.struct("path", "line", "fault")).alias("x")).first()
    return None if row["x"] is None else f"{row['x']['path']}: line {row['x']['line']}: {row['x']['fault']}"


def strict_jsonl(spark: SparkSession, paths: str | list[str], schema: str, **rules) -> DataFrame:
    """Rows of ``strict_lines`` by ``schema``; any fault is an error that names the first one.

    The files are read once for the check and once for the rows.
    """
    lines = strict_lines(spark, paths, **rules)
    if fault := first_fault(lines):
        raise ValueError(fault)
    return lines.select(F.from_json("text", schema).alias("r")).select("r.*")
