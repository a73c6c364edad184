"""Readers of catalog files.

Everything goes through Spark's own readers, so paths may lie in any store that Spark opens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as keys


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Strict lines of JSON, gzip or plain: one bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def jsonl_lenient(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their file): bad lines are kept apart, blank ones skipped."""
    lines = spark.read.text(paths).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("path")).where("trim(line) <> ''")
    full = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    parsed = lines.withColumn("row", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.where(~bad).select("row.*", "path").drop("_bad"), parsed.where(bad).select("path", "line")


def csv_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Quoted CSV with a header; missing cells are empty texts."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths).na.fill("")


# The names under which files hold their list of rows, in order of preference.
CONTAINERS = ("docs", "rows", "records", "works", "items", "candidates", "data", "results", "subjects", "media", "entries")


def unwrapped(documents: DataFrame, text: str) -> DataFrame:
    """JSON texts as one JSON text for each row: the array itself, the first list among the known
    names, or the object alone."""
    doc = F.trim(F.col(text))
    listed = [F.when(doc.startswith("["), doc)] + [F.when(F.get_json_object(doc, f"$.{c}").startswith("["), F.get_json_object(doc, f"$.{c}")) for c in CONTAINERS]
    rows = F.from_json(F.coalesce(*listed, F.concat(F.lit("["), doc, F.lit("]"))), "array<string>")
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(rows).alias("row_index", text))


def files(spark: SparkSession, root: str, *, suffixes: tuple[str, ...] = ("json", "jsonl", "ndjson", "csv"), ignored: tuple[str, ...] = ("node_modules", ".git", "tmp"), most_json_bytes: int = 50_000_000) -> DataFrame:
    """path, bytes and modification time of the files below a folder that are to be read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), "modificationTime")
    below = F.element_at(F.split("path", re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + "/", 2), -1)
    name = F.lower(below)
    fits = name.rlike(r"\.(" + "|".join(map(re.escape, suffixes)) + ")$") & ~name.rlike("(^|/)(" + "|".join(map(re.escape, ignored)) + ")/")
    return listed.where(fits & ~(name.endswith(".json") & (F.col("bytes") > most_json_bytes)))


def source_hints(path: Column, hints: dict[str, str]) -> Column:
    """Names of the sources whose pattern the path matches, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(path).rlike(p), F.lit(k)) for k, p in hints.items()]))


def integrity(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, bytes, lines and SHA-256 of each file, read as a whole by one task."""
    whole = spark.read.format("binaryFile").load(paths)
    body = F.col("content")
    lines = F.length(body) - F.length(F.regexp_replace(F.decode(body, "ISO-8859-1"), "\n", ""))
    return whole.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), lines.cast("long").alias("lines"), F.sha2(body, 256).alias("sha256"))


def pick(document: Column, *paths: str) -> Column:
    """The first path of a JSON text that holds something other than blank."""
    return F.coalesce(*[keys.blank_to_null(F.get_json_object(document, f"$.{p}")) for p in paths])


def eligibility(rows: DataFrame, title: str, flags: dict[str, tuple[str, Column]]) -> DataFrame:
    """``status`` and ``reason`` by the first flag that holds (name: (status, condition)); a row without
    a title is excluded, any other eligible."""
    out = F.struct(F.lit("eligible").alias("status"), F.lit(None).cast("string").alias("reason"))
    for name, (status, condition) in reversed(flags.items()):
        out = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(name).alias("reason"))).otherwise(out)
    missing = keys.blank_to_null(F.col(title)).isNull()
    out = F.when(missing, F.struct(F.lit("excluded").alias("status"), F.lit("missing_title").alias("reason"))).otherwise(out)
    return rows.withColumn("eligible_of", out).select(*rows.columns, "eligible_of.status", "eligible_of.reason")


VALUE = re.compile(r"'((?:[^'\\]|\\.|'')*)'|(NULL)|([^,()'\s]+)|(\()|(\))", re.IGNORECASE | re.DOTALL)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a"}


def sql_dump(spark: SparkSession, paths: str | list[str], tables: dict[str, list[str]]) -> DataFrame:
    """Rows of the INSERT statements of a MySQL dump: table, row index in its statement, values.

    ``tables`` names the columns of the tables to read; ``values`` is a map from column to text, a
    NULL being absent.  Statements end with a semicolon and a line end.
    """
    statements = spark.read.option("lineSep", ";\n").text(paths).where(F.col("value").rlike(r"(?is)^\s*insert\s+into\s"))

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for statement in pdf["value"]:
                head = re.match(r"(?is)\s*insert\s+into\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*values\s*", statement)
                if not head or head[1] not in tables:
                    continue
                names = [n.strip(" `") for n in head[2].split(",")] if head[2] else tables[head[1]]
                values, index = None, 0
                for m in VALUE.finditer(statement, head.end()):
                    if m[4]:
                        values = []
                    elif m[5] and values is not None:
                        out.append((head[1], index, {k: v for k, v in zip(names, values) if v is not None}))
                        values, index = None, index + 1
                    elif values is not None:
                        values.append(re.sub(r"\\(.)|''", lambda e: "'" if e[1] is None else ESCAPES.get(e[1], e[1]), m[1], flags=re.DOTALL) if m[1] is not None else None if m[2] else m[3])
            yield pd.DataFrame(out, columns=["table", "row_index", "values"])

    return statements.select("value").mapInPandas(rows, "table string, row_index int, values map<string,string>")
