"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, one is made if driver and executors are one process (tests, a laptop); on a
    cluster that is an error, since executors would not see each other's folders.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table: columns are compressed and read singly."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the standard Parquet tables below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = 25_000) -> DataFrame:
    """The rows of ``df`` dealt by ``key`` to tasks of about ``rows`` rows.

    A compressed file has one task for a row group of a million short rows, too many for a costly step;
    a number given by hand is one that adaptive execution does not merge again.
    """
    return df.repartition(min(20_000, max(1, -(-df.count() // rows))), key)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
