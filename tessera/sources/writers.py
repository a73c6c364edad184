"""Writers of releases and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    df.write.option("compression", "gzip" if gzip else "none").json(path)


def write_split(df: DataFrame, path: str, by: Column, name: str = "part") -> None:
    """The same rows in one folder for each value of ``by``."""
    df.withColumn(name, by).write.partitionBy(name).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(counts: dict[str, DataFrame], title: str, most: int = 50) -> str:
    """A Markdown report of small tables, ``most`` rows of each."""
    out = [f"# {title}", ""]
    for name, df in counts.items():
        rows = df.limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def children(rows: DataFrame, key: str, array: str) -> DataFrame:
    """An array column as a child table: key, ordinal from 0, and the item's fields or value."""
    each = rows.select(key, F.posexplode(array).alias("ordinal", "item"))
    return each.select(key, "ordinal", "item.*") if each.schema["item"].dataType.typeName() == "struct" else each


def content_addressed(rows: DataFrame, prefix: str, *parts: Column) -> DataFrame:
    """Adds ``content_id``: prefix:sha256 of the parts."""
    return rows.withColumn("content_id", F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)))
