"""Writers. Tables are Parquet; CSV and JSON lines are for exchange, reports for reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ragmill.operators.results import flatten_record
from ragmill.sources.store import write_text


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def chunks(df: DataFrame, path: str) -> None:
    """Chunks with their length; the length-sorted order is a column away, no second copy."""
    df.withColumn("n_chars", F.length("text")).write.mode("overwrite").partitionBy("experiment").parquet(path)


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("experiment").parquet(path)


def metadata(values: dict, path: str) -> None:
    """A JSON file of its own beside a table, on whatever store ``path`` names."""
    write_text(SparkSession.active(), path, json.dumps(values, ensure_ascii=False, indent=2, default=str))


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", "\t" if sep == "\\t" else sep).csv(path)


def detailed_results(df: DataFrame, folder: str, stamp: str) -> DataFrame:
    """Nothing is written for an empty table."""
    if not df.isEmpty():
        csv(df, f"{folder}/{stamp}_detailed_results.csv")
    return df


def records_csv(df: DataFrame, path: str, sep: str = ",", most_gold: int = 3) -> int:
    """Flattened records in a fixed column order; returns their number, counted while they are written."""
    seen = Observation()
    csv(flatten_record(df, most_gold).observe(seen, F.count("*").alias("n")), path, sep)
    return seen.get["n"]


def report(sections: dict[str, DataFrame], most: int = 100) -> str:
    """Small aggregates as Markdown; of a longer one the first ``most`` rows, and how many more there are."""
    out = []
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    for title, df in sections.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:most])]
        if len(rows) > most:
            out.append(f"\n{df.count() - most} more rows are not shown.")
        out.append("")
    return "\n".join(out)
