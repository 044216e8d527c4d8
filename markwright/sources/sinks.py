"""Writers: partitioned Parquet, JSON lines, CSV and TSV, sidecars and reports."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def parquet(df: DataFrame, path: str, by: str | None = "dataset") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def json_lines(df: DataFrame, path: str, first: int | None = None, key: str = "row_id") -> None:
    """All rows, or the first by ``key``."""
    (df.orderBy(key).limit(first) if first else df).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One file of a small report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def sidecar(df: DataFrame, features: list[str] = ()) -> dict:
    """Counts per split, coverage and all-null columns, and a sample row, from two small jobs."""
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in features]).first().asDict()
    n = row.pop("n")
    first = df.limit(1).collect()
    return {"n_rows": n, "splits": counts, "coverage": {c: (v / n if n else None) for c, v in row.items()}, "all_null": sorted(c for c, v in row.items() if not v), "sample": first[0].asDict() if first else None}


def clean(value):
    """A JSON document without NaN or infinities: they become null."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def report(document: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(clean({"schema_version": SCHEMA_VERSION} | document), f, indent=2, sort_keys=True, default=str)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table; undefined values show as a dash."""
    show = lambda v: "—" if v is None or (isinstance(v, float) and not math.isfinite(v)) else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)])
