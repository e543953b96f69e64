"""Readers: tab-separated text, ARFF, and any Spark source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated file with a header; give a schema to avoid the pass that infers it."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def arff_schema(lines) -> list[tuple[str, str]]:
    """(name, Spark type) of the attributes in an ARFF header: numbers as double, integers as long, others as string."""
    out = []
    for line in lines:
        m = re.match(r"(?i)^\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*?)\s*$", line)
        if m:
            kind = m[2].lower()
            out.append((m[1].strip("'\""), "bigint" if kind.startswith("integer") else "double" if kind.startswith(("real", "numeric")) else "string"))
        if re.match(r"(?i)^\s*@data", line):
            break
    return out


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file: the header gives the schema, rows are parsed by Spark's CSV expression; ``?`` is missing."""
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.filter(F.lower(F.trim("value")).startswith("@")).collect()]
    columns = arff_schema(head)
    text = F.trim("value")
    rows = lines.filter((text != "") & ~text.startswith("%") & ~text.startswith("@"))
    schema = ", ".join(f"`{n}` string" for n, _ in columns)
    options = {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": "?"}
    parsed = rows.select(F.from_csv(text, schema, options).alias("r")).select("r.*")
    return parsed.select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in columns))


def read_any(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any source that Spark reads, as a task's data."""
    return spark.read.format(kind).options(**options).load(path)
