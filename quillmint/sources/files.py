"""Files in and out: sniffed CSV, report-style journals, spreadsheet-safe sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions.keys import safe_cell


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header whose separator (``, ; | tab``) is the commonest in its first line; all columns text.

    Bytes that are no UTF-8 mean Windows-1252; a byte-order mark does not reach the first name.
    """
    head = spark.read.text(path).limit(1).first()
    line = head["value"] if head else ""
    sep = max(",;\t|", key=line.count)
    broken = spark.read.text(path).where(F.col("value").contains("�")).limit(1).count() > 0
    read = spark.read.option("header", True).option("sep", sep).option("encoding", "windows-1252" if broken else "UTF-8").csv(path)
    return read.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in read.columns})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells cannot start formulas; decimals keep two places."""
    cells = [safe_cell(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields]
    df.select(*cells).write.option("header", True).csv(path)


def journal(lines: DataFrame, row: str, voucher: str) -> DataFrame:
    """A printed journal's continuation rows carry the voucher number of the row above them.

    ``row`` orders the rows within the file column ``file``; repeated page headers have ``voucher`` = 'Voucher'.
    """
    w = Window.partitionBy("file").orderBy(row)
    body = lines.where(F.coalesce(F.col(voucher) != "Voucher", F.lit(True)))
    return body.withColumn(voucher, F.last(F.nullif(F.trim(voucher), F.lit("")), ignorenulls=True).over(w)).where(F.col(voucher).isNotNull())
