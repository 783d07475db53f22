"""Journals that were printed as reports and saved as CSV: titles, split headers, page headers, continuation rows, totals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions.dates import order_of_dates, parsed_date, printed_amount
from quillmint.operators.carry import filled_in_blocks
from quillmint.sources.settled import settled

HEADER_ROWS = 30
# The report's standard columns, for files without a header, and the header's words.
STANDARD = {"document": 0, "company": 1, "date": 2, "account": 3, "description": 7, "debit": 9, "credit": 11, "remark": 13, "supplier": 15, "name": 16}
WORDS = {"company": "co", "date": "gldate", "account": "accountnumber", "description": "description", "debit": "debitamount", "credit": "creditamount", "remark": "remark", "name": "name"}
TOTAL = "grandtotal"


class Printed(NamedTuple):
    """A journal's lines, its vouchers, and one row a file: what was read, what was not, and whether the totals agree."""

    lines: DataFrame
    vouchers: DataFrame
    files: DataFrame


def report_rows(spark: SparkSession, path: str, width: int = 32) -> DataFrame:
    """Text files as (file, row, cells): rows numbered from 1 within a file that many tasks read, cells without quotes.

    A file's blocks are counted, so that a row's number is its place in the block plus the rows of the blocks before it.
    """
    text = spark.read.text(path)
    at = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    kept = settled(at)
    along = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kept.groupBy("file", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_id"))
    cells = F.from_csv("value", F.lit(", ".join(f"c{n} string" for n in range(width))), {"mode": "PERMISSIVE"})
    numbered = kept.withColumn("_place", place).join(blocks.select("file", "_block", "_before"), ["file", "_block"])
    return numbered.withColumn("_cells", cells).select("file", (F.col("_before") + F.col("_place")).alias("row"), F.array(*(F.col(f"_cells.c{n}") for n in range(width))).alias("cells"))


def _key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def _layout(keys: Column) -> Column:
    """The columns by a header's keys, from 0. Two columns may both be headed "number": the document's, before the
    company's, and the supplier's, the last one behind the credits."""
    at = {c: F.nullif(F.array_position(keys, w), F.lit(0)) - 1 for c, w in WORDS.items()}
    places = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda n: F.get(keys, n).isin("number", "documentnumber", "addressnumber"))
    at["document"] = F.coalesce(F.array_min(F.filter(places, lambda n: n < at["company"])), F.lit(STANDARD["document"]))
    at["supplier"] = F.array_max(F.filter(places, lambda n: n > at["credit"]))
    return F.struct(*(at[c].cast("int").alias(c) for c in STANDARD))


def _with_layouts(rows: DataFrame) -> DataFrame:
    """Rows with the layout that the file's first header gives, from the header's own row on; a file's one layout is broadcast."""
    above = Window.partitionBy("file").orderBy("row")  # of at most HEADER_ROWS rows a file
    top = rows.where(F.col("row") <= HEADER_ROWS).withColumn("_above", F.lag("cells").over(above))
    own = F.transform("cells", _key)
    split = F.transform("cells", lambda x, n: F.when(_key(x).isin("number", "amount"), F.concat(_key(F.get(F.coalesce("_above", F.array()), n)), _key(x))).otherwise(_key(x)))
    keys = F.when(F.array_contains(own, WORDS["account"]), own).when(F.array_contains(split, WORDS["account"]), split)
    joined = F.transform(keys, lambda k, n: F.when(k == "amount", F.concat(_key(F.get(F.coalesce("_above", F.array()), n)), k)).otherwise(k))
    found = top.withColumn("_keys", joined).withColumn("_nth", F.count("_keys").over(above))
    headed = found.where(F.col("_keys").isNotNull() & (F.col("_nth") == 1)).select(F.col("file").alias("_file"), F.col("row").alias("_from"), _layout(F.col("_keys")).alias("layout"))
    return rows.join(F.broadcast(headed), F.col("file").eqNullSafe(F.col("_file")) & (F.col("row") >= F.col("_from")), "left").select("file", "row", "cells", "layout")


def _cents(text: Column) -> Column:
    """An amount's cents; the ordinary form, with or without commas, is read by one pattern."""
    ordinary = text.rlike("^([0-9]{1,3}(,[0-9]{3})+|[0-9]*)\\.[0-9]{2}$")
    read = F.when(ordinary, F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(18,2)")).otherwise(printed_amount(F.regexp_replace(text, "^\\.", "0.")))
    return (read * 100).cast("long")


def read_printed(rows: DataFrame, payable: list[str], tax: list[str]) -> Printed:
    """Vouchers of printed journals, from rows (file, row, cells) numbered within their file.

    * a row with a point in its account is a line; where its document is filled it begins a voucher, which is known by
      its row's number, and rows after it with blank document, company and date go on with it, over page headers
    * a line without an amount that can be read, before any voucher, or neither first nor next, is unreadable
    * a row of amounts alone is a total; the last one that says so is the control total of the file's lines
    * ``payable`` and ``tax`` are the objects (second part of an account) of lines that the ledger added itself

    The voucher is carried along blocks of rows, so that a file is never one task. A file whose header
    lacks a column has a ``problem`` and no lines.
    """
    laid = _with_layouts(rows)
    cell = {c: F.trim(F.coalesce(F.get("cells", F.when(F.col("layout").isNull(), F.lit(p)).otherwise(F.col(f"layout.{c}"))), F.lit(""))) for c, p in STANDARD.items()}
    lacks = F.concat_ws(", ", *(F.when(F.col("layout").isNotNull() & F.col(f"layout.{c}").isNull(), c) for c in ("debit", "credit", "remark")))
    grand = F.when(~cell["account"].contains("."), F.exists("cells", lambda x: _key(x) == TOTAL))  # asked of totals alone
    some = F.exists("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    read = laid.select("file", "row", F.col("layout").isNotNull().alias("headed"), F.nullif(lacks, F.lit("")).alias("problem"), grand.alias("grand"), some.alias("some"), *(x.alias(c) for c, x in cell.items()))
    data = F.col("account").contains(".") & F.col("problem").isNull()
    head = F.when(data & (F.col("document") != ""), F.struct(F.col("row").alias("voucher"), "document", "company", "date"))
    amounts = {"d": F.when(F.col("debit") == "", 0).otherwise(_cents(F.col("debit"))), "c": F.when(F.col("credit") == "", 0).otherwise(_cents(F.col("credit")))}
    known = filled_in_blocks(read.withColumns({"data": data, "head": head, **amounts}), "file", "row", "head")

    parts = F.split("account", "\\.")
    typed = (F.col("debit") != "") | (F.col("credit") != "")
    sound = typed & F.col("d").isNotNull() & F.col("c").isNotNull()
    placed = F.col("head").isNotNull() & ((F.col("document") != "") | ((F.col("company") == "") & (F.col("date") == "")))
    line = F.trim(parts[0]).isin("") | F.trim(F.get(parts, F.lit(1))).isin("")
    kind = (
        F.when(F.col("data") & sound & placed & ~line, "line").when(F.col("data"), "unreadable").when(sound & ~F.col("account").contains("."), "total").when(F.col("some"), "title")
    )
    told = known.withColumn("kind", kind).where("kind is not null")

    post = F.trim(F.get(parts, F.lit(1)))
    lines = told.where("kind = 'line'").select(
        "file", "row", "head.voucher", F.col("head.document").alias("document"), F.col("head.company").alias("company"), F.col("head.date").alias("printed_date"), "account", "description", "remark", "supplier", "name",
        (F.col("d") - F.col("c")).alias("cents"), ((F.col("d") != 0) & (F.col("c") != 0)).alias("both_columns"), F.when(post.isin(*payable), "payable").when(post.isin(*tax), "tax").otherwise("coding").alias("posting"),
    )
    n = lambda k: F.count_if(F.col("kind") == k)
    is_line = F.col("kind") == "line"
    control = F.max(F.when((F.col("kind") == "total") & F.col("grand"), F.struct("row", "d", "c")))
    files = told.groupBy("file").agg(
        F.bool_or("headed").alias("headed"), F.max("problem").alias("problem"), n("line").alias("n_lines"), n("unreadable").alias("unreadable"), n("total").alias("total_rows"), n("title").alias("titles"),
        F.coalesce(F.sum(F.when(is_line, F.col("d"))), F.lit(0)).alias("debit"), F.coalesce(F.sum(F.when(is_line, F.col("c"))), F.lit(0)).alias("credit"), control.alias("control"),
        order_of_dates(F.when(F.col("data") & (F.col("document") != ""), F.col("date"))).alias("day_first"),
    )
    files = files.withColumn("differs", F.coalesce((F.col("control.d") != F.col("debit")) | (F.col("control.c") != F.col("credit")), F.lit(False)))

    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("row", c)))[c].alias(c)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("posting") == k, F.col("cents"))), F.lit(0))
    g = lines.groupBy("file", "voucher", "document", "company", "printed_date").agg(F.count("*").alias("n_lines"), F.sum("cents").alias("net"), (-of("payable")).alias("gross"), of("tax").alias("tax"), F.bool_or("both_columns").alias("both_columns"), first("supplier"), first("name"))
    dated = g.join(F.broadcast(files.select("file", "day_first")), "file")
    day = F.when(F.coalesce("day_first", F.lit(False)), parsed_date(F.col("printed_date"), True)).otherwise(parsed_date(F.col("printed_date"), False))
    vouchers = dated.withColumns({"gl_date": day, "balanced": F.abs("net") <= 1}).drop("printed_date", "day_first")
    return Printed(lines, vouchers, files.drop("control"))
