"""Printed journals: the ledger's lines as a report prints them, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.sources import tables as T
from quillmint.sources.printed import Printed, read_printed
from quillmint.sources.settled import settled

HEADS = (
    ("Document", "", "", "", "", "", "", "", "", "", "", "", "", "", "", "Address"), ("Number", "Co", "G/L Date", "Account Number", "", "", "", "Description", "", "Debit Amount", "", "Credit Amount", "", "Remark", "", "Number", "Name"),
)


def printed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Five files (orders by number) of an order a voucher: titles, a header in two rows but in file 4, columns moved by
    one in file 3, dates day first in file 1, page headers within vouchers, some amounts that cannot be read, and a
    control total that is a cent off in file 2."""
    l = T.lines(spark, sf, parts=False)
    signed = (F.col("amount") * 100).cast("long") * F.when(F.col("return_flag") == "R", -1).otherwise(1)
    own = l.select("invoice_id", "line_number", "vendor_id", "line_date", signed.alias("signed")).repartition("invoice_id").groupBy("invoice_id", "line_number")
    own = own.agg(F.sum("signed").alias("cents"), F.min("vendor_id").alias("vendor"), F.min("line_date").alias("date"))
    order = settled(own.groupBy("invoice_id").agg(
        F.sum("cents").alias("total"), F.min("line_number").alias("first"), F.min_by("vendor", "line_number").alias("payee"), F.min("date").alias("date"), F.collect_list(F.struct("line_number", "cents", "vendor")).alias("own")
    ))
    place = (100 + F.floor(F.col("invoice_id") / 5) * 20).cast("long")
    file = (F.col("invoice_id") % 5).cast("int")

    def money(cents):
        return F.regexp_replace(F.format_number(cents / 100, 2), "^0\\.", ".")

    def printed(rows: DataFrame, row, first, account, cents, text) -> DataFrame:
        date = F.when(file == 1, F.date_format("date", "d/M/yyyy")).otherwise(F.date_format("date", "M/d/yyyy"))
        blank = F.lit("")
        head = [F.when(first, F.lit("PV")).otherwise(blank), F.when(first, F.lit("00010")).otherwise(blank), F.when(first, date).otherwise(blank)]
        debit, credit = F.when(cents >= 0, text).otherwise(blank), F.when(cents < 0, text).otherwise(blank)
        cells = [*head, account, blank, blank, blank, F.lit("Expense"), blank, debit, blank, credit, blank, F.lit("by hand"), blank, F.when(first, F.col("payee").cast("string")).otherwise(blank), blank]
        return rows.select(file.alias("file"), row.alias("row"), F.array(*(c.cast("string") for c in cells)).alias("cells"))

    wrong = (F.col("invoice_id") % 97 == 0) & (F.col("line_number") == 2)
    lines = order.select("invoice_id", "total", "first", "payee", "date", F.inline("own"))
    posted = printed(lines, place + 2 * F.col("line_number"), F.col("line_number") == F.col("first"), F.concat_ws(".", F.col("vendor") % 9 + 1, F.lit("5200"), "line_number"), F.col("cents"), F.when(wrong, F.lit("n/a")).otherwise(money(F.abs("cents"))))
    owed = printed(order, place + 18, F.lit(False), F.lit("1.4110"), -F.col("total"), money(F.abs("total")))
    number = F.floor(F.col("invoice_id") / 5)
    again = F.array(*map(F.lit, HEADS[1]))
    pages = order.where(number % 10 == 3).select(file.alias("file"), (place + 5).alias("row"), again.alias("cells"))
    sums = lines.where(~wrong).select(file.alias("file"), "cents").unionByName(order.select(file.alias("file"), (-F.col("total")).alias("cents"))).groupBy("file")
    totals = settled(sums.agg(F.sum(F.when(F.col("cents") >= 0, F.col("cents")).otherwise(0)).alias("debit"), F.sum(F.when(F.col("cents") < 0, -F.col("cents")).otherwise(0)).alias("credit")))
    off = F.when(F.col("file") == 2, 1).otherwise(0)
    blanks = lambda n: [F.lit("")] * n
    grand = totals.select("file", F.lit(1 << 60).alias("row"), F.array(F.lit("Grand Total"), *blanks(8), money(F.col("debit") + off), F.lit(""), money(F.col("credit"))).alias("cells"))
    tops = [(f, n, ["Transaction Journal", f"page {n}"]) for f in range(5) for n in range(1, 6)] + [(f, 6 + n, list(h)) for f in range(4) for n, h in enumerate(HEADS)]
    top = spark.createDataFrame(tops, "file int, row long, cells array<string>").join(totals.select("file"), "file", "left_semi")
    rows = posted.unionByName(owed).unionByName(pages).unionByName(grand).unionByName(top)
    moved = F.when(F.col("file") == 3, F.concat(F.array(F.lit("")), "cells")).otherwise(F.col("cells"))
    return rows.select(F.concat(F.lit("journal "), F.col("file")).alias("file"), "row", moved.alias("cells"))


def journals(spark: SparkSession, sf: str) -> Printed:
    return read_printed(printed_rows(spark, sf), ["4110"], ["4250"])


def printed_vouchers(spark: SparkSession, sf: str) -> DataFrame:
    """The vouchers of the printed journals: what they add up to, and whether they balance. A supplier is printed on the first row, and
    not known where that cannot be read."""
    v = journals(spark, sf).vouchers
    return v.select("file", ((F.col("voucher") - 100) / 20).cast("long").alias("number"), "document", "company", "gl_date", F.col("supplier").cast("long").alias("supplier"), "n_lines", "net", "gross", "balanced")


BASE = """with own as (select l_orderkey as o, l_linenumber as n, sum(cast(round(cast(l_extendedprice as decimal(18,2)) * 100) as bigint) * case when l_returnflag = 'R' then -1 else 1 end) as cents,
    min(l_suppkey) as vendor, min(cast(l_shipdate as date)) as date from lineitem group by 1, 2),
  bad as (select *, o % 97 = 0 and n = 2 as wrong from own),
  v as (select o, cast(sum(cents) as bigint) as total, cast(coalesce(sum(cents) filter (wrong), 0) as bigint) as lost, count(*) filter (not wrong) + 1 as n_lines, case when not arg_min(wrong, n) then arg_min(vendor, n) end as payee, min(date) as date from bad group by 1)"""

PRINTED_VOUCHERS = f"""{BASE} select 'journal ' || (o % 5) as file, o // 5 as number, 'PV' as document, '00010' as company, date as gl_date, payee as supplier, n_lines,
  -lost as net, total as gross, abs(lost) <= 1 as balanced from v"""


def printed_journals(spark: SparkSession, sf: str) -> DataFrame:
    """A row a printed file: lines, rows that were not read, and whether the control total agrees."""
    return journals(spark, sf).files.select("file", "headed", "n_lines", "unreadable", "total_rows", "titles", "debit", "credit", "differs", "problem")


PRINTED_JOURNALS = f"""{BASE}, a as (select o, cents, wrong from bad union all select o, -total, false from v),
  f as (select o % 5 as f, count(*) filter (not wrong) as n_lines, count(*) filter (wrong) as unreadable, cast(coalesce(sum(cents) filter (not wrong and cents >= 0), 0) as bigint) as debit,
    cast(coalesce(-sum(cents) filter (not wrong and cents < 0), 0) as bigint) as credit from a group by 1),
  p as (select o % 5 as f, count(*) filter ((o // 5) % 10 = 3) as pages from v group by 1)
  select 'journal ' || f as file, f < 4 as headed, n_lines, unreadable, cast(1 as bigint) as total_rows, 5 + case when f < 4 then 2 else 0 end + pages as titles, debit, credit, f = 2 as differs,
    cast(null as varchar) as problem from f join p using (f)"""

QUERIES = [("printed_vouchers", printed_vouchers, PRINTED_VOUCHERS), ("printed_journals", printed_journals, PRINTED_JOURNALS)]
