"""Spend, vendor and tax aggregates over invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions.money import half_up, out, split_in_proportion
from quillmint.sources import tables as T

RATES = {"AFRICA": "0.071500", "AMERICA": "1.372500", "ASIA": "0.009200", "EUROPE": "1.489100"}


def spend_by(lines: DataFrame, key: str) -> DataFrame:
    """Total, lines, distinct invoices and first position of each key value."""
    position = F.col("invoice_id") * 65536 + F.col("line_number")
    return lines.groupBy(key).agg(
        F.sum("amount").alias("total"), F.count("*").alias("n_lines"), F.count_distinct("invoice_id").alias("n_invoices"), F.min(position).alias("first_position")
    )


def _spend(key: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return spend_by(T.lines(spark, sf), key).withColumn("total", out(F.col("total")))

    sql = f"""select {key}, cast(sum(amount) as double) as total, count(*) as n_lines, count(distinct invoice_id) as n_invoices,
      min(invoice_id * 65536 + line_number) as first_position from {T.LINES} group by {key}"""
    return query, sql


def spend_by_month_category(spark: SparkSession, sf: str) -> DataFrame:
    """Spend by month and category, lines without a category in a bucket of their own."""
    l = T.lines(spark, sf)
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorised"))
    return l.groupBy(F.date_format("line_date", "yyyy-MM").alias("month"), category.alias("category")).agg(out(F.sum("amount")).alias("total"), F.count("*").alias("n_lines"))


SPEND_BY_MONTH_CATEGORY = f"""select strftime(line_date, '%Y-%m') as month, coalesce(nullif(category, ''), 'Uncategorised') as category,
  cast(sum(amount) as double) as total, count(*) as n_lines from {T.LINES} group by 1, 2"""


def currencies_by_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Currencies (here countries) ranked by absolute spend, credits counting as much as charges."""
    signed = F.when(F.col("return_flag") == "R", -F.col("amount")).otherwise(F.col("amount"))
    l = T.lines(spark, sf).withColumn("signed", signed).join(T.vendors(spark, sf).select("vendor_id", "country"), "vendor_id")
    total = l.groupBy("country").agg(F.sum(F.abs("signed")).alias("absolute"), F.sum("signed").alias("net"))
    return total.select("country", out(F.col("absolute")).alias("absolute"), out(F.col("net")).alias("net"), F.row_number().over(Window.orderBy(F.desc("absolute"), "country")).alias("rank"))


CURRENCIES_BY_SPEND = f"""with l as (select v.country, case when return_flag = 'R' then -amount else amount end as signed from {T.LINES} l join {T.VENDORS} v using (vendor_id)),
  g as (select country, sum(abs(signed)) as absolute, sum(signed) as net from l group by country)
  select country, cast(absolute as double) as absolute, cast(net as double) as net, cast(row_number() over (order by absolute desc, country) as integer) as rank from g"""


def spend_converted(spark: SparkSession, sf: str) -> DataFrame:
    """Spend per country and month in the home currency: each line converted and rounded, then added; no rate, no row."""
    rates = spark.createDataFrame(list(RATES.items()), "country string, rate string").select("country", F.col("rate").cast("decimal(18,6)").alias("rate"))
    l = T.lines(spark, sf).join(T.vendors(spark, sf).select("vendor_id", "country"), "vendor_id").join(F.broadcast(rates), "country")
    home = half_up(F.col("amount") * F.col("rate")).cast("decimal(18,2)")
    return l.groupBy("country", F.date_format("line_date", "yyyy-MM").alias("month")).agg(out(F.sum(home)).alias("home_total"))


SPEND_CONVERTED = f"""with r(country, rate) as (values {", ".join(f"('{k}', cast('{v}' as decimal(18,6)))" for k, v in RATES.items())})
  select country, strftime(line_date, '%Y-%m') as month, cast(sum(cast(round(amount * rate, 2) as decimal(18,2))) as double) as home_total
  from {T.LINES} join {T.VENDORS} v using (vendor_id) join r using (country) group by 1, 2"""


def gl_by_currency(spark: SparkSession, sf: str) -> DataFrame:
    l = T.lines(spark, sf).join(T.vendors(spark, sf).select("vendor_id", "country"), "vendor_id")
    return l.groupBy("gl", "country").agg(out(F.sum("amount")).alias("total"), F.count("*").alias("n_lines"))


GL_BY_CURRENCY = f"select gl, country, cast(sum(amount) as double) as total, count(*) as n_lines from {T.LINES} join {T.VENDORS} v using (vendor_id) group by 1, 2"


def gl_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger accounts by line status in columns, as an accruals table shows its currencies."""
    return T.lines(spark, sf).groupBy("gl").pivot("line_status", ["F", "O"]).agg(out(F.sum("amount"))).withColumnsRenamed({"F": "received", "O": "open"})


GL_PIVOT = f"""select gl, cast(sum(amount) filter (line_status = 'F') as double) as received, cast(sum(amount) filter (line_status = 'O') as double) as open
  from {T.LINES} group by gl"""


def gl_usage(spark: SparkSession, sf: str) -> DataFrame:
    """How often a vendor's lines use each account, the most used first."""
    used = T.lines(spark, sf).groupBy("vendor_id", "gl").agg(F.count("*").alias("uses"))
    return used.withColumn("rank", F.row_number().over(Window.partitionBy("vendor_id").orderBy(F.desc("uses"), "gl")))


GL_USAGE = f"""select vendor_id, gl, uses, cast(row_number() over (partition by vendor_id order by uses desc, gl) as integer) as rank
  from (select vendor_id, gl, count(*) as uses from {T.LINES} group by 1, 2)"""


def vendor_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row a vendor: lines by status, credits, spend, first and last date, and master attributes; vendors without lines stay."""
    g = T.lines(spark, sf).groupBy("vendor_id").agg(
        F.count_if(F.col("line_status") == "F").alias("received"), F.count_if(F.col("line_status") == "O").alias("open"), F.count_if(F.col("return_flag") == "R").alias("credits"),
        out(F.sum("amount")).alias("spend"), F.min("line_date").alias("first_date"), F.max("line_date").alias("last_date"), F.count_distinct("gl").alias("n_accounts"),
    )
    zero = {k: 0 for k in ("received", "open", "credits", "n_accounts")} | {"spend": 0.0}
    return T.vendors(spark, sf).select("vendor_id", "vendor_name", "province").join(g, "vendor_id", "left").fillna(zero)


VENDOR_SUMMARY = f"""select v.vendor_id, vendor_name, province, coalesce(received, 0) as received, coalesce(open, 0) as open, coalesce(credits, 0) as credits,
  coalesce(spend, 0) as spend, first_date, last_date, coalesce(n_accounts, 0) as n_accounts from {T.VENDORS} v left join
  (select vendor_id, count(*) filter (line_status = 'F') as received, count(*) filter (line_status = 'O') as open, count(*) filter (return_flag = 'R') as credits,
    cast(sum(amount) as double) as spend, min(line_date) as first_date, max(line_date) as last_date, count(distinct gl) as n_accounts from {T.LINES} group by 1) g using (vendor_id)"""


def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Export batches (here a day's invoices of one priority) with totals; batches that hold a pending invoice are incomplete and left out."""
    i = T.invoices(spark, sf).withColumn("batch", F.concat_ws("/", F.date_format("invoice_date", "yyyy-MM-dd"), "priority"))
    incomplete = i.where("status = 'pending_approval'").select("batch").distinct()
    return i.join(incomplete, "batch", "left_anti").groupBy("batch").agg(F.count("*").alias("n"), out(F.sum("total")).alias("total"))


BATCH_TOTALS = f"""with i as (select *, strftime(invoice_date, '%Y-%m-%d') || '/' || priority as batch from {T.INVOICES})
  select batch, count(*) as n, cast(sum(total) as double) as total from i where batch not in (select batch from i where status = 'pending_approval') group by batch"""


def tax_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tax by province and rate: taxable base, tax rounded line by line, and lines at risk (no tax on a charge)."""
    l = T.lines(spark, sf, parts=False).join(T.vendors(spark, sf).select("vendor_id", "province"), "vendor_id")
    base = half_up(F.col("amount") * (F.lit(1).cast("decimal(18,2)") - F.col("discount"))).cast("decimal(18,2)")
    tax = half_up(base * F.col("tax_rate")).cast("decimal(18,2)")
    return l.groupBy("province", out(F.col("tax_rate")).alias("rate")).agg(
        out(F.sum(base)).alias("base"), out(F.sum(tax)).alias("tax"), F.count_if((F.col("tax_rate") == 0) & (F.col("return_flag") != "R")).alias("at_risk")
    )


TAX_TOTALS = f"""with l as (select province, tax_rate, return_flag, cast(round(amount * (1 - discount), 2) as decimal(18,2)) as base from {T.LINES} join {T.VENDORS} v using (vendor_id))
  select province, cast(tax_rate as double) as rate, cast(sum(base) as double) as base, cast(sum(cast(round(base * tax_rate, 2) as decimal(18,2))) as double) as tax,
  count(*) filter (tax_rate = 0 and return_flag <> 'R') as at_risk from l group by province, tax_rate"""


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger postings: each invoice's total tax, a part of it not recoverable, spread over its lines in cents; sums to the whole."""
    l = T.lines(spark, sf).withColumn("part_of_line", F.col("part_id") * 100 + F.col("line_number"))
    one = l.groupBy("invoice_id", "part_of_line", "gl").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.max("tax_rate").alias("rate"))
    tax = one.groupBy("invoice_id").agg(half_up(F.sum(F.col("amount") * F.col("rate")) * F.lit("0.37").cast("decimal(18,2)")).cast("decimal(18,2)").alias("unrecoverable"))
    shared = split_in_proportion(one.join(tax, "invoice_id"), "invoice_id", "unrecoverable", "amount", "part_of_line", "tax_share")
    return shared.groupBy("gl").agg(out(F.sum("amount")).alias("expense"), out(F.sum("tax_share")).alias("tax"), out(F.sum(F.col("amount") + F.col("tax_share"))).alias("posted"))


DISTRIBUTION = f"""with one as (select invoice_id, part_id * 100 + line_number as part_of_line, gl, cast(sum(amount) as decimal(18,2)) as amount, max(tax_rate) as rate from {T.LINES} group by 1, 2, 3),
  tax as (select invoice_id, cast(round(sum(cast(amount * rate as decimal(28,4))) * cast('0.37' as decimal(4,2)), 2) as decimal(18,2)) as unrecoverable from one group by 1),
  s as (select *, sum(abs(amount)) over (partition by invoice_id) as whole from one join tax using (invoice_id)),
  d as (select *,
    cast(cast((cast(unrecoverable * 100 as hugeint) * cast(abs(amount) * 100 as hugeint) * 2 + cast(whole * 100 as hugeint)) // (2 * cast(whole * 100 as hugeint)) as decimal(18,0)) / 100 as decimal(18,2)) as share from s),
  r as (select *, unrecoverable - sum(share) over (partition by invoice_id) as rest, row_number() over (partition by invoice_id order by abs(amount) desc, part_of_line) as k from d)
  select gl, cast(sum(amount) as double) as expense, cast(sum(share + case when k = 1 then rest else 0 end) as double) as tax,
  cast(sum(amount + share + case when k = 1 then rest else 0 end) as double) as posted from r group by gl"""

def rollup_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Spend by category and account with subtotals (an addition beyond the plain reports)."""
    total: Column = out(F.sum("amount"))
    return T.lines(spark, sf).rollup("category", "gl").agg(total.alias("total"), F.grouping_id().cast("int").alias("level"))


ROLLUP_SPEND = f"select category, gl, cast(sum(amount) as double) as total, cast(grouping(category, gl) as integer) as level from {T.LINES} group by rollup(category, gl)"

QUERIES = [
    ("spend_by_vendor", *_spend("vendor_id")),
    ("spend_by_gl", *_spend("gl")),
    ("spend_by_cost_center", *_spend("cost_center")),
    ("spend_by_month_category", spend_by_month_category, SPEND_BY_MONTH_CATEGORY),
    ("currencies_by_spend", currencies_by_spend, CURRENCIES_BY_SPEND),
    ("spend_converted", spend_converted, SPEND_CONVERTED),
    ("gl_by_currency", gl_by_currency, GL_BY_CURRENCY),
    ("gl_pivot", gl_pivot, GL_PIVOT),
    ("gl_usage", gl_usage, GL_USAGE),
    ("vendor_summary", vendor_summary, VENDOR_SUMMARY),
    ("batch_totals", batch_totals, BATCH_TOTALS),
    ("tax_totals", tax_totals, TAX_TOTALS),
    ("gl_distribution", distribution, DISTRIBUTION),
    ("spend_rollup", rollup_spend, ROLLUP_SPEND),
]
