"""Review reports: insights, scorecards, account lists, paired lines, coding rules, account status, bulk candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions.money import out
from quillmint.sources import tables as T

I, L, V = T.INVOICES, T.LINES, T.VENDORS

# Coding rules: id, category (blank: any), brand prefix (blank: any), account to set.
RULES = [(1, "", "", "GENERAL"), (2, "SMALL", "", "SMALL TOOLS"), (3, "", "Brand#1", "HOUSE BRAND"), (4, "SMALL", "Brand#2", "SMALL SECOND"), (5, "LARGE", "", "PLANT")]
RULES_SQL = "(select * from (values " + ", ".join(map(repr, RULES)) + ") t(rule_id, rule_category, rule_brand, account))"


def insights(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over the invoices by year: processed, straight through, flagged, and value."""
    i = T.invoices(spark, sf)
    return i.groupBy(F.year("invoice_date").alias("year")).agg(
        F.count("*").alias("processed"), F.count_if(F.col("status") == "approved").alias("straight"), F.count_if(F.col("total") > 300000).alias("flagged"),
        F.round(F.count_if(F.col("status") == "approved") / F.count("*"), 9).alias("rate"), out(F.sum("total")).alias("value"),
    )


INSIGHTS = f"""select cast(year(invoice_date) as integer) as year, count(*) as processed, count(*) filter (status = 'approved') as straight, count(*) filter (total > 300000) as flagged,
  round(count(*) filter (status = 'approved') / count(*), 9) as rate, cast(sum(total) as double) as value from {I} group by 1"""


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Readers (sources) by language: read, right, and the latest disagreement as a whole row."""
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    wrong = F.col("quality") == 0
    last = F.max_by(F.struct("doc_id", "n_chars"), F.when(wrong, F.col("doc_id")))
    g = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(~wrong).alias("right"), F.when(F.count_if(wrong) > 0, last).alias("x"))
    return g.select("source", "lang", "n", "right", F.col("x.doc_id").alias("last_wrong"), F.col("x.n_chars").cast("long").alias("its_length"))


SCORECARD = """with d as (select *, row_number() over (partition by source, lang, quality order by doc_id desc) as k from documents join labels using (doc_id))
  select source, lang, count(*) as n, count(*) filter (quality <> 0) as right, max(case when quality = 0 and k = 1 then doc_id end) as last_wrong,
  cast(max(case when quality = 0 and k = 1 then n_chars end) as bigint) as its_length from d group by 1, 2"""


def account_names(spark: SparkSession, sf: str) -> DataFrame:
    """Each account's commonest brand; ties go to the brand of the smallest part."""
    p = T.table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    w = Window.partitionBy("p_type").orderBy(F.desc("n"), "first")
    return p.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("p_type").alias("gl"), F.col("p_brand").alias("name"), "n")


ACCOUNT_NAMES = """select p_type as gl, p_brand as name, n from (select p_type, p_brand, count(*) as n, row_number() over (partition by p_type order by count(*) desc, min(p_partkey)) as k
  from part group by 1, 2) where k = 1"""


def paired_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed (open) and approved (received) lines of an invoice paired by place; what either side lacks stays."""
    w = Window.partitionBy("invoice_id").orderBy("part_id", "line_number", "amount", "quantity")
    side = lambda s, n: T.lines(spark, sf, parts=False).where(F.col("line_status") == s).select("invoice_id", F.row_number().over(w).alias("place"), F.col("part_id").alias(n))
    return side("O", "proposed").join(side("F", "approved"), ["invoice_id", "place"], "full_outer")


PAIRED_LINES = f"""with l as (select *, cast(row_number() over (partition by invoice_id, line_status order by part_id, line_number, amount, quantity) as integer) as place from {L}),
  o as (select invoice_id, place, part_id as proposed from l where line_status = 'O'), f as (select invoice_id, place, part_id as approved from l where line_status = 'F')
  select coalesce(o.invoice_id, f.invoice_id) as invoice_id, coalesce(o.place, f.place) as place, proposed, approved from o full join f on o.invoice_id = f.invoice_id and o.place = f.place"""


def coded_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts coded by the most specific rule that fits: more conditions first, then the smaller id."""
    rules = spark.createDataFrame(RULES, "rule_id int, rule_category string, rule_brand string, account string")
    parts = T.table(spark, sf, "part").select("p_partkey", "p_brand", F.substring_index("p_type", " ", 1).alias("category"))
    fits = ((F.col("rule_category") == "") | (F.col("rule_category") == F.col("category"))) & F.col("p_brand").startswith(F.col("rule_brand"))
    weight = (F.col("rule_category") != "").cast("int") + (F.col("rule_brand") != "").cast("int")
    hit = parts.join(F.broadcast(rules), fits)  # a handful of rules
    best = hit.groupBy("p_partkey").agg(F.max_by(F.struct("rule_id", "account"), F.struct(weight, -F.col("rule_id"))).alias("b"))
    return best.select("p_partkey", F.col("b.rule_id").alias("rule_id"), F.col("b.account").alias("account"))


CODED_BY_RULES = f"""select p_partkey, rule_id, account from (select p_partkey, rule_id, account, row_number() over (partition by p_partkey order by
  (rule_category <> '')::int + (rule_brand <> '')::int desc, rule_id) as k from part join {RULES_SQL} r
  on (rule_category = '' or rule_category = split_part(p_type, ' ', 1)) and starts_with(p_brand, rule_brand)) where k = 1"""


def account_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every used account and cost centre judged against the chart: unknown, held, inactive or ok; the first reason counts."""
    used = T.lines(spark, sf).groupBy("gl", "cost_center").agg(F.count("*").alias("n"))
    chart = T.table(spark, sf, "part").groupBy(F.col("p_type").alias("gl")).agg(F.max("p_size").alias("size"))
    joined = used.join(chart.where("size >= 10"), "gl", "left")
    status = F.when(F.col("size").isNull(), "not in chart").when(F.col("cost_center").rlike("^Brand#5"), "held").when(F.col("n") < 20, "inactive").otherwise("ok")
    return joined.groupBy("gl", status.alias("status")).agg(F.count("*").alias("units"), F.sum("n").alias("n_lines"))


ACCOUNT_STATUS = f"""with u as (select gl, cost_center, count(*) as n from {L} group by 1, 2), c as (select p_type as gl, max(p_size) as size from part group by 1 having max(p_size) >= 10)
  select u.gl, case when size is null then 'not in chart' when cost_center like 'Brand#5%' then 'held' when n < 20 then 'inactive' else 'ok' end as status, count(*) as units,
  cast(sum(n) as bigint) as n_lines from u left join c on u.gl = c.gl group by 1, 2"""


def bulk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices under review with the first reason that keeps them out of a bulk approval."""
    l = T.lines(spark, sf, parts=False).groupBy("invoice_id").agg(F.bool_or(F.col("return_flag") == "R").alias("credit"), F.count("*").alias("n"))
    j = T.invoices(spark, sf).where("status = 'review'").join(l, "invoice_id", "left")
    reason = F.when(F.col("n").isNull(), "no lines").when(F.col("credit"), "holds a credit").when(F.col("total") > 200000, "over the limit").when(F.col("priority").startswith("1"), "urgent").otherwise("clean")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), out(F.sum("total")).alias("total"))


BULK_CANDIDATES = f"""with l as (select invoice_id, bool_or(return_flag = 'R') as credit, count(*) as n from {L} group by 1)
  select case when n is null then 'no lines' when credit then 'holds a credit' when total > 200000 then 'over the limit' when starts_with(priority, '1') then 'urgent' else 'clean' end as reason,
  count(*) as n, cast(sum(total) as double) as total from {I} i left join l using (invoice_id) where status = 'review' group by 1"""


def open_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals against what was billed, by vendor: remaining, and whether every part still has some open."""
    l = T.lines(spark, sf)
    g = l.groupBy("vendor_id", "part_id").agg(F.sum(F.when(F.col("line_status") == "F", F.col("amount"))).alias("ordered"), F.sum(F.when(F.col("line_status") == "O", F.col("amount"))).alias("billed"))
    left = F.coalesce("ordered", F.lit(0)) - F.coalesce("billed", F.lit(0))
    return g.groupBy("vendor_id").agg(out(F.sum(left)).alias("remaining"), F.every(left > 0).alias("all_open"), F.count_if(F.col("billed") > F.col("ordered")).alias("over"))


OPEN_ORDERS = f"""with g as (select vendor_id, part_id, sum(case when line_status = 'F' then amount end) as ordered, sum(case when line_status = 'O' then amount end) as billed from {L} group by 1, 2)
  select vendor_id, cast(sum(coalesce(ordered, 0) - coalesce(billed, 0)) as double) as remaining, bool_and(coalesce(ordered, 0) - coalesce(billed, 0) > 0) as all_open,
  count(*) filter (billed > ordered) as over from g group by 1"""

QUERIES = [
    ("insights", insights, INSIGHTS), ("scorecard", scorecard, SCORECARD), ("account_names", account_names, ACCOUNT_NAMES), ("paired_lines", paired_lines, PAIRED_LINES),
    ("coded_by_rules", coded_by_rules, CODED_BY_RULES), ("account_status", account_status, ACCOUNT_STATUS), ("bulk_candidates", bulk_candidates, BULK_CANDIDATES), ("open_orders", open_orders, OPEN_ORDERS),
]
