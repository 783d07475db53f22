"""Tax reports: checks of charged rates, the claim of paid tax, self-assessment, and the lines that carry a tax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.functions.money import half_up, out
from quillmint.operators.subsets import lines_with_tax
from quillmint.plans.matching import RATE_SQL, rates
from quillmint.sources import tables as T

MONEY = "decimal(18,2)"


def in_force(rows: DataFrame, rate_rows: DataFrame, at: str) -> DataFrame:
    """Rows with the rate in force of their country and province on a date, a province's own before its country's; null where there is none.

    The rate table is a dimension of a few rows a country.
    """
    r = F.broadcast(rate_rows.select("rc", "rp", "rate", "s", "e"))
    hit = (F.col("country") == F.col("rc")) & (F.col("s") <= F.col(at)) & (F.col("e").isNull() | (F.col(at) <= F.col("e"))) & (F.col("rp").isNull() | (F.col("rp") == F.col("province")))
    slots = rows.select(at, "country", "province").distinct().join(r, hit, "left")
    best = slots.groupBy(at, "country", "province").agg(F.max_by("rate", F.struct(F.col("rp").isNotNull(), F.col("s"))).alias("official"))
    return rows.join(best, [at, "country", "province"], "left")


def taxed_lines(spark: SparkSession, sf: str, parts: bool = False) -> DataFrame:
    """Lines with their vendor's place and the official rate of the line's month."""
    v = T.vendors(spark, sf).select("vendor_id", "province", "country", "balance")
    l = T.lines(spark, sf, parts=parts).withColumn("month", F.trunc("line_date", "month").cast("date")).join(v, "vendor_id")
    return in_force(l, rates(spark), "month")


TAXED = f"""(with l as (select l.*, cast(date_trunc('month', line_date) as date) as month, province, country, balance from {T.LINES} l join {T.VENDORS} v using (vendor_id)),
  k as (select distinct month, country, province from l),
  h as (select k.*, rate, row_number() over (partition by month, k.country, k.province order by (rp is not null) desc, s desc) as n
    from k join {RATE_SQL} r on rc = k.country and s <= month and (e is null or month <= e) and (rp is null or rp = k.province))
  select l.*, rate as official from l left join (select * from h where n = 1) h using (month, country, province))"""


def tax_findings() -> Column:
    """The findings of a line: no regime, a rate that is not the official one, tax by an unregistered vendor, tax on an exempt account, none where it is due."""
    charged = F.col("tax_rate") > 0
    cases = [
        (F.col("official").isNull() & charged, "no regime"), (F.col("official").isNotNull() & charged & (F.abs(F.col("tax_rate") - F.col("official")) >= 0.005), "other rate"),
        ((F.col("balance") < 0) & charged, "not registered"), ((F.col("gl") == "PROMO") & charged, "exempt"), (F.col("official").isNotNull() & ~charged & (F.col("gl") != "PROMO"), "not charged"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in cases)), lambda x: x.isNotNull())


def tax_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the tax checks by province: lines and amount of each."""
    found = taxed_lines(spark, sf, parts=True).select("province", "amount", F.explode(tax_findings()).alias("finding"))
    return found.groupBy("province", "finding").agg(F.count("*").alias("n"), out(F.sum("amount")).alias("amount"))


TAX_CHECKS = f"""with l as (select * from {TAXED}), f as (
    select province, amount, 'no regime' as finding from l where official is null and tax_rate > 0
    union all select province, amount, 'other rate' from l where official is not null and tax_rate > 0 and abs(tax_rate - official) >= 0.005
    union all select province, amount, 'not registered' from l where balance < 0 and tax_rate > 0
    union all select province, amount, 'exempt' from l where gl = 'PROMO' and tax_rate > 0
    union all select province, amount, 'not charged' from l where official is not null and tax_rate = 0 and gl <> 'PROMO')
  select province, finding, count(*) as n, cast(sum(amount) as double) as amount from f group by 1, 2"""

# Parameters of the claim: from which invoice total a registration number is needed, and when that changed.
DOCUMENT_FROM, DOCUMENT_TOTAL, DOCUMENT_TOTAL_BEFORE = "1998-04-21", 100_000, 30_000


def tax_claim(spark: SparkSession, sf: str) -> DataFrame:
    """The claim of paid tax on approved invoices, by month and what stands against it: registration missing from a total on, meals (half, cut towards zero, is not claimed), foreign money, not exported."""
    i = T.invoices(spark, sf).where("status = 'approved'").select("invoice_id", "total", "invoice_date", "priority")
    v = T.vendors(spark, sf).select("vendor_id", "country", "balance")
    tax = half_up(F.col("amount") * (1 - F.col("discount")) * F.col("tax_rate")).cast(MONEY)
    l = T.lines(spark, sf).where("tax_rate > 0").withColumn("tax", tax).join(i, "invoice_id").join(v, "vendor_id")
    meals = F.col("gl") == "PROMO"
    l = l.withColumn("not_claimed", F.when(meals, (F.signum("tax").cast("int") * F.floor(F.abs("tax") * 50) / 100).cast(MONEY)).otherwise(F.lit(0).cast(MONEY)))
    least = F.when(F.col("invoice_date") >= F.lit(DOCUMENT_FROM).cast("date"), DOCUMENT_TOTAL).otherwise(DOCUMENT_TOTAL_BEFORE)
    issues = F.concat_ws(
        "; ", F.when((F.col("balance") < 0) & (F.abs("total") >= least), F.lit("no valid number")), F.when(meals, F.lit("meals")), F.when(F.col("country") != "AMERICA", F.lit("foreign")), F.when(F.col("priority").startswith("5"), F.lit("not exported"))
    )
    g = l.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month"), issues.alias("issues"))
    return g.agg(out(F.sum(F.col("tax") - F.col("not_claimed"))).alias("claimed"), out(F.sum("not_claimed")).alias("not_claimed"), F.count_distinct("invoice_id").alias("n_invoices"))


TAX_CLAIM = f"""with l as (select l.*, total, invoice_date, priority, country, balance, cast(round(amount * (1 - discount) * tax_rate, 2) as decimal(18,2)) as tax
    from {T.LINES} l join {T.INVOICES} i using (invoice_id) join {T.VENDORS} v using (vendor_id) where status = 'approved' and tax_rate > 0),
  c as (select *, case when gl = 'PROMO' then sign(tax) * floor(abs(tax) * 50) / 100 else 0 end as half,
    concat_ws('; ', case when balance < 0 and abs(total) >= case when invoice_date >= date '{DOCUMENT_FROM}' then {DOCUMENT_TOTAL} else {DOCUMENT_TOTAL_BEFORE} end then 'no valid number' end,
      case when gl = 'PROMO' then 'meals' end, case when country <> 'AMERICA' then 'foreign' end, case when starts_with(priority, '5') then 'not exported' end) as issues from l)
  select strftime(invoice_date, '%Y-%m') as month, issues, cast(sum(tax) as double) - cast(sum(half) as double) as claimed, cast(sum(half) as double) as not_claimed, count(distinct invoice_id) as n_invoices from c group by 1, 2"""


def self_assessment(spark: SparkSession, sf: str) -> DataFrame:
    """Tax a buyer owes itself: approved invoices' lines that an official rate is due on and that bear none; base and estimate (rounded an invoice) by invoice and place."""
    due = taxed_lines(spark, sf).where("tax_rate = 0 and official > 0").join(T.invoices(spark, sf).where("status = 'approved'").select("invoice_id"), "invoice_id")
    g = due.groupBy("invoice_id", "province", "official").agg(F.sum("amount").cast(MONEY).alias("base")).where(F.abs("base") >= 0.005)
    return g.select("invoice_id", "province", out(F.col("official")).alias("rate"), out(F.col("base")).alias("base"), out(half_up(F.col("base") * F.col("official"))).alias("estimate"))


SELF_ASSESSMENT = f"""with g as (select l.invoice_id, province, official, cast(sum(amount) as decimal(18,2)) as base from {TAXED} l join {T.INVOICES} i using (invoice_id)
    where status = 'approved' and tax_rate = 0 and official > 0 group by 1, 2, 3)
  select invoice_id, province, cast(official as double) as rate, cast(base as double) as base, cast(round(base * official, 2) as double) as estimate from g where abs(base) >= 0.005"""

LINE_RATE = 0.05


def line_tax(spark: SparkSession, sf: str) -> DataFrame:
    """Of each invoice's stated tax (five per cent of the lines not returned): the lines that carry it, and those in doubt.

    Lines of the highest rate stand for credits, lines of PROMO accounts read as untaxed.
    """
    l = T.lines(spark, sf).withColumn("cents", (F.col("amount") * F.when(F.col("tax_rate") == F.lit("0.08").cast(MONEY), -100).otherwise(100)).cast("long"))
    taxed = F.sum(F.when(F.col("return_flag") != "R", F.col("cents")).otherwise(0))
    in_order = F.sort_array(F.collect_list(F.struct("line_number", "part_id", "vendor_id", "cents", F.col("gl").startswith("PROMO").alias("plain"))))
    numbered = F.transform(in_order, lambda x, n: F.struct((n + 1).cast("int").alias("line"), x["cents"].alias("cents"), x["plain"].alias("plain")))
    g = l.groupBy("invoice_id").agg(taxed.alias("base"), numbered.alias("lines"))
    tax = F.round(F.col("base") / F.lit(20).cast("decimal(4,0)")).cast("long")
    found = lines_with_tax(g.select("invoice_id", tax.alias("tax"), "lines"), LINE_RATE)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("invoice_id", "outcome", listed("taxed"), listed("doubt"))


# Every set of an invoice's lines, as a bit mask.
LINE_TAX = f"""with l as (select invoice_id, return_flag, starts_with(gl, 'PROMO') as plain, cast(amount * case when tax_rate = 0.08 then -100 else 100 end as bigint) as cents,
    row_number() over (partition by invoice_id order by line_number, part_id, vendor_id, cast(amount * case when tax_rate = 0.08 then -100 else 100 end as bigint)) as line from {T.LINES}),
  h as (select invoice_id, count(*) as n, sum(cents) as whole, case when sum(cents) < 0 then -1 else 1 end as sign,
    cast(round(sum(case when return_flag <> 'R' then cents else 0 end) / 20.0) as bigint) as tax, list(cents order by line) as cs, list(plain order by line) as ps from l group by 1),
  g as (select *, tax * sign / {LINE_RATE}::double as goal, greatest(2, n) + 10 as slack, list_transform(cs, lambda c: c * sign) as c from h),
  e as (select *, case when abs(whole * sign - goal) <= slack then 'all' when abs(goal) <= slack then 'none due' end as settled from g),
  m as (select invoice_id, n, goal, slack, c, ps, unnest(range(0, 1 << n)) as mask from e where settled is null),
  w as (select *, list_filter(range(1, n + 1), lambda k: (mask >> (k - 1)) & 1 = 1) as way from m),
  s as (select *, list_filter(range(1, n + 1), lambda k: not list_contains(way, k)) as rest, coalesce(list_sum(list_transform(way, lambda k: c[k])), 0) as total from w),
  f as (select *, len(list_filter(rest, lambda k: c[k] <= 0)) = 0 as forced from s where abs(total - goal) <= slack and len(list_filter(rest, lambda k: c[k] = 0)) = 0),
  u as (select *, bool_or(forced) over (partition by invoice_id) as any_forced from f),
  x as (select *, count(*) over (partition by invoice_id) as ways, row_number() over (partition by invoice_id order by len(list_filter(rest, lambda k: not ps[k])), len(rest), abs(total - goal), way) as place
    from u where forced or not any_forced),
  b as (select invoice_id, any_value(ways) as ways, any_value(n) as n, list(way) as sets, any_value(way order by place) as best, any_value(rest order by place) as rest, any_value(ps) as ps from x group by 1),
  t as (select *, list_sort(list_filter(range(1, n + 1), lambda k: len(list_filter(sets, lambda z: list_contains(z, k) <> list_contains(best, k))) > 0 or (list_contains(rest, k) and not ps[k]))) as doubt from b)
  select e.invoice_id, coalesce(settled, case when ways is null then 'none' when ways > 20 then 'unsure' when ways = 1 then 'unique' else 'several' end) as outcome,
    case when settled = 'none due' then '' when settled = 'all' or ways is null or ways > 20 then array_to_string(range(1, e.n + 1), ',') else array_to_string(best, ',') end as taxed,
    case when settled is not null or ways is null then '' when ways > 20 then array_to_string(range(1, e.n + 1), ',') else array_to_string(doubt, ',') end as doubt
  from e left join t using (invoice_id)"""


QUERIES = [
    ("tax_checks", tax_checks, TAX_CHECKS),
    ("tax_claim", tax_claim, TAX_CLAIM),
    ("self_assessment", self_assessment, SELF_ASSESSMENT),
    ("line_tax", line_tax, LINE_TAX),
]
