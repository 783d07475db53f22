"""Orders, receipts and bills: which receipts a bill is for, and what is to be accrued at a period's end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions.terms import with_terms
from quillmint.sources import tables as T

L, I = T.LINES, T.INVOICES


def allocated(taken: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """Which of what was given each of what was taken is for, first to first: key, taken_id, given_id, taken_at, given_at and quantity.

    Both sides have the key, id, at and quantity (above zero). Running sums in (at, id) order lay either side out along
    one line of quantities. Between two neighbouring ends on that line lies a piece of one taking and one giving: those
    whose ends come next. So a key's rows are sorted and looked at once, and never joined to each other; a piece past
    the other side's end has a null there.
    """
    order = Window.partitionBy(*key).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)

    def ends(rows: DataFrame, side: str) -> DataFrame:
        own = F.struct("id", "at")
        none = F.lit(None).cast("struct<id: bigint, at: date>")
        return rows.withColumn("end", F.sum("quantity").over(order)).select(*key, "end", (own if side == "taken" else none).alias("taken"), (own if side == "given" else none).alias("given"))

    line = ends(taken, "taken").unionByName(ends(given, "given"))
    back = Window.partitionBy(*key).orderBy(F.desc("end"), F.desc_nulls_last("taken")).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*key).orderBy("end", F.asc_nulls_first("taken"))
    pieces = line.withColumns({
        "t": F.last("taken", ignorenulls=True).over(back), "g": F.last("given", ignorenulls=True).over(back), "quantity": F.col("end") - F.coalesce(F.lag("end").over(on), F.lit(0)),
    }).where("quantity > 0")
    return pieces.select(*key, F.col("t.id").alias("taken_id"), F.col("g.id").alias("given_id"), F.col("t.at").alias("taken_at"), F.col("g.at").alias("given_at"), "quantity")


def bills_and_receipts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Bills (an invoice's open lines of a vendor's cost centre) and receipts (a day's finished lines of it), in whole pieces."""
    l = T.lines(spark, sf).withColumn("pieces", F.col("quantity").cast("long"))
    key = ["vendor_id", "cost_center"]
    bills = l.where("line_status = 'O'").groupBy(*key, F.col("invoice_id").alias("id")).agg(F.min("line_date").alias("at"), F.sum("pieces").alias("quantity"))
    receipts = l.where("line_status = 'F'").groupBy(*key, F.col("line_date").alias("at")).agg(F.sum("pieces").alias("quantity"))
    # Receipts come early and bills late in these tables; bills are moved back so that some come before their goods.
    bills = bills.withColumn("at", F.date_sub("at", 900))
    return bills.where("quantity > 0"), receipts.withColumn("id", F.unix_date("at").cast("long")).where("quantity > 0")


def bills_received(spark: SparkSession, sf: str) -> DataFrame:
    """Every bill against the receipts it is for: pieces received by its date, later, and never; the last receipt and the longest wait."""
    bills, receipts = bills_and_receipts(spark, sf)
    pieces = allocated(bills, receipts, ["vendor_id", "cost_center"]).where("taken_id is not null")
    of = lambda cond: F.sum(F.when(cond, F.col("quantity")).otherwise(0)).cast("long")
    come = F.col("given_id").isNotNull()
    late = come & (F.col("given_at") > F.col("taken_at"))
    g = pieces.groupBy("vendor_id", "cost_center", F.col("taken_id").alias("invoice_id"), F.col("taken_at").alias("billed_on"))
    g = g.agg(F.sum("quantity").cast("long").alias("billed"), of(come & ~late).alias("in_time"), of(late).alias("later"), of(~come).alias("never"), F.max("given_at").alias("last_receipt"), F.max(F.when(late, F.date_diff("given_at", "taken_at"))).alias("longest_wait"))
    verdict = F.when(F.col("never") > 0, "billed over received").when(F.col("later") > 0, "billed before receipt").otherwise("received")
    return g.withColumn("verdict", verdict)


BILLS_RECEIVED = f"""with b as (select vendor_id, cost_center, invoice_id, cast(min(line_date) - 900 as date) as at_, sum(cast(quantity as bigint)) as q from {L} where line_status = 'O' group by 1, 2, 3 having q > 0),
  r as (select vendor_id, cost_center, line_date as at_, sum(cast(quantity as bigint)) as q from {L} where line_status = 'F' group by 1, 2, 3 having q > 0),
  bi as (select *, sum(q) over w - q as lo, sum(q) over w as hi from b window w as (partition by vendor_id, cost_center order by at_, invoice_id)),
  ri as (select *, sum(q) over w - q as lo, sum(q) over w as hi from r window w as (partition by vendor_id, cost_center order by at_)),
  m as (select bi.vendor_id, bi.cost_center, invoice_id, bi.at_ as billed_on, bi.q as billed, ri.at_ as given_at, case when ri.lo is null then 0 else least(bi.hi, ri.hi) - greatest(bi.lo, ri.lo) end as n
    from bi left join ri on bi.vendor_id = ri.vendor_id and bi.cost_center = ri.cost_center and bi.lo < ri.hi and ri.lo < bi.hi),
  g as (select vendor_id, cost_center, invoice_id, billed_on, cast(any_value(billed) as bigint) as billed, cast(coalesce(sum(n) filter (given_at <= billed_on), 0) as bigint) as in_time, cast(coalesce(sum(n) filter (given_at > billed_on), 0) as bigint) as later,
    cast(any_value(billed) - sum(n) as bigint) as never, max(given_at) as last_receipt, cast(max(case when given_at > billed_on then given_at - billed_on end) as integer) as longest_wait from m group by 1, 2, 3, 4)
  select *, case when never > 0 then 'billed over received' when later > 0 then 'billed before receipt' else 'received' end as verdict from g"""

PERIOD_END, OLD_DAYS, BUSY_MONTHS = "1997-06-30", 365, 3


def accruals(spark: SparkSession, sf: str) -> DataFrame:
    """What a vendor is owed at the period's end by source: rows, old rows and value.

    * received: pieces of a part received and not billed by then, at the order's mean price;
    * not posted: billed lines of invoices that are not approved, dated by then, copies (same vendor, part, quantity
      and amount on an earlier such invoice) left out; more than a year old ones are told;
    * expected: a cost centre that a vendor billed for in at least BUSY_MONTHS of the last twelve months and not in the last one, at its
      mean month, unless the vendor has one of the sources above for it.
    """
    end = F.lit(PERIOD_END).cast("date")
    l = T.lines(spark, sf).withColumns({"pieces": F.col("quantity").cast("long"), "cents": (F.col("amount") * 100).cast("long")})
    until, got, billed = l.where(F.col("line_date") <= end), F.col("line_status") == "F", F.col("line_status") == "O"
    of = lambda cond, x: F.sum(F.when(cond, F.col(x)).otherwise(0))
    parts = until.groupBy("vendor_id", "cost_center", "part_id").agg(of(got, "pieces").alias("in"), of(billed, "pieces").alias("out"), of(got, "cents").alias("cents")).where("in > out")
    value = F.call_function("div", 2 * (F.col("in") - F.col("out")) * F.col("cents") + F.col("in"), 2 * F.col("in"))
    received = parts.select("vendor_id", "cost_center", F.lit("received").alias("source"), F.lit(False).alias("old"), value.alias("value"))
    open_ = T.invoices(spark, sf).where("status <> 'approved'").where(F.col("invoice_date") <= end).select("invoice_id", "invoice_date")
    own = Window.partitionBy("vendor_id", "part_id", "pieces", "cents").orderBy("invoice_id", "line_number")
    posted = l.where(billed).join(open_, "invoice_id").withColumn("copy", F.row_number().over(own)).where("copy = 1")
    waiting = posted.select("vendor_id", "cost_center", F.lit("not posted").alias("source"), (F.col("invoice_date") < F.date_sub(end, OLD_DAYS)).alias("old"), F.col("cents").alias("value"))
    month = F.trunc("line_date", "month")
    months = until.where(F.col("line_date") > F.add_months(end, -12)).groupBy("vendor_id", "cost_center", month.alias("month")).agg(F.sum("cents").alias("cents"))
    busy = months.groupBy("vendor_id", "cost_center").agg(F.count("*").alias("n"), F.max("month").alias("last"), F.sum("cents").alias("cents")).where((F.col("n") >= BUSY_MONTHS) & (F.col("last") < F.trunc(end, "month")))
    told = received.unionByName(waiting)
    due = busy.join(told.select("vendor_id", "cost_center").distinct(), ["vendor_id", "cost_center"], "left_anti")
    expected = due.select("vendor_id", "cost_center", F.lit("expected").alias("source"), F.lit(False).alias("old"), F.call_function("div", 2 * F.col("cents") + F.col("n"), 2 * F.col("n")).alias("value"))
    g = told.unionByName(expected).groupBy("vendor_id", "source")
    return g.agg(F.count("*").alias("n"), F.count_if("old").alias("n_old"), (F.sum("value").cast("double") / 100).alias("value"))


ACCRUALS = f"""with l as (select *, cast(quantity as bigint) as pieces, cast(amount * 100 as bigint) as cents from {L}), u as (select * from l where line_date <= date '{PERIOD_END}'),
  p as (select vendor_id, cost_center, part_id, sum(pieces) filter (line_status = 'F') as i, coalesce(sum(pieces) filter (line_status = 'O'), 0) as o, sum(cents) filter (line_status = 'F') as c from u group by 1, 2, 3),
  r as (select vendor_id, cost_center, 'received' as source, false as old, cast((2 * (i - o) * c + i) // (2 * i) as bigint) as value from p where i > o),
  q as (select vendor_id, cost_center, 'not posted' as source, invoice_date < date '{PERIOD_END}' - {OLD_DAYS} as old, cents as value, row_number() over (partition by vendor_id, part_id, pieces, cents order by invoice_id, line_number) as copy
    from l join {I} i using (invoice_id) where line_status = 'O' and status <> 'approved' and invoice_date <= date '{PERIOD_END}'),
  t as (select * from r union all select vendor_id, cost_center, source, old, value from q where copy = 1),
  m as (select vendor_id, cost_center, date_trunc('month', line_date) as month, sum(cents) as cents from u where line_date > date '{PERIOD_END}' - interval 12 month group by 1, 2, 3),
  b as (select vendor_id, cost_center, count(*) as n, sum(cents) as cents from m group by 1, 2 having count(*) >= {BUSY_MONTHS} and max(month) < date_trunc('month', date '{PERIOD_END}')),
  e as (select vendor_id, cost_center, 'expected' as source, false as old, cast((2 * cents + n) // (2 * n) as bigint) as value from b anti join t using (vendor_id, cost_center))
  select vendor_id, source, count(*) as n, count(*) filter (old) as n_old, cast(sum(value) as double) / 100 as value from (select * from t union all select * from e) group by 1, 2"""

# Printed terms with what they mean in SQL over d: the due date of the first instalment, instalments and days between them, discounts.
TERMS = [
    ("Net 30", "d + 30", 1, 0, []), ("2/10 Net 30", "d + 30", 1, 0, [(200, "d + 10")]), ("Net 30 EOM", "last_day(d) + 30", 1, 0, []), ("Net 25th prox", "date_trunc('month', d)::date + interval 1 month + interval 24 day", 1, 0, []),
    ("Due on receipt", "d", 1, 0, []), ("2/10 EOM", "last_day(d) + 30", 1, 0, [(200, "last_day(d) + 10")]), ("Net 2 months", "d + interval 2 month", 1, 0, []), ("Net 30 in 3 payments 15 days apart", "d + 30", 3, 15, []),
    ("1/2% 10 net 45; overdue accounts 2% per month", "d + 45", 1, 0, [(50, "d + 10")]), ("Overdue accounts are charged 2% interest per month", None, 1, 0, []), ("3/10, 2/20, net 60", "d + 60", 1, 0, [(300, "d + 10"), (200, "d + 20")]),
    ("Net 30 in 4 payments", "d + 30", 4, 30, []), ("Net 3 weeks", "d + 21", 1, 0, []),
]


def payment_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every invoice's instalments by its printed terms, and the discounts on offer, the first one's date and amount."""
    i = T.invoices(spark, sf).select("invoice_id", "invoice_date", (F.col("total") * 100).cast("long").alias("cents"))
    printed = F.element_at(F.array(*(F.lit(t) for t, *_ in TERMS)), (F.col("invoice_id") % len(TERMS) + 1).cast("int"))
    planned = with_terms(i.withColumn("terms", printed), "terms", "invoice_date", "cents")
    first = F.get("discounts", F.lit(0))
    each = planned.select("invoice_id", F.size("discounts").alias("n_discounts"), first["by"].alias("discount_by"), first["cents"].alias("discount_cents"), F.posexplode_outer("instalments").alias("n", "x"))
    return each.select("invoice_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("x.due").alias("due"), F.col("x.cents").alias("cents"), "n_discounts", "discount_by", "discount_cents")


def _plan_sql() -> str:
    cases = lambda xs: "case invoice_id % " + str(len(TERMS)) + " " + " ".join(f"when {k} then {x}" for k, x in enumerate(xs)) + " end"
    first = [t[4][0] if t[4] else (0, "null") for t in TERMS]
    return f"""with i as (select invoice_id, invoice_date as d, cast(total * 100 as bigint) as c from {I}),
  p as (select *, {cases([f"cast({t[1] or 'null'} as date)" for t in TERMS])} as due, {cases([t[2] for t in TERMS])} as k, {cases([t[3] for t in TERMS])} as apart, {cases([len(t[4]) for t in TERMS])} as n_discounts,
    {cases([f"cast({by} as date)" for _, by in first])} as discount_by, {cases([p for p, _ in first])} as points from i)
  select invoice_id, n::integer as n, case when due is not null then cast(due + cast(n * apart as integer) as date) end as due, case when due is not null then c // k + case when n < c % k then 1 else 0 end end as cents, n_discounts, discount_by,
    case when points > 0 then (c * points * 2 + 10000) // 20000 end as discount_cents from (select *, unnest(range(k)) as n from p)"""


QUERIES = [
    ("payment_plan", payment_plan, _plan_sql()),
    ("bills_received", bills_received, BILLS_RECEIVED),
    ("accruals", accruals, ACCRUALS),
]
