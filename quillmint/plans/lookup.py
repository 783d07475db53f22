"""Pages, account search, names that were cut, hold-out scores, closing objects, loads of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions.money import out
from quillmint.sources import tables as T

L, I = T.LINES, T.INVOICES


def offset_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page, from 1, of rows in a total order; for deep pages a keyset page reads less."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def invoice_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of invoices under review, the largest first."""
    i = T.invoices(spark, sf).where("status = 'review'")
    return offset_page(i, [F.desc("total"), F.asc("invoice_id")], 3, 50).select("invoice_id", out(F.col("total")).alias("total"))


INVOICE_PAGE = f"select invoice_id, cast(total as double) as total from {I} where status = 'review' order by total desc, invoice_id limit 50 offset 100"


def account_search(accounts: DataFrame, typed: str, most: int = 20) -> DataFrame:
    """Accounts (unit, object, description) that have every typed word: one with a digit begins the unit, the object or both run together, another is in the description; in order, at most some."""
    whole = F.concat("unit", "object")
    found = accounts
    for word in typed.upper().replace(".", " ").split():
        if any(c.isdigit() for c in word):
            found = found.where(F.col("unit").startswith(word) | F.col("object").startswith(word) | whole.startswith(word))
        else:
            found = found.where(F.upper("description").contains(word))
    return found.orderBy("unit", "object").limit(most)


SEARCHES = ("12 small", "3 ring", "104", "widget 2")


def account_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Several searches of the chart (here brands as units, parts as objects)."""
    chart = T.table(spark, sf, "part").select(F.regexp_replace("p_brand", "[^0-9]", "").alias("unit"), F.col("p_partkey").cast("string").alias("object"), F.col("p_name").alias("description"))
    found = [account_search(chart, s).withColumn("typed", F.lit(s)) for s in SEARCHES]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def _search_sql(typed: str) -> str:
    rules = [
        f"(starts_with(unit, '{w}') or starts_with(object, '{w}') or starts_with(unit || object, '{w}'))" if any(c.isdigit() for c in w) else f"contains(upper(description), '{w.upper()}')" for w in typed.split()
    ]
    return f"(select *, '{typed}' as typed from c where {' and '.join(rules)} order by unit, object limit 20)"


ACCOUNT_LOOKUP = "with c as (select regexp_replace(p_brand, '[^0-9]', '', 'g') as unit, cast(p_partkey as varchar) as object, p_name as description from part) " + " union all ".join(map(_search_sql, SEARCHES))


def cut_name_match(printed: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """Printed names (row, name), perhaps cut at ``width`` characters, to master names (id, name): a whole name beats a cut one; several hits of a kind are none."""
    tiers = [printed.join(names.select("id", "name"), "name").select("row", "id", F.lit(1).alias("tier"))]
    cut = printed.where(F.length("name") == width)
    longer = names.where(F.length("name") > width).select("id", F.substring("name", 1, width).alias("name"))
    tiers.append(cut.join(longer, "name").select("row", "id", F.lit(2).alias("tier")))
    g = tiers[0].unionByName(tiers[1]).groupBy("row", "tier").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    first = g.groupBy("row").agg(F.min_by(F.struct("tier", "n", "id"), "tier").alias("x"))
    return printed.join(first.where("x.n = 1"), "row", "left").select("row", F.col("x.id").alias("id"), F.col("x.tier").alias("tier"))


def cut_names(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' names as a list that cuts them at 17 characters has them, matched to the master."""
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" "), F.col("s_nationkey").cast("string")).alias("name"))
    printed = s.select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.substring("name", 1, F.when(F.col("id") % 3 == 1, 18).otherwise(17))).alias("name"))
    return cut_name_match(printed, s, 18)


CUT_NAMES = """with s as (select s_suppkey as id, s_name || ' ' || s_nationkey as name from supplier),
  p as (select id as row, case id % 3 when 0 then name when 1 then substring(name, 1, 18) else substring(name, 1, 17) end as name from s),
  t as (select row, s.id, 1 as tier from p join s using (name) union all select row, s.id, 2 from p join s on length(p.name) = 18 and length(s.name) > 18 and substring(s.name, 1, 18) = p.name),
  g as (select row, tier, count(distinct id) as n, min(id) as id from t group by 1, 2), f as (select * from g qualify tier = min(tier) over (partition by row))
  select p.row, f.id, f.tier from p left join f on f.row = p.row and n = 1"""

HELD_FROM = "1999-01-01"


def holdout_score(spark: SparkSession, sf: str) -> DataFrame:
    """How well the past tells the future: the account that most of a vendor's lines of a cost centre had before a date, against its lines since; by vendor."""
    l = T.lines(spark, sf)
    past = l.where(F.col("line_date") < F.lit(HELD_FROM).cast("date")).groupBy("vendor_id", "cost_center", "gl").agg(F.count("*").alias("n"))
    told = past.groupBy("vendor_id", "cost_center").agg(F.max_by("gl", F.struct("n", "gl")).alias("predicted"))
    asked = l.where(F.col("line_date") >= F.lit(HELD_FROM).cast("date")).join(told, ["vendor_id", "cost_center"], "left")
    g = asked.groupBy("vendor_id").agg(F.count("*").alias("asked"), F.count("predicted").alias("told"), F.count_if(F.col("gl") == F.col("predicted")).alias("hits"))
    return g.withColumn("accuracy", F.round(F.try_divide("hits", "told"), 9))


HOLDOUT_SCORE = f"""with l as (select * from {L}), n as (select vendor_id, cost_center, gl, count(*) as n from l where line_date < date '{HELD_FROM}' group by 1, 2, 3),
  t as (select vendor_id, cost_center, arg_max(gl, (n, gl)) as predicted from n group by 1, 2),
  g as (select vendor_id, count(*) as asked, count(predicted) as told, count(*) filter (gl = predicted) as hits from l left join t using (vendor_id, cost_center) where line_date >= date '{HELD_FROM}' group by 1)
  select *, round(case when told > 0 then hits / told end, 9) as accuracy from g"""


def closing_objects(lines: DataFrame, voucher: list[str], object_: str, amount: str) -> DataFrame:
    """Which object closes vouchers: those where it alone stands on one side; it is the payable object where that is half of the balanced vouchers or more. ``amount`` is whole."""
    side = F.signum(F.col(amount)).cast("int")
    v = lines.where(F.col(amount) != 0).groupBy(*voucher).agg(F.sum(amount).alias("whole"), F.collect_set(F.when(side < 0, F.col(object_))).alias("credit"), F.collect_set(F.when(side > 0, F.col(object_))).alias("debit"))
    balanced = v.where("whole = 0 and size(credit) > 0 and size(debit) > 0")
    alone = F.filter(F.array(F.when(F.size("credit") == 1, F.get("credit", F.lit(0))), F.when(F.size("debit") == 1, F.get("debit", F.lit(0)))), lambda x: x.isNotNull())
    n = balanced.agg(F.count("*").alias("vouchers"))
    g = balanced.select(F.explode(alone).alias("object")).groupBy("object").agg(F.count("*").alias("closes"))
    return g.crossJoin(F.broadcast(n)).select("object", "closes", (F.col("closes") * 2 >= F.col("vouchers")).alias("payable"))  # one row


def payable_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Vouchers of an order's lines by account, each closed by a payable line of the rest."""
    l = T.lines(spark, sf).select("invoice_id", F.col("gl").alias("object"), F.col("quantity").cast("long").alias("amount"))
    close = l.groupBy("invoice_id").agg((-F.sum("amount")).alias("amount")).select("invoice_id", F.when(F.col("invoice_id") % 5 == 0, "2200").otherwise("2100").alias("object"), "amount")
    return closing_objects(l.unionByName(close), ["invoice_id"], "object", "amount")


PAYABLE_OBJECTS = f"""with l as (select invoice_id, gl as object, cast(quantity as bigint) as amount from {L}),
  b as (select * from l union all select invoice_id, case when invoice_id % 5 = 0 then '2200' else '2100' end, -sum(amount) from l group by 1, 2),
  v as (select invoice_id, count(distinct object) filter (amount < 0) as nc, min(object) filter (amount < 0) as oc, count(distinct object) filter (amount > 0) as nd, min(object) filter (amount > 0) as od from b group by 1 having sum(amount) = 0),
  c as (select oc as object from v where nc = 1 and nd > 0 union all select od from v where nd = 1 and nc > 0)
  select object, count(*) as closes, count(*) * 2 >= (select count(*) from v where nc > 0 and nd > 0) as payable from c group by 1"""


def load_partition(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of a table that the rows hold, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


QUERIES = [
    ("invoice_page", invoice_page, INVOICE_PAGE), ("account_lookup", account_lookup, ACCOUNT_LOOKUP), ("cut_names", cut_names, CUT_NAMES),
    ("holdout_score", holdout_score, HOLDOUT_SCORE), ("payable_objects", payable_objects, PAYABLE_OBJECTS),
]
