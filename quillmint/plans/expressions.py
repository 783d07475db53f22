"""Queries that run the column expressions over the tables: keys, parsing, dates, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.functions import dates as D
from quillmint.functions import keys as K
from quillmint.functions.money import dec, out, within
from quillmint.operators.filters import glob
from quillmint.sources import tables as T

LEGAL = "|".join(K.LEGAL_FORMS)


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison keys of decorated supplier names."""
    s = T.table(spark, sf, "supplier")
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(" Éłč&œ šőś ")), F.when(F.col("s_suppkey") % 3 == 0, ", Inc.").when(F.col("s_suppkey") % 3 == 1, " Co. Ltd").otherwise(""))
    return s.select("s_suppkey", K.name_key(name).alias("key"), K.number_key(F.concat(F.lit("INV-00"), F.col("s_suppkey").cast("string"))).alias("number"), K.padded(F.col("s_suppkey").cast("string")).alias("company"))


NAME_KEYS = f"""with n as (select s_suppkey, replace(s_name, '#', ' Éłč&œ šőś ') || case s_suppkey % 3 when 0 then ', Inc.' when 1 then ' Co. Ltd' else '' end as name from supplier),
  f as (select *, trim(regexp_replace(replace(replace(strip_accents(lower(name)), 'œ', 'oe'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) as w from n)
  select s_suppkey, regexp_replace(w, '( ({LEGAL}))+$', '') as key, coalesce(nullif(ltrim('00' || s_suppkey, '0'), ''), '0') as number, lpad(cast(s_suppkey as varchar), 5, '0') as company from f"""


def account_masks(spark: SparkSession, sf: str) -> DataFrame:
    c = T.table(spark, sf, "customer")
    number = F.concat(F.lit("003-"), F.lpad(F.col("c_custkey").cast("string"), 8, "7"))
    return c.select("c_custkey", K.masked(number).alias("masked"), K.luhn(number).alias("luhn"), K.first_words("c_mktsegment").alias("words"), K.safe_cell(F.concat(F.lit("-"), F.col("c_name"))).alias("cell"), K.safe_cell(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("number_cell"))


ACCOUNT_MASKS = """with n as (select *, '003' || lpad(cast(c_custkey as varchar), 8, '7') as d from customer),
  l as (select *, list_sum(list_transform(range(1, 12), lambda i: case when (11 - i) % 2 = 1 then (cast(d[i] as integer) * 2) // 10 + (cast(d[i] as integer) * 2) % 10 else cast(d[i] as integer) end)) as t from n)
  select c_custkey, repeat('*', 7) || right(d, 4) as masked, t % 10 = 0 as luhn, lower(c_mktsegment) as words, '''-' || c_name as cell, cast(cast(c_acctbal as decimal(18,2)) as varchar) as number_cell from l"""


def parsed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts and dates written in the ways people type them, read back."""
    o = T.table(spark, sf, "orders").select("o_orderkey", dec("o_totalprice").alias("total"), F.to_date("o_orderdate").alias("d"))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("("), F.format_number("total", 2), F.lit(")"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.format_number("total", 2), F.lit(" CR")))
    text = text.when(F.col("o_orderkey") % 4 == 2, F.replace(F.col("total").cast("string"), F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("$ "), F.format_number("total", 2)))
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "yyyy-MM-dd")).otherwise(F.date_format("d", "dd.MM.yyyy"))
    return o.select("o_orderkey", out(D.parsed_amount(text)).alias("amount"), D.parsed_date(date).alias("day"))


PARSED_CELLS = """select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) * case when o_orderkey % 4 in (0, 1) then -1 else 1 end as double) as amount, cast(o_orderdate as date) as day from orders"""


def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    i = T.invoices(spark, sf)
    terms = F.when(F.col("invoice_id") % 3 == 0, "2% / 10 net 30").when(F.col("invoice_id") % 3 == 1, "EOM + 15").otherwise("due on receipt")
    due = D.due_dates(terms, F.col("invoice_date"))
    start, end = D.previous_quarter(F.col("invoice_date"))
    return i.select(
        "invoice_id", D.julian(F.col("invoice_date")).alias("julian"), (D.from_julian(D.julian(F.col("invoice_date"))) == F.col("invoice_date")).alias("round_trip"), D.period_end(F.col("invoice_date")).alias("period"),
        start.alias("quarter_start"), end.alias("quarter_end"), D.last_months(F.col("invoice_date"))[0].alias("year_start"), due["due"].alias("due"), due["discount_due"].alias("discount_due"),
        D.cadence(F.col("invoice_id") % 120).alias("cadence"),
    )


DATE_FUNCTIONS = f"""select invoice_id, cast((year(invoice_date) - 1900) * 1000 + dayofyear(invoice_date) as integer) as julian, true as round_trip,
  cast(case when day(invoice_date) <= 7 then last_day(cast(invoice_date - interval 1 month as date)) else last_day(invoice_date) end as date) as period,
  cast(date_trunc('quarter', invoice_date) - interval 3 month as date) as quarter_start, cast(date_trunc('quarter', invoice_date) - interval 1 day as date) as quarter_end,
  cast(date_trunc('month', invoice_date) - interval 11 month as date) as year_start,
  cast(case invoice_id % 3 when 0 then invoice_date + 30 when 1 then last_day(invoice_date) + 15 else invoice_date end as date) as due,
  case when invoice_id % 3 = 0 then cast(invoice_date + 10 as date) end as discount_due,
  case when invoice_id % 120 <= 10 then 'weekly' when invoice_id % 120 <= 20 then 'every two weeks' when invoice_id % 120 <= 45 then 'monthly' when invoice_id % 120 <= 75 then 'every two months'
    when invoice_id % 120 <= 110 then 'quarterly' else 'other' end as cadence from {T.INVOICES}"""


def json_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.array("event_id", "user_id").alias("ids"), F.from_json("props", "k int").alias("detail")))
    read = F.from_json(doc, "type string, ids array<long>, detail struct<k:int>")
    return e.select("event_id", read["type"].alias("type"), F.array_min(read["ids"]).alias("least"), F.array_contains(read["ids"], F.col("user_id")).alias("held"), read["detail"]["k"].alias("k"), F.try_parse_json(F.concat(F.lit("{"), "props")).isNull().alias("broken"))


JSON_FUNCTIONS = "select event_id, event_type as type, least(event_id, user_id) as least, true as held, cast(json_extract_string(props, '$.k') as integer) as k, true as broken from events"


def penalties(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of an invoice: every kind of finding on its lines multiplies once (error 0.6, warning 0.9)."""
    finding = F.when(F.col("return_flag") == "R", F.lit("error")).when(F.col("discount") >= 0.09, F.lit("deep discount")).when(F.col("tax_rate") == 0, F.lit("no tax"))
    g = T.lines(spark, sf).groupBy("invoice_id").agg(F.array_sort(F.collect_set(finding)).alias("kinds"))
    score = F.aggregate("kinds", F.lit(1.0), lambda acc, x: acc * F.when(x == "error", 0.6).otherwise(0.9))
    return g.select("invoice_id", F.round(score, 6).alias("confidence"), F.size("kinds").alias("n_kinds"))


PENALTIES = f"""with f as (select invoice_id, case when return_flag = 'R' then 'error' when discount >= 0.09 then 'deep discount' when tax_rate = 0 then 'no tax' end as kind from {T.LINES}),
  k as (select invoice_id, count(distinct kind) as n, count(distinct case when kind = 'error' then 1 end) as e from f group by 1)
  select invoice_id, cast(round(pow(0.6, e) * pow(0.9, n - e), 6) as double) as confidence, cast(n as integer) as n_kinds from k"""


def tolerances(spark: SparkSession, sf: str) -> DataFrame:
    """Line arithmetic: quantity times unit price against the amount, to the cent; and account patterns."""
    l = T.table(spark, sf, "lineitem").join(T.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    net = F.round(dec("l_quantity") * dec("p_retailprice"), 2)
    return l.groupBy("p_brand").agg(F.count_if(within(net, dec("l_extendedprice"), "1000")).alias("agree"), F.count("*").alias("n"), F.bool_or(glob(F.col("p_brand"), "Brand#[1-3]?")).alias("held"))


TOLERANCES = """select p_brand, count(*) filter (abs(round(cast(l_quantity as decimal(18,2)) * cast(p_retailprice as decimal(18,2)), 2) - cast(l_extendedprice as decimal(18,2))) <= 1000) as agree, count(*) as n,
  bool_or(regexp_full_match(p_brand, 'Brand#[1-3].')) as held from lineitem join part on l_partkey = p_partkey group by 1"""


def field_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed against approved fields, unpivoted: how often each agrees."""
    l = T.lines(spark, sf).withColumn("row", F.struct("invoice_id", "line_number", "part_id", "amount", "quantity"))
    long = l.select("category", F.expr("stack(3, 'gl', gl, description, 'flag', return_flag, line_status, 'center', cost_center, cost_center) as (field, proposed, approved)"))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("proposed").eqNullSafe(F.col("approved"))).alias("agree"))


FIELD_DIFFS = f"""select 'gl' as field, count(*) as n, count(*) filter (gl = description) as agree from {T.LINES} union all
  select 'flag', count(*), count(*) filter (return_flag = line_status) from {T.LINES} union all select 'center', count(*), count(*) from {T.LINES}"""


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Readers' scores in tenths (here of text length) against how often they were right."""
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    return d.groupBy(F.least(F.floor(F.col("n_chars") / 500), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("right"))


CALIBRATION = "select cast(least(n_chars // 500, 9) as integer) as bin, count(*) as n, round(avg(quality), 9) as right from documents join labels using (doc_id) group by 1"


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a turn and the next of its conversation, by role."""
    from pyspark.sql import Window

    c = T.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return c.withColumn("next_role", F.lead("role").over(w)).groupBy("role", "next_role").agg(F.count("*").alias("n"))


CONVERSATION_TURNS = "select role, next_role, count(*) as n from (select role, lead(role) over (partition by conv_id order by turn, role) as next_role from conversations) group by 1, 2"

QUERIES = [
    ("name_keys", name_keys, NAME_KEYS), ("account_masks", account_masks, ACCOUNT_MASKS), ("parsed_cells", parsed_cells, PARSED_CELLS), ("date_functions", date_functions, DATE_FUNCTIONS),
    ("json_functions", json_functions, JSON_FUNCTIONS), ("penalties", penalties, PENALTIES), ("tolerances", tolerances, TOLERANCES), ("field_diffs", field_diffs, FIELD_DIFFS),
    ("calibration", calibration, CALIBRATION), ("conversation_turns", conversation_turns, CONVERSATION_TURNS),
]
