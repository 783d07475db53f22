"""The payables view of the star-schema tables: one adapter per concept, and its SQL twin.

Orders are invoices, line items are invoice lines, suppliers are vendors, part types are ledger accounts, part brands
are cost centres, and events are the audit trail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.functions.money import dec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "review").otherwise("pending_approval")
    return o.select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("company_id"), status.alias("status"), dec("o_totalprice").alias("total"),
        F.to_date("o_orderdate").alias("invoice_date"), F.col("o_orderpriority").alias("priority"),
    )


INVOICES = """(select o_orderkey as invoice_id, o_custkey as company_id,
  case o_orderstatus when 'F' then 'approved' when 'O' then 'review' else 'pending_approval' end as status,
  cast(o_totalprice as decimal(18,2)) as total, cast(o_orderdate as date) as invoice_date, o_orderpriority as priority from orders)"""


def lines(spark: SparkSession, sf_dir: str, parts: bool = True) -> DataFrame:
    """Invoice lines. Without ``parts`` the part table is not joined and gl, cost_center, description and category are absent."""
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_number"), F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("part_id"),
        F.to_date("l_shipdate").alias("line_date"), dec("l_quantity").alias("quantity"), dec("l_extendedprice").alias("amount"), dec("l_discount").alias("discount"),
        dec("l_tax").alias("tax_rate"), F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"),
    )
    if not parts:
        return l
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_type").alias("gl"), F.col("p_brand").alias("cost_center"), F.col("p_name").alias("description"), F.substring_index("p_type", " ", 1).alias("category"),
    )
    return l.join(p, "part_id")


LINES = """(select l_orderkey as invoice_id, l_linenumber as line_number, l_suppkey as vendor_id, l_partkey as part_id, cast(l_shipdate as date) as line_date,
  cast(l_quantity as decimal(18,2)) as quantity, cast(l_extendedprice as decimal(18,2)) as amount, cast(l_discount as decimal(18,2)) as discount,
  cast(l_tax as decimal(18,2)) as tax_rate, l_returnflag as return_flag, l_linestatus as line_status, p_type as gl, p_brand as cost_center,
  p_name as description, split_part(p_type, ' ', 1) as category from lineitem join part on l_partkey = p_partkey)"""


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.col("n_name").alias("province"), F.col("r_name").alias("country"), dec("s_acctbal").alias("balance"))


VENDORS = """(select s_suppkey as vendor_id, s_name as vendor_name, n_name as province, r_name as country, cast(s_acctbal as decimal(18,2)) as balance
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("ts").alias("happened"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), dec("value").alias("value"), k.alias("k"))


ACTIVITY = """(select event_id, ts as happened, user_id as actor, event_type as action, cast(value as decimal(18,2)) as value,
  cast(json_extract_string(props, '$.k') as integer) as k from events)"""
