"""Reports over the audit trail: filters, windows, streaks, ageing, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.functions import keys as K
from quillmint.functions import stats as S
from quillmint.functions.money import out
from quillmint.operators import filters as Q
from quillmint.sources import tables as T

A, I, L, V = T.ACTIVITY, T.INVOICES, T.LINES, T.VENDORS


def event_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 200 purchases and clicks in a span of days."""
    e = T.activity(spark, sf).where(F.col("action").isin("purchase", "click") & (F.col("happened") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("happened") < F.lit("2024-01-22").cast("timestamp_ntz")))
    return e.orderBy(F.desc("event_id")).limit(200).select("event_id", "actor", "action")


EVENT_FILTER = f"""select event_id, actor, action from {A} where action in ('purchase', 'click') and happened >= timestamp '2024-01-08' and happened < timestamp '2024-01-22'
  order by event_id desc limit 200"""


def last_200(spark: SparkSession, sf: str) -> DataFrame:
    """Of each actor's latest 200 events: how many there are, in all, and the share of high values with its Wilson bound."""
    w = Window.partitionBy("actor").orderBy(F.desc("happened"), F.desc("event_id"))
    ranked = T.activity(spark, sf).withColumns({"n": F.row_number().over(w), "all_time": F.count("*").over(Window.partitionBy("actor"))}).where("n <= 200")
    g = ranked.groupBy("actor", "all_time").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("good"))
    return g.select("actor", "all_time", "n", "good", F.round(S.wilson_low(F.col("good"), F.col("n")), 9).alias("low"))


LAST_200 = f"""with r as (select *, row_number() over (partition by actor order by happened desc, event_id desc) as n, count(*) over (partition by actor) as all_time from {A}),
  g as (select actor, all_time, count(*) as n, count(*) filter (value >= 20) as good from r where n <= 200 group by 1, 2)
  select actor, all_time, n, good, round((good / n + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(good / n * (1 - good / n) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n), 9) as low from g"""


def clean_streak(spark: SparkSession, sf: str) -> DataFrame:
    """The leading run of an actor's newest events without a correction (here an error-like low value), and the last correction."""
    w = Window.partitionBy("actor").orderBy(F.desc("happened"), F.desc("event_id"))
    bad = (F.col("value") < 2).cast("int")
    running = T.activity(spark, sf).withColumn("bad", bad).withColumn("so_far", F.sum("bad").over(w))
    return running.groupBy("actor").agg(F.count_if(F.col("so_far") == 0).alias("streak"), F.max(F.when(F.col("bad") == 1, F.col("event_id"))).alias("last_correction"))


CLEAN_STREAK = f"""with r as (select *, sum(cast(value < 2 as integer)) over (partition by actor order by happened desc, event_id desc) as so_far from {A})
  select actor, count(*) filter (so_far = 0) as streak, max(case when value < 2 then event_id end) as last_correction from r group by actor"""


def latest_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 3 high-value events among the latest 20 of each actor."""
    w = Window.partitionBy("actor").orderBy(F.desc("happened"), F.desc("event_id"))
    some = T.activity(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 20 and value >= 50")
    return some.withColumn("k", F.row_number().over(w)).where("k <= 3").select("actor", "event_id", "k")


LATEST_CORRECTED = f"""with r as (select *, row_number() over (partition by actor order by happened desc, event_id desc) as n from {A}),
  s as (select *, row_number() over (partition by actor order by happened desc, event_id desc) as nth from r where n <= 20 and value >= 50)
  select actor, event_id, cast(nth as integer) as k from s where nth <= 3"""


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = T.activity(spark, sf).groupBy("actor", "action").agg(F.max_by(F.struct("event_id", "value"), F.struct("happened", "event_id")).alias("x"))
    return e.select("actor", "action", F.col("x.event_id").alias("event_id"), out(F.col("x.value")).alias("value"))


LATEST_PER_KEY = f"""select actor, action, event_id, cast(value as double) as value from
  (select *, row_number() over (partition by actor, action order by happened desc, event_id desc) as n from {A}) where n = 1"""


def day_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Longest and median gap between an actor's distinct days."""
    days = T.activity(spark, sf).select("actor", F.to_date("happened").alias("day")).distinct()
    w = Window.partitionBy("actor").orderBy("day")
    gaps = days.withColumn("gap", F.date_diff("day", F.lag("day").over(w)))
    return gaps.groupBy("actor").agg(F.count("*").alias("n_days"), F.max("gap").cast("int").alias("longest"), F.median("gap").alias("median_gap"))


DAY_GAPS = f"""with d as (select distinct actor, cast(happened as date) as day from {A}), g as (select *, date_diff('day', lag(day) over (partition by actor order by day), day) as gap from d)
  select actor, count(*) as n_days, cast(max(gap) as integer) as longest, median(gap) as median_gap from g group by actor"""


def decision_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The newest run of equal decisions (actions) of each actor: its action, length, and the run before it."""
    w = Window.partitionBy("actor").orderBy(F.desc("happened"), F.desc("event_id"))
    turned = T.activity(spark, sf).withColumn("turn", F.coalesce((F.col("action") != F.lag("action").over(w)).cast("int"), F.lit(0)))
    runs = turned.withColumn("run", F.sum("turn").over(w)).where("run <= 1")
    return runs.groupBy("actor").agg(
        F.max(F.when(F.col("run") == 0, F.col("action"))).alias("now"), F.count_if(F.col("run") == 0).alias("n_now"),
        F.max(F.when(F.col("run") == 1, F.col("action"))).alias("before"), F.count_if(F.col("run") == 1).alias("n_before"),
    )


DECISION_RUNS = f"""with t as (select *, coalesce(cast(action <> lag(action) over w as integer), 0) as turn from {A} window w as (partition by actor order by happened desc, event_id desc)),
  r as (select *, sum(turn) over (partition by actor order by happened desc, event_id desc) as run from t)
  select actor, max(case when run = 0 then action end) as now, count(*) filter (run = 0) as n_now, max(case when run = 1 then action end) as before, count(*) filter (run = 1) as n_before
  from r where run <= 1 group by actor"""


def weekly_series(spark: SparkSession, sf: str) -> DataFrame:
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "happened"), F.weekofyear("happened"))
    e = T.activity(spark, sf)
    return e.groupBy(week.alias("week")).agg(F.count("*").alias("processed"), F.count_if(F.col("value") >= 20).alias("clean"), F.count_if(F.col("action") == "purchase").alias("approved"), F.count_distinct("actor").alias("people"))


WEEKLY_SERIES = f"""select isoyear(happened) || '-W' || lpad(cast(week(happened) as varchar), 2, '0') as week, count(*) as processed, count(*) filter (value >= 20) as clean,
  count(*) filter (action = 'purchase') as approved, count(distinct actor) as people from {A} group by 1"""


def queue_ageing(spark: SparkSession, sf: str) -> DataFrame:
    """Open invoices by age bucket at a day, with the oldest and the median age."""
    age = F.date_diff(F.lit("1998-12-01").cast("date"), "invoice_date")
    bucket = F.when(age <= 30, "0-30").when(age <= 60, "31-60").when(age <= 90, "61-90").otherwise("over 90")
    i = T.invoices(spark, sf).where("status <> 'approved'").withColumns({"age": age, "bucket": bucket})
    return i.groupBy("bucket").agg(F.count("*").alias("n"), F.max("age").cast("int").alias("oldest"), F.median("age").alias("median_age"), out(F.sum("total")).alias("total"))


QUEUE_AGEING = f"""with i as (select *, date_diff('day', invoice_date, date '1998-12-01') as age from {I} where status <> 'approved')
  select case when age <= 30 then '0-30' when age <= 60 then '31-60' when age <= 90 then '61-90' else 'over 90' end as bucket, count(*) as n, cast(max(age) as integer) as oldest,
  median(age) as median_age, cast(sum(total) as double) as total from i group by 1"""


def controls(spark: SparkSession, sf: str) -> DataFrame:
    """Segregation of duties: actors that did two or more kinds of step for one case (k) on one day."""
    e = T.activity(spark, sf).groupBy("actor", "k", F.to_date("happened").alias("day")).agg(F.count_distinct("action").alias("kinds"), F.count("*").alias("n"))
    return e.groupBy("actor").agg(F.count_if(F.col("kinds") >= 2).alias("conflicts"), F.count("*").alias("cases"), F.sum("n").alias("events"))


CONTROLS = f"""with e as (select actor, k, cast(happened as date) as day, count(distinct action) as kinds, count(*) as n from {A} group by 1, 2, 3)
  select actor, count(*) filter (kinds >= 2) as conflicts, count(*) as cases, cast(sum(n) as bigint) as events from e group by actor"""


def top_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The eight commonest findings (here words of part names), ties by first appearance."""
    words = T.table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    g = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.col("p_partkey") * 64 + F.col("at")).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(8).select("word", "n")


TOP_FINDINGS = """with w as (select p_partkey, unnest(string_split(p_name, ' ')) as word, generate_subscripts(string_split(p_name, ' '), 1) - 1 as pos from part)
  select word, n from (select word, count(*) as n, min(p_partkey * 64 + pos) as first from w group by 1) order by n desc, first limit 8"""


def joined_values(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct account names of a vendor as one ordered text."""
    return T.lines(spark, sf).groupBy("vendor_id").agg(F.array_join(F.array_sort(F.collect_set("gl")), ", ").alias("accounts"))


JOINED_VALUES = f"select vendor_id, string_agg(distinct gl, ', ' order by gl) as accounts from {L} group by 1"


def learning_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted against corrected decisions (labels) by source, with accuracy."""
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("corrected"), F.max_by("doc_id", F.when(F.col("quality") == 0, F.col("doc_id"))).alias("latest_correction"))
    return g.withColumn("accuracy", F.round(F.col("accepted") / (F.col("accepted") + F.col("corrected")), 9))


LEARNING_METRICS = """select source, count(*) filter (quality = 1) as accepted, count(*) filter (quality = 0) as corrected, max(case when quality = 0 then doc_id end) as latest_correction,
  round(count(*) filter (quality = 1) / count(*), 9) as accuracy from documents join labels using (doc_id) group by source"""


def touchless(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices whose every line is clean (no return), by company: an all-of aggregate."""
    l = T.lines(spark, sf).groupBy("invoice_id").agg(F.bool_and(F.col("return_flag") != "R").alias("clean"), F.count_distinct("gl").alias("accounts"))
    j = T.invoices(spark, sf).join(l, "invoice_id")
    return j.groupBy("status").agg(F.count_if("clean").alias("touchless"), F.count("*").alias("n"), F.max("accounts").alias("most_accounts"))


TOUCHLESS = f"""with l as (select invoice_id, bool_and(return_flag <> 'R') as clean, count(distinct gl) as accounts from {L} group by 1)
  select status, count(*) filter (clean) as touchless, count(*) as n, max(accounts) as most_accounts from {I} i join l using (invoice_id) group by 1"""


def vendor_workload(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors of 500 lines or more: share of returned lines and their three commonest accounts."""
    l = T.lines(spark, sf)
    g = l.groupBy("vendor_id").agg(F.count("*").alias("n"), F.count_if(F.col("return_flag") == "R").alias("problems")).where("n >= 500")
    top = l.where("return_flag = 'R'").groupBy("vendor_id", "gl").agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(Window.partitionBy("vendor_id").orderBy(F.desc("c"), "gl"))).where("k <= 3")
    names = top.groupBy("vendor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "gl"))), lambda x: x["gl"]), ", ").alias("top3"))
    return g.join(names, "vendor_id", "left").select("vendor_id", "n", F.round(F.col("problems") / F.col("n"), 9).alias("rate"), "top3")


VENDOR_WORKLOAD = f"""with l as (select * from {L}), g as (select vendor_id, count(*) as n, count(*) filter (return_flag = 'R') as problems from l group by 1 having count(*) >= 500),
  t as (select vendor_id, gl, row_number() over (partition by vendor_id order by count(*) desc, gl) as k from l where return_flag = 'R' group by 1, 2),
  s as (select vendor_id, string_agg(gl, ', ' order by k) as top3 from t where k <= 3 group by 1)
  select g.vendor_id, n, round(problems / n, 9) as rate, top3 from g left join s using (vendor_id)"""


def query_by_example(spark: SparkSession, sf: str) -> DataFrame:
    typed = {"total": "250000..100000", "invoice_date": "1994-11..1996", "status": "!review", "priority": "*urg*", "company_id": "about ten"}
    kinds = {"total": "amount", "invoice_date": "date", "status": "choice", "priority": "text", "company_id": "amount"}
    found, _problems = Q.by_example(T.invoices(spark, sf), typed, kinds)
    return found.select("invoice_id", out(F.col("total")).alias("total"), "invoice_date")


QUERY_BY_EXAMPLE = f"""select invoice_id, cast(total as double) as total, invoice_date from {I} where total between 99999.995 and 250000.005
  and invoice_date >= date '1994-11-01' and invoice_date < date '1997-01-01' and status <> 'review' and lower(priority) like '%urg%'"""


def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return Q.after_key(T.invoices(spark, sf), ["company_id", "invoice_id"], [40, 1000], 50).select("company_id", "invoice_id")


KEYSET_PAGE = f"select company_id, invoice_id from {I} where (company_id, invoice_id) > (40, 1000) order by 1, 2 limit 50"


def semi_and_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with an invoice under review and without a pending one."""
    i = T.invoices(spark, sf)
    c = i.select("company_id").distinct()
    return c.join(i.where("status = 'review'"), "company_id", "left_semi").join(i.where("status = 'pending_approval'"), "company_id", "left_anti")


SEMI_AND_ANTI = f"""with i as (select * from {I}) select distinct company_id from i where company_id in (select company_id from i where status = 'review')
  and not exists (select 1 from i j where j.company_id = i.company_id and status = 'pending_approval')"""


def quick_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search of vendors by words: every word must occur; name words score 1, an exact number 6, a part of it 3."""
    v = T.vendors(spark, sf)
    name, number = K.fold(F.concat_ws(" ", "vendor_name", "province", "country")), F.col("vendor_id").cast("string")
    score, ok = F.lit(0), F.lit(True)
    for word in ("supplier", "a", "1"):
        exact, part, named = number == word, number.contains(word), name.contains(word)
        ok = ok & (part | named)
        score = score + F.when(exact, 6).when(part, 3).otherwise(0) + F.when(named, 1).otherwise(0)
    return v.withColumn("score", score).where(ok).orderBy(F.desc("score"), F.desc("vendor_id")).limit(50).select("vendor_id", "score")


QUICK_SEARCH = f"""with v as (select vendor_id, cast(vendor_id as varchar) as n, lower(vendor_name || ' ' || province || ' ' || country) as t from {V}),
  s as (select vendor_id, {" + ".join(f"case when n = '{w}' then 6 when contains(n, '{w}') then 3 else 0 end + case when contains(t, '{w}') then 1 else 0 end" for w in ("supplier", "a", "1"))} as score
    from v where {" and ".join(f"(contains(n, '{w}') or contains(t, '{w}'))" for w in ("supplier", "a", "1"))})
  select vendor_id, cast(score as integer) as score from s order by score desc, vendor_id desc limit 50"""


def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices that a deterministic five per cent audit takes."""
    return T.invoices(spark, sf).where(S.sampled("audit-", F.col("invoice_id"), 0.05)).select("invoice_id", "status")


AUDIT_SAMPLE = f"select invoice_id, status from {I} where cast(('0x' || substr(sha256('audit-' || invoice_id), 1, 13)) as ubigint) / 4503599627370496.0 < 0.05"


def coding_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted past codings of a vendor (age half-life twelve months): the dominant account, its share, and whether it is sure."""
    months = F.floor(F.months_between(F.lit("1998-12-01").cast("date"), F.trunc("line_date", "month"))).cast("int")
    w = T.lines(spark, sf).withColumn("years", F.floor(F.greatest(months, F.lit(0)) / 12)).groupBy("vendor_id", "gl").agg(F.sum(F.pow(F.lit(0.5), F.col("years"))).alias("weight"), F.count("*").alias("n"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("vendor_id"))
    top = w.withColumn("share", share).withColumn("k", F.row_number().over(Window.partitionBy("vendor_id").orderBy(F.desc("weight"), "gl"))).where("k = 1")
    return top.select("vendor_id", "gl", F.round("share", 9).alias("share"), ((F.col("share") >= 0.9) & (F.col("n") >= 3)).alias("sure"))


CODING_PRIOR = f"""with w as (select vendor_id, gl, sum(pow(0.5, greatest(date_diff('month', date_trunc('month', line_date), date '1998-12-01'), 0) // 12)) as weight, count(*) as n from {L} group by 1, 2),
  s as (select *, weight / sum(weight) over (partition by vendor_id) as share, row_number() over (partition by vendor_id order by weight desc, gl) as k from w)
  select vendor_id, gl, round(share, 9) as share, share >= 0.9 and n >= 3 as sure from s where k = 1"""


def confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of independent readings (here documents of a source by language): noisy-or of their reliabilities, and the strongest rival."""
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    r = d.groupBy("lang", "source").agg(F.avg("quality").alias("p"))
    g = r.groupBy("source").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.95)) * 0.5))), 9).alias("joint"), F.count("*").alias("readings"), F.round(F.max("p"), 9).alias("strongest"))
    return g


CONFIDENCE = """with r as (select lang, source, avg(quality) as p from documents join labels using (doc_id) group by 1, 2)
  select source, round(1 - exp(sum(ln(1 - least(p, 0.95) * 0.5))), 9) as joint, count(*) as readings, round(max(p), 9) as strongest from r group by 1"""


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to send after a change of the events table: new and changed ones as upserts (4), missing ones as deletes (2)."""
    from quillmint.sources.feeds import changes

    e = T.activity(spark, sf).select("event_id", "action", "k")
    before = e.where("event_id % 11 <> 0").withColumn("k", F.when(F.col("event_id") % 13 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return changes(before, e.where("event_id % 17 <> 0"), ["event_id"])


CHANGE_FEED = f"""with e as (select event_id, action, k from {A}), b as (select event_id, action, case when event_id % 13 = 0 then k + 1 else k end as k from e where event_id % 11 <> 0),
  n as (select * from e where event_id % 17 <> 0)
  select event_id, action, k, 4 as row_marker from (select * from n except select * from b) union all
  select event_id, cast(null as varchar), cast(null as integer), 2 from b where event_id not in (select event_id from n)"""


def approx_people(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct actors an hour, exact beside approximate (an addition)."""
    # Beside a distinct count in one step, the sketch would be kept for every hour and actor.
    met = T.activity(spark, sf).select(F.hour("happened").alias("hour"), "actor").distinct()
    return met.groupBy("hour").agg(F.count("actor").alias("people"), (F.abs(F.approx_count_distinct("actor", 0.01) - F.count("actor")) <= 0.1 * F.count("actor")).alias("close"))


APPROX_PEOPLE = f"select cast(hour(happened) as integer) as hour, count(distinct actor) as people, true as close from {A} group by 1"

QUERIES = [
    ("event_filter", event_filter, EVENT_FILTER), ("last_200", last_200, LAST_200), ("clean_streak", clean_streak, CLEAN_STREAK), ("latest_corrected", latest_corrected, LATEST_CORRECTED),
    ("latest_per_key", latest_per_key, LATEST_PER_KEY), ("day_gaps", day_gaps, DAY_GAPS), ("decision_runs", decision_runs, DECISION_RUNS), ("weekly_series", weekly_series, WEEKLY_SERIES),
    ("queue_ageing", queue_ageing, QUEUE_AGEING), ("controls", controls, CONTROLS), ("top_findings", top_findings, TOP_FINDINGS), ("joined_values", joined_values, JOINED_VALUES),
    ("learning_metrics", learning_metrics, LEARNING_METRICS), ("touchless", touchless, TOUCHLESS), ("vendor_workload", vendor_workload, VENDOR_WORKLOAD),
    ("query_by_example", query_by_example, QUERY_BY_EXAMPLE), ("keyset_page", keyset_page, KEYSET_PAGE), ("semi_and_anti", semi_and_anti, SEMI_AND_ANTI), ("quick_search", quick_search, QUICK_SEARCH),
    ("audit_sample", audit_sample, AUDIT_SAMPLE), ("coding_prior", coding_prior, CODING_PRIOR), ("label_confidence", confidence, CONFIDENCE), ("change_feed", change_feed, CHANGE_FEED),
    ("approx_people", approx_people, APPROX_PEOPLE),
]
