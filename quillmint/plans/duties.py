"""Separation of duties over the audit trail: who did several steps of a case, overrode a refusal, or approved alone over the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.operators.carry import filled
from quillmint.sources import tables as T

STEPS = ("entered", "approved", "final", "exported")
LIMIT_CENTS = 20_000


def trail(spark: SparkSession, sf: str) -> DataFrame:
    """Events as steps of cases: a case is a number and a day, its currency goes by the number."""
    e = T.activity(spark, sf)
    step = F.when(F.col("action") == "signup", "entered").when(F.col("action") == "click", "approved").when(F.col("action") == "purchase", "final").when(F.col("action") == "view", "exported").otherwise("refused")
    currency = F.element_at(F.array(*map(F.lit, ("CAD", "USD", "EUR"))), F.col("k") % 3 + 1)
    return e.select("k", F.to_date("happened").alias("day"), "happened", "event_id", F.col("actor").alias("person"), step.alias("step"), currency.alias("currency"), (F.col("value") * 100).cast("long").alias("cents"))


TRAIL = f"""(select k, cast(happened as date) as day, happened, event_id, actor as person,
  case action when 'signup' then 'entered' when 'click' then 'approved' when 'purchase' then 'final' when 'view' then 'exported' else 'refused' end as step,
  case k % 3 when 0 then 'CAD' when 1 then 'USD' else 'EUR' end as currency, cast(value * 100 as bigint) as cents from {T.ACTIVITY})"""


def published_rates(steps: DataFrame) -> DataFrame:
    """A currency's rate in ten-thousandths, published on days with an export in it; home currency is always 1."""
    foreign = steps.where("step = 'exported' and currency <> 'CAD'").groupBy("currency", "day").agg((5000 + F.sum("cents") % 10000).alias("rate"))
    return foreign


def rate_calendar(published: DataFrame, last: DataFrame) -> DataFrame:
    """A currency's rate in force on every day from the first one published to its ``last_day`` in ``last``.

    A row for each day makes an as-of join one of equal keys, so that no currency becomes one task.
    """
    following = F.lead("day").over(Window.partitionBy("currency").orderBy("day"))
    spans = published.withColumn("until", F.date_sub(following, 1)).join(last, "currency")
    until = F.greatest(F.coalesce("until", "last_day"), "day")
    return spans.select("currency", F.explode(F.sequence("day", until)).alias("day"), "rate")


def conflicts(steps: DataFrame, calendar: DataFrame, limit: int) -> DataFrame:
    """Case (k, day), person, pattern and what shows it. A person's steps are told apart, their repetition is not.

    * ``several_steps``: two or more of the four steps of a case; ``own_entry``: entered and approved it
    * ``override``: approved after a refusal, with no entry between
    * ``alone_over_limit``: the only approver of a case with an approval over the limit in home currency, at the rate
      in force on the day; without a rate the amount may be any, which counts as over
    """
    case = ["k", "day"]
    named = steps.where("person is not null")
    did = {s: F.max(F.col("step") == s).alias(s) for s in STEPS}
    by_person = named.where(F.col("step").isin(*STEPS)).groupBy(*case, "person").agg(*did.values())
    done = F.array_compact(F.array(*(F.when(F.col(s), s) for s in STEPS)))
    several = by_person.where(F.size(done) > 1).select(*case, "person", F.lit("several_steps").alias("pattern"), F.array_join(done, ", ").alias("evidence"))
    own = by_person.where("entered and (approved or final)").select(*case, "person", F.lit("own_entry").alias("pattern"), F.array_join(done, ", ").alias("evidence"))

    marked = steps.select(*case, "happened", "event_id", "person", "step", F.when(F.col("step").isin("refused", "entered"), F.struct("step", "event_id")).alias("mark"))
    after = filled(marked, case, ["happened", "event_id"], ["mark"]).where("step in ('approved', 'final') and mark.step = 'refused' and person is not null")
    override = after.groupBy(*case, "person").agg(F.min("mark.event_id").alias("n")).select(*case, "person", F.lit("override").alias("pattern"), F.concat(F.lit("refused by event "), "n").alias("evidence"))

    approvals = named.where("step in ('approved', 'final')").join(calendar, ["currency", "day"], "left")
    rate = F.when(F.col("currency") == "CAD", F.lit(10000)).otherwise(F.col("rate"))
    home = approvals.withColumn("home", F.floor((F.col("cents") * rate + 5000) / 10000).cast("long"))
    most = home.groupBy(*case).agg(F.min("person").alias("person"), F.max("person").alias("other"), F.max("home").alias("home"), F.max(F.col("home").isNull()).alias("unrated"))
    over = most.where((F.col("person") == F.col("other")) & ((F.col("home") > limit) | F.col("unrated")))
    alone = over.select(*case, "person", F.lit("alone_over_limit").alias("pattern"), F.when(F.col("unrated"), "no rate").otherwise(F.col("home").cast("string")).alias("evidence"))
    return several.unionByName(own).unionByName(override).unionByName(alone)


def duty_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every breach of separated duties: case, person, pattern, evidence."""
    steps = trail(spark, sf)
    return conflicts(steps, rate_calendar(published_rates(steps), steps.groupBy("currency").agg(F.max("day").alias("last_day"))), LIMIT_CENTS)


DUTY_CONFLICTS = f"""with t as (select * from {TRAIL}),
  r as (select currency, day, 5000 + cast(sum(cents) as bigint) % 10000 as rate from t where step = 'exported' and currency <> 'CAD' group by 1, 2),
  p as (select k, day, person, bool_or(step = 'entered') as entered, bool_or(step = 'approved') as approved, bool_or(step = 'final') as final_, count(distinct step) as n,
    concat_ws(', ', max(step) filter (step = 'entered'), max(step) filter (step = 'approved'), max(step) filter (step = 'final'), max(step) filter (step = 'exported')) as evidence
    from t where step <> 'refused' and person is not null group by 1, 2, 3),
  m as (select *, last_value(case when step in ('refused', 'entered') then step end ignore nulls) over w as mark,
    last_value(case when step in ('refused', 'entered') then event_id end ignore nulls) over w as mark_id from t window w as (partition by k, day order by happened, event_id)),
  h as (select t.k, t.day, t.person, case when t.currency = 'CAD' then t.cents else
    (t.cents * (select arg_max(r.rate, r.day) from r where r.currency = t.currency and r.day <= t.day) + 5000) // 10000 end as home
    from t where step in ('approved', 'final') and person is not null),
  o as (select k, day, min(person) as person, max(home) as home, bool_or(home is null) as unrated from h group by 1, 2 having min(person) = max(person))
  select k, day, person, 'several_steps' as pattern, evidence from p where n > 1
  union all select k, day, person, 'own_entry', evidence from p where entered and (approved or final_)
  union all select k, day, person, 'override', 'refused by event ' || min(mark_id) from m where step in ('approved', 'final') and mark = 'refused' and person is not null group by 1, 2, 3
  union all select k, day, person, 'alone_over_limit', case when unrated then 'no rate' else cast(home as varchar) end from o where unrated or home > {LIMIT_CENTS}"""


def duty_report(spark: SparkSession, sf: str) -> DataFrame:
    """Person by pattern: cases, and the days of the first and the last."""
    g = duty_conflicts(spark, sf).groupBy("person", "pattern")
    return g.agg(F.count("*").alias("cases"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


DUTY_REPORT = f"select person, pattern, count(*) as cases, min(day) as first_day, max(day) as last_day from ({DUTY_CONFLICTS}) group by 1, 2"

QUERIES = [("duty_conflicts", duty_conflicts, DUTY_CONFLICTS), ("duty_report", duty_report, DUTY_REPORT)]
