"""Suppliers' autonomy: which suppliers skip review, from the outcomes of their invoices, as a stream and replayed.

A supplier is supervised until its record meets a policy, then autonomous: only invoices drawn for an audit are looked at,
and an error found in one suspends it, until the policy is met again by a fresh run of clean invoices. A lead may hold a
supplier under review and release it. A supplier without an invoice for a while starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "supplier long, event_id long, at timestamp, fields int, errors int, lead string, drawn boolean"
STATES = "supplier long, event_id long, state string, looked_at boolean, seen long, clean long, clean_fields long, window_fields long, window_errors long, bound double"
STAND = "state string, seen long, clean long, clean_fields long, last_at timestamp"
RING = "fields int, errors int"


@dataclass(frozen=True)
class Policy:
    """When a supplier may skip review. Invoices seen, clean ones in a row, the window, shares and z."""

    least_invoices: int = 20
    clean_run: int = 10
    window: int = 200
    window_share: float = 0.98
    run_bound: float = 0.99
    z: float = 1.645
    idle_days: int = 365

    def met(self, m: Memory) -> bool:
        fields, errors = sum(f for f, _ in m.ring), sum(e for _, e in m.ring)
        return m.seen >= self.least_invoices and m.clean >= self.clean_run and self.bound(m.clean_fields) >= self.run_bound and fields - errors >= self.window_share * fields

    def bound(self, right: int) -> float:
        """Wilson's lower bound of a share of which all cases were right."""
        return round(right / (right + self.z**2), 6) if right else 0.0


@dataclass
class Memory:
    state: str = "supervised"
    seen: int = 0
    clean: int = 0
    clean_fields: int = 0
    last_at: pd.Timestamp | None = None
    ring: list[tuple[int, int]] = field(default_factory=list)


def step(m: Memory, policy: Policy, supplier: int, event_id: int, at: pd.Timestamp, fields: int, errors: int, lead: str | None, drawn: bool) -> tuple[Memory, tuple]:
    """The memory after one outcome, and its row."""
    if m.last_at is not None and at - m.last_at > timedelta(days=policy.idle_days):
        m = Memory()
    m.last_at = at
    if lead == "hold":
        m.state = "held"
    elif lead == "release" and m.state == "held":
        m.state, m.clean, m.clean_fields = "supervised", 0, 0
    looked_at = m.state != "autonomous" or drawn
    if looked_at:
        m.ring = [*m.ring, (fields, errors)][-policy.window :]
        m.seen += 1
        if errors:
            m.clean = m.clean_fields = 0
            if m.state == "autonomous":
                m.state = "suspended"
        else:
            m.clean += 1
            m.clean_fields += fields
        if m.state in ("supervised", "suspended") and policy.met(m):
            m.state = "autonomous"
    window = sum(f for f, _ in m.ring), sum(e for _, e in m.ring)
    return m, (supplier, event_id, m.state, looked_at, m.seen, m.clean, m.clean_fields, *window, policy.bound(m.clean_fields))


def _rows(f: pd.DataFrame) -> Iterator[tuple]:
    for supplier, event_id, at, fields, errors, lead, drawn in f[["supplier", "event_id", "at", "fields", "errors", "lead", "drawn"]].itertuples(index=False, name=None):
        yield supplier, event_id, at, int(fields), int(errors), None if pd.isna(lead) else lead, bool(drawn)


_NAMES = [c.split()[0] for c in STATES.split(", ")]


class AutonomyProcessor(StatefulProcessor):
    """A supplier's stand in one state variable, its last outcomes in another; an event-time timer forgets idle suppliers."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stand = handle.getValueState("stand", STAND)
        self.ring = handle.getListState("ring", RING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = Memory(ring=[(int(f), int(e)) for f, e in self.ring.get()])
        if self.stand.exists():
            state, seen, clean, clean_fields, last_at = self.stand.get()
            m.state, m.seen, m.clean, m.clean_fields, m.last_at = state, seen, clean, clean_fields, pd.Timestamp(last_at)
        out = []
        for row in _rows(pd.concat(list(rows)).sort_values(["at", "event_id"])):
            m, told = step(m, self.policy, *row)
            out.append(told)
        self.stand.update((m.state, m.seen, m.clean, m.clean_fields, m.last_at.to_pydatetime()))
        self.ring.put(m.ring)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(m.last_at.timestamp() * 1000) + self.policy.idle_days * 86_400_000 + 1)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stand.clear()
        self.ring.clear()
        yield pd.DataFrame({n: [] for n in _NAMES})

    def close(self) -> None:
        pass


def autonomy_stream(outcomes: DataFrame, policy: Policy = Policy(), late: str = "1 hour") -> DataFrame:
    """Each outcome's state, as outcomes come; those of a batch are taken in (at, event_id) order. Needs the RocksDB state store."""
    watched = outcomes.withWatermark("at", late)
    return watched.groupBy("supplier").transformWithStateInPandas(AutonomyProcessor(policy), STATES, "Append", "EventTime")


def autonomy_replay(outcomes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The same states from a whole table: a task walks through its suppliers' outcomes in order and holds one supplier's memory."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        supplier, m = None, Memory()
        for f in frames:
            out = []
            for row in _rows(f):
                if row[0] != supplier:
                    supplier, m = row[0], Memory()
                m, told = step(m, policy, *row)
                out.append(told)
            yield pd.DataFrame(out, columns=_NAMES)

    names = [c.split()[0] for c in OUTCOMES.split(", ")]
    dealt = outcomes.select(*names).repartition("supplier").sortWithinPartitions("supplier", "at", "event_id")
    return dealt.mapInPandas(walk, STATES)


def outcomes_of(events: DataFrame) -> DataFrame:
    """Outcomes from audit events: errors of small value are errors of a field, a twentieth of the invoices is drawn, some actions are a lead's."""
    k = F.get_json_object("props", "$.k").cast("int")
    lead = F.when((F.col("event_type") == "signup") & (k == 7), "hold").when((F.col("event_type") == "signup") & (k % 10 == 3), "release")
    return events.select(
        F.col("user_id").alias("supplier"), "event_id", F.col("ts").cast("timestamp").alias("at"), (k % 9 + 4).cast("int").alias("fields"),
        F.when((F.col("event_type") == "error") & (F.col("value") < 12), 1).otherwise(0).alias("errors"), lead.alias("lead"), (F.col("event_id") * 7919 % 20 == 0).alias("drawn"),
    )


#: A policy that suppliers of the given tables can meet; a supplier idle for some days starts anew.
EASY = Policy(least_invoices=6, clean_run=4, window=12, window_share=0.97, run_bound=0.90, idle_days=12)


def autonomy_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state of every supplier after each of its outcomes."""
    return autonomy_replay(outcomes_of(spark.read.parquet(f"{sf}/events.parquet")), EASY)


AUTONOMY_STATES = f"""with recursive o as (select user_id as supplier, event_id, ts as happened, cast(json_extract_string(props, '$.k') as integer) as k, event_type, value from events),
  e as (select supplier, event_id, happened, k % 9 + 4 as fields, case when event_type = 'error' and value < 12 then 1 else 0 end as errors,
    case when event_type = 'signup' and k = 7 then 'hold' when event_type = 'signup' and k % 10 = 3 then 'release' end as lead, event_id * 7919 % 20 = 0 as drawn,
    row_number() over (partition by supplier order by happened, event_id) as n, coalesce(happened - lag(happened) over (partition by supplier order by happened, event_id) > interval {EASY.idle_days} day, true) as anew from o),
  s as (
    select supplier, 0::bigint as n, null::bigint as event_id, 'supervised' as state, false as looked_at, 0::bigint as seen, 0::bigint as clean, 0::bigint as clean_fields, []::struct(f integer, e integer)[] as ring from (select distinct supplier from e)
    union all
    select supplier, n, event_id,
      case when state1 = 'autonomous' and looked and errors > 0 then 'suspended' when state1 in ('supervised', 'suspended') and looked and seen2 >= {EASY.least_invoices} and clean2 >= {EASY.clean_run}
        and round(clean_fields2 / (clean_fields2 + power({EASY.z}::double, 2)), 6) >= {EASY.run_bound} and list_sum(list_transform(ring2, lambda x: x.f - x.e)) >= {EASY.window_share}::double * list_sum(list_transform(ring2, lambda x: x.f)) then 'autonomous' else state1 end,
      looked, seen2, clean2, clean_fields2, ring2
    from (select *, seen1 + looked::int as seen2, case when not looked then clean1 when errors > 0 then 0 else clean1 + 1 end as clean2, case when not looked then clean_fields1 when errors > 0 then 0 else clean_fields1 + fields end as clean_fields2,
        case when looked then list_concat(ring1, [{{'f': fields, 'e': errors}}])[-{EASY.window}:] else ring1 end as ring2
      from (select *, state1 <> 'autonomous' or drawn as looked
        from (select supplier, n, event_id, fields, errors, drawn, ring1, seen1, case when lead = 'hold' then 'held' when lead = 'release' and state0 = 'held' then 'supervised' else state0 end as state1,
            case when lead = 'release' and state0 = 'held' then 0 else clean0 end as clean1, case when lead = 'release' and state0 = 'held' then 0 else clean_fields0 end as clean_fields1
          from (select e.*, case when anew then 'supervised' else state end as state0, case when anew then 0 else seen end as seen1, case when anew then 0 else clean end as clean0,
              case when anew then 0 else clean_fields end as clean_fields0, case when anew then [] else ring end as ring1 from s join e on s.supplier = e.supplier and e.n = s.n + 1)))))
  select supplier, event_id, state, looked_at, seen, clean, clean_fields, coalesce(list_sum(list_transform(ring, lambda x: x.f)), 0)::bigint as window_fields, coalesce(list_sum(list_transform(ring, lambda x: x.e)), 0)::bigint as window_errors,
    case when clean_fields > 0 then round(clean_fields / (clean_fields + power({EASY.z}::double, 2)), 6) else 0 end as bound from s where n > 0"""

QUERIES = [("autonomy_states", autonomy_states, AUTONOMY_STATES)]
