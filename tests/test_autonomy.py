"""Suppliers' autonomy: the stream equals the replay, across batches and restarts."""

import datetime as dt

import pytest

from quillmint.streaming import autonomy as A
from quillmint.streaming.maintain import run_to
from tests.conftest import SF

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_replay_across_restarts(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
        outcomes = A.outcomes_of(events)
        source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
        n = outcomes.count()
        order = outcomes.orderBy("at", "event_id").collect()
        for part in (order[: n // 3], order[n // 3 : n // 2], order[n // 2 :]):
            spark.createDataFrame(part, outcomes.schema).write.mode("append").parquet(source)
            stream = spark.readStream.schema(outcomes.schema).parquet(source)
            run_to(A.autonomy_stream(stream, A.EASY), out, checkpoint)  # every run is a restart
        assert rows(spark.read.parquet(out)) == rows(A.autonomy_replay(outcomes, A.EASY))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def walk(outcomes, policy):
    m, states = A.Memory(), []
    for k, (day, fields, errors, lead, drawn) in enumerate(outcomes):
        m, row = A.step(m, policy, 1, k, dt.datetime(2024, 1, 1) + dt.timedelta(day), fields, errors, lead, drawn)
        states.append(row[2])
    return states, m


def test_steps():
    policy = A.Policy(least_invoices=3, clean_run=2, window=4, window_share=0.7, run_bound=0.5, idle_days=30)
    clean, wrong = (9, 0, None, False), (9, 1, None, True)
    states, m = walk([(d, *x) for d, x in enumerate([clean] * 4 + [(9, 1, None, False), wrong, clean, clean])], policy)
    # A fault in an invoice that nobody looks at is not found; one that an audit draws suspends, a fresh run lifts it.
    assert states == ["supervised", "supervised", "autonomous", "autonomous", "autonomous", "suspended", "suspended", "autonomous"]
    assert m.ring == [(9, 0), (9, 1), (9, 0), (9, 0)]
    states, _ = walk([(0, *clean), (1, *clean), (2, *clean), (3, 9, 0, "hold", False), (4, *clean), (5, 9, 0, "release", False), (6, *clean)], policy)
    assert states == ["supervised", "supervised", "autonomous", "held", "held", "supervised", "autonomous"]
    states, m = walk([(0, *clean), (1, *clean), (2, *clean), (90, *clean)], policy)
    assert states[-1] == "supervised" and m.seen == 1


@pytest.mark.parametrize("right, bound", [(0, 0.0), (10, 0.787028), (268, 0.990004)])
def test_bound(right, bound):
    assert A.Policy().bound(right) == pytest.approx(bound, abs=1e-6)
