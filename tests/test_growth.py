"""Work that must not grow faster than its input: rows that the operators of a finished plan put out, on small tables."""

from __future__ import annotations

import datetime

import pytest

from quillmint import registry
from tests.oracle import compare, connect

DAY = datetime.datetime(1996, 1, 1)


def operators(df):
    """(name, rows put out) of every operator of a collected plan."""

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(p.plan())
        else:
            rows = p.metrics().get("numOutputRows")
            yield name, rows.get().value() if rows.isDefined() else 0
            children = p.children()
            for n in range(children.size()):
                yield from walk(children.apply(n))

    df.collect()
    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def tables(spark, tmp_path):
    """Writes line items, parts and orders of a test as a folder of tables."""

    def write(lines, parts=()):
        items = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
        spark.createDataFrame(lines, items).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        named = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
        spark.createDataFrame(list(parts), named).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return write


def sql_of(name, sf):
    """The query's SQL on the tables of a test."""
    con = connect("/root/testdata/sf0.001")
    for t in ("lineitem", "part"):
        con.execute(f"create or replace view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return con, registry.oracle_sql()[name]


def test_suggestions_do_not_pair_vendors(spark, tables):
    """Every vendor asks for descriptions that every vendor has decided: 150 vendors would meet each other 67,500 times."""
    parts = [(n, name, "Brand#1", gl, 1, 1.0) for n, (name, gl) in enumerate([("red bolt", "A"), ("red bolts", "B"), ("blue ring", "A")])]
    lines = [(v * 3 + n, n, v, 1, 1.0, 1.0 + v, 0.0, 0.0, "N", status, DAY) for v in range(150) for n in range(3) for status in ("FO" if v % 7 else "O")]
    sf = tables(lines, parts)
    found = registry.queries()["suggested_accounts"](spark, sf)
    assert compare(found, *sql_of("suggested_accounts", sf)) is None
    assert max(n for _, n in operators(found)) < 10 * len(lines)


def test_vote_measures_likeness_once(spark, tables):
    """Likeness is found for descriptions, not again for every vendor that has them."""
    names = ["red steel bolt", "Red bolt steel", "red steel bolts big", "blue ring", "ring blue small", "red steel big bolt", "", "!!"]
    parts = [(n, name, "Brand#1", "AB"[n % 2], 1, 1.0) for n, name in enumerate(names)]
    lines = [(v * 8 + n, n, v, k, 1.0, 1.0 + v, 0.0, 0.0, "N", "FOF"[k], DAY) for v in range(100) for n in range(8) for k in range(3) if (v + n + k) % 5]
    sf = tables(lines, parts)
    found = registry.queries()["history_vote"](spark, sf)
    assert compare(found, *sql_of("history_vote", sf)) is None
    exploded = [n for name, n in operators(found) if name == "GenerateExec"]
    assert sum(exploded) < 100


def test_live_checks_count_without_pairs(spark, tables):
    """Bills of one vendor and amount are counted within 45 days: 600 of them would meet each other 360,000 times."""
    day = lambda n: None if n % 50 == 7 else DAY + datetime.timedelta(days=n % 40)
    lines = [(n % 400 if n % 31 else None, 1, n // 500 if n % 37 else None, 1, 5.0 if n % 11 else 6.0, 1.0, 0.0, 0.0, "N", "F", day(n)) for n in range(700)]
    sf = tables(lines)
    found = registry.queries()["live_duplicates"](spark, sf)
    assert compare(found, *sql_of("live_duplicates", sf)) is None
    assert max(n for _, n in operators(found)) <= 2 * len(lines)


def test_audit_moves_no_names(spark, tables):
    """Bills meet without their names, and the earlier one of a pair is copied at most once."""
    day = lambda n: None if n % 50 == 7 else DAY + datetime.timedelta(days=n * 7 % 90)
    lines = [(1000 + n * 13 % 300, 1, n % 3, 1, float(n % 4), 1.0, 0.0, 0.0, "N", "F", day(n)) for n in range(400)]
    sf = tables(lines)
    found = registry.queries()["duplicate_audit"](spark, sf)
    assert compare(found, *sql_of("duplicate_audit", sf)) is None
    copies = [n for name, n in operators(found) if name == "GenerateExec"]
    assert copies and max(copies) <= 2 * len(lines)


def test_sketch_is_kept_by_hour_alone(spark, tmp_path):
    """The sketch of actors is a state an hour, not one an hour and actor."""
    rows = [(n, DAY + datetime.timedelta(hours=n % 5), n % 40 if n % 17 else None, "click", float(n), "{}") for n in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["approx_people"](spark, str(tmp_path))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert compare(found, con, registry.oracle_sql()["approx_people"]) is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line and "keys=" in line]
    assert sketched and not any("actor" in line.split("keys=")[1].split("]")[0] for line in sketched)


def test_register_deals_items_once(spark, tables):
    """Items are dealt by document once and not gathered by the split that they are read from; copies and unknown dates as the SQL has them."""
    day = lambda n: None if n % 7 == 3 else DAY + datetime.timedelta(days=n * 5 % 9)
    lines = [(n % 40, 1, n % 3, n % 4, float(1 + n % 5), 1.0, 0.0, 0.0, "NR"[n % 11 == 0], "F", day(n)) for n in range(600)]
    sf = tables(lines, [(1, "bolt", "Brand#1", "A", 1, 1.0)])
    found = registry.queries()["voucher_register"](spark, sf)
    assert compare(found, *sql_of("voucher_register", sf)) is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The adaptive plan prints its final and its initial form.
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_statement_is_read_once(spark, tables):
    """Statuses come from the matching itself: no join finds its rows again."""
    lines = [(n, 1, n % 4, 1, float(n % 3), 100.0 * (n % 30) - 300, 0.0, 0.0, "RN"[n % 2], "F", DAY + datetime.timedelta(days=n % 25)) for n in range(300)]
    found = registry.queries()["statement_status"](spark, tables(lines))
    names = [name for name, _ in operators(found)]
    assert not any("SortMergeJoin" in name or "ShuffledHashJoin" in name for name in names)
    assert sum(r["n"] for r in found.where("status <> 'not on statement'").collect()) == 150
