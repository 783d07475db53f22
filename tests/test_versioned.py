"""Tables in versions: exactly one commit a batch, whole reads where a log is too short, syncs that go on."""

import random

import pytest
from pyspark.sql import functions as F

from quillmint.sources.feeds import DELETE, MassRemoval, UPSERT
from quillmint.sources.versioned import VersionConflict, VersionedTable, catch_up, follow_into, nightly

CHANGE = "id long, value string, seq long, row_marker int"


def held(table, version=None):
    return {r["id"]: r["value"] for r in table.rows(version).collect()}


def log_of(n, seed, first=1):
    rnd = random.Random(seed)
    return [(rnd.randrange(30), f"v{s}", s, rnd.choices([UPSERT, DELETE], [4, 1])[0]) for s in range(first, first + n)]


def state(rows):
    out = {}
    for i, value, _, marker in sorted(rows, key=lambda r: r[2]):
        out.pop(i, None)
        if marker == UPSERT:
            out[i] = value
    return out


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=4)


def test_batches_in_any_order_amount_to_the_log(spark, table):
    rows = log_of(120, 1)
    parts = [rows[40:80], rows[:40], [], rows[80:]]
    for n, part in enumerate(parts):
        assert table.merge(spark.createDataFrame(part, CHANGE), "s", n) == n + 1
    assert held(table) == state(rows)
    assert held(table, 1) == state(parts[0])  # earlier versions stay readable


def test_a_replayed_batch_changes_nothing(spark, table):
    rows = log_of(40, 2)
    batch = spark.createDataFrame(rows, CHANGE)
    assert table.merge(batch, "s", 0) == 1
    assert table.merge(batch, "s", 0) is None
    assert table.versions() == [1]
    assert table.merge(batch, "other", 0) == 2  # another stream's batch of that number is its own
    assert held(table) == state(rows)


def test_a_batch_killed_before_its_commit_changes_nothing(spark, table, monkeypatch):
    rows = log_of(80, 3)
    table.merge(spark.createDataFrame(rows[:40], CHANGE), "s", 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame(rows[40:], CHANGE), "s", 1)
    assert held(table) == state(rows[:40]) and table.versions() == [1]
    table.merge(spark.createDataFrame(rows[40:], CHANGE), "s", 1)
    assert held(table) == state(rows)
    assert table.clean(keep=1) >= 1  # the killed batch's folder is among them
    assert held(table) == state(rows)


def test_two_writers_of_one_version(spark, table):
    table.merge(spark.createDataFrame(log_of(5, 4), CHANGE))
    base = table.manifest()
    table._commit(base, base)
    with pytest.raises(VersionConflict):
        table._commit(base, base)


def test_only_touched_buckets_are_written(spark, table):
    table.merge(spark.createDataFrame([(i, "a", i + 1, UPSERT) for i in range(30)], CHANGE))
    before = table.manifest()["folders"]
    table.merge(spark.createDataFrame([(7, "b", 100, UPSERT)], CHANGE))
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_log_that_reaches_back_or_does_not(spark, table):
    rows = log_of(200, 5)
    frame = lambda part: spark.createDataFrame(part, CHANGE)
    whole = lambda upto: lambda: spark.createDataFrame(list(state(rows[:upto]).items()), "id long, value string")
    assert catch_up(table, frame(rows[:50]), whole(50)) == "whole"
    assert catch_up(table, frame(rows[30:90]), whole(0)) == "changes"
    assert held(table) == state(rows[:90])
    assert catch_up(table, frame(rows[60:90]), whole(0)) == "nothing"
    assert catch_up(table, frame(rows[90:120]), whole(0)) == "changes"  # the log begins with the very next number
    assert held(table) == state(rows[:120])
    assert catch_up(table, frame(rows[121:150]), whole(150)) == "whole"  # one number is lost
    assert held(table) == state(rows[:150])
    assert catch_up(table, frame([]), whole(0), kept_from=151) == "nothing"
    assert catch_up(table, frame([]), whole(150)) == "whole"  # nothing says what an empty log lacks
    assert held(table) == state(rows[:150])


def test_rows_older_than_a_whole_read_stay_out(spark, table):
    table.replace(spark.createDataFrame([(1, "whole")], "id long, value string"), 10)
    table.merge(spark.createDataFrame([(1, "late", 9, UPSERT), (2, "late", 10, UPSERT), (3, "new", 11, UPSERT)], CHANGE))
    assert held(table) == {1: "whole", 3: "new"}


def test_stream_equals_replay_across_restarts(spark, table, tmp_path):
    rows, landing = log_of(90, 6), f"{tmp_path}/in"
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], CHANGE).coalesce(1).write.mode("append").parquet(landing)
        follow_into(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(landing), table, f"{tmp_path}/check")
        assert held(table) == state(rows[: n * 30 + 30])
    # the checkpoint is lost with its last commit: the stream's last batch comes again
    before = table.versions()
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    follow_into(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(landing), table, f"{tmp_path}/check")
    assert table.versions() == before and held(table) == state(rows)


def test_nightly_sync(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/n", ["id"], buckets=4)
    source = {i: ("a" if i % 2 else "b", f"2025-0{1 + i % 5}-10", "2025-01-01") for i in range(40)}  # piece, dated, changed
    asked = []

    def read(piece, since):
        asked.append((piece, since))
        if piece == stop:
            raise RuntimeError("down")
        rows = [(i, d, c) for i, (p, d, c) in source.items() if p == piece and (since is None or c >= since or d >= "2025-05-01")]
        return spark.createDataFrame(rows, "id long, d string, c string").withColumn("d", F.to_date("d"))

    ids = lambda: {r["id"] for r in table.rows().collect()}
    stop = "b"
    with pytest.raises(RuntimeError):
        nightly(table, ["a", "b"], read, "2025-05-12", "d")
    assert table.versions() == [] and asked == [("a", None), ("b", None)]
    stop = None
    assert nightly(table, ["a", "b"], read, "2025-05-14", "d") == "whole"  # goes on with the piece it lacks
    assert asked[2:] == [("b", None)] and ids() == set(source)
    assert table.manifest()["notes"]["at"] == "2025-05-12"  # what it asked is as of the day it began
    old, late = 0, 4  # dated 2025-01-10 and 2025-05-10
    del source[old], source[late]
    source[99] = ("a", "2025-02-01", "2025-05-14")
    assert nightly(table, ["a", "b"], read, "2025-05-15", "d") == "changes"
    assert asked[-1] == ("b", "2025-05-11")
    assert ids() == set(source) | {old}  # an old row's end shows in a whole read only
    assert nightly(table, ["a", "b"], read, "2025-05-19", "d") == "whole" and ids() == set(source)
    stop = "b"
    with pytest.raises(RuntimeError):
        nightly(table, ["a", "b"], read, "2025-05-20", "d")
    stop = None
    assert nightly(table, ["a", "b"], read, "2025-05-24", "d") == "changes"  # four days later: from the beginning
    assert asked[-2:] == [("a", "2025-05-18"), ("b", "2025-05-18")]
    for i in list(source)[:20]:
        del source[i]
    with pytest.raises(MassRemoval):
        nightly(table, ["a", "b"], read, "2025-05-28", "d")
    assert len(ids()) == len(source) + 20
