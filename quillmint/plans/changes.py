"""Reports over change logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.sources import tables as T
from quillmint.sources.feeds import DELETE, UPSERT
from quillmint.sources.settled import shared_folder
from quillmint.sources.versioned import VersionedTable, catch_up

BATCHES = 4


def change_log_state(spark: SparkSession, sf: str) -> DataFrame:
    """What a log of changes amounts to: persons by their events, an error deletes a person.

    The log comes in four batches, the third one twice; the last is followed from a log that has been cut since, so the
    table is read whole there.
    """
    log = T.activity(spark, sf).where("actor is not null").select("actor", "action", "k", F.col("event_id").alias("seq"), F.when(F.col("action") == "error", DELETE).otherwise(UPSERT).alias("row_marker"))
    top = log.agg(F.max("seq")).first()[0] or 0
    table = VersionedTable(spark, f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}", ["actor"], buckets=16)
    span = top // BATCHES + 1
    for n in (0, 1, 2, 2):
        table.merge(log.where(F.col("seq").between(n * span, (n + 1) * span - 1)), "log", n, upto=(n + 1) * span - 1)
    cut = log.where(F.col("seq") > 3 * span + 1)
    whole = log.groupBy("actor").agg(F.max_by(F.struct("action", "k", "row_marker"), "seq").alias("x"))
    catch_up(table, cut, lambda: whole.where(F.col("x.row_marker") == UPSERT).select("actor", "x.action", "x.k"), kept_from=3 * span + 2)
    return table.rows()


CHANGE_LOG_STATE = f"""select actor, action, k from (select *, row_number() over (partition by actor order by event_id desc) as n from {T.ACTIVITY} where actor is not null)
  where n = 1 and action <> 'error'"""

QUERIES = [("change_log_state", change_log_state, CHANGE_LOG_STATE)]
