"""Change feeds and landing zones: what changed between two states, written as sequence-numbered batches."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPSERT, DELETE = 4, 2


def changes(before: DataFrame, after: DataFrame, keys: list[str], marker: str = "row_marker") -> DataFrame:
    """Rows of ``after`` that are new or differ (4), and keys gone since ``before`` with nulls beside them (2)."""
    rest = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(*rest).alias("_old"))
    new = after.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, keys, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*keys, *(F.col(f"_new.{c}").alias(c) for c in rest), F.when(F.col("_new").isNull(), DELETE).otherwise(UPSERT).alias(marker))


def land(feed: DataFrame, root: str, sequence: int) -> str:
    """Write a feed's batch under its twenty-digit sequence number; a batch that exists is not written again."""
    path = f"{root.rstrip('/')}/{sequence:020d}"
    feed.write.mode("ignore").parquet(path)
    return path


def landed(spark: SparkSession, root: str, keys: list[str], marker: str = "row_marker") -> DataFrame:
    """The state that all batches of a landing zone amount to: each key's last row, deleted keys left out."""
    batches = spark.read.option("recursiveFileLookup", "true").parquet(root)
    rest = [c for c in batches.columns if c not in keys]
    numbered = batches.withColumn("_batch", F.regexp_extract(F.input_file_name(), "/([0-9]{20})/", 1))
    last = numbered.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x"))
    return last.where(F.col(f"x.{marker}") == UPSERT).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest if c != marker))


def follow(events: DataFrame, sent_id: int | None, sent_stamp: str | None, id_col: str = "event_id", stamp_col: str = "happened") -> tuple[DataFrame, bool]:
    """What to send of an append-only feed since the last id, and whether that is everything.

    The source was restored from a copy where its highest id fell below the last one sent, or the row of that id bears
    another time than the one sent: then all is sent again.
    """
    if sent_id is None:
        return events, True
    last = events.agg(F.max(id_col).alias("top"), F.max(F.when(F.col(id_col) == sent_id, F.col(stamp_col).cast("string"))).alias("stamp")).first()
    restored = last["top"] is None or last["top"] < sent_id or last["stamp"] != sent_stamp
    return (events if restored else events.where(F.col(id_col) > sent_id)), restored


class MassRemoval(ValueError):
    """A sync would remove more rows than is plausible."""


def synced(held: DataFrame, read: DataFrame, keys: list[str], whole: bool, most_removed: float = 0.2) -> DataFrame:
    """The state after a sync: rows read replace held ones; a whole read also removes what it lacks, but never over a share of all."""
    kept = held.join(read, keys, "left_anti")
    if whole:
        before, gone = held.count(), kept.count()
        if gone > most_removed * before:
            raise MassRemoval(f"{gone} of {before} rows are missing")
        return read
    return kept.unionByName(read)


def read_from(last: str | None, last_whole: str | None, today: str, margin_days: int = 1, whole_days: int = 7) -> str | None:
    """The change date a sync reads from, a margin before the last one; None, for a whole read, at first and once a week."""
    if last is None or last_whole is None or (date.fromisoformat(today) - date.fromisoformat(last_whole)).days >= whole_days:
        return None
    return (date.fromisoformat(last) - timedelta(days=margin_days)).isoformat()


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, content) whose content was not taken before, once each (the first path), with their hash."""
    hashed = files.withColumn("hash", F.sha2("content", 256))
    first = hashed.groupBy("hash").agg(F.min("path").alias("path"))
    fresh = first.join(seen.select("hash").distinct(), "hash", "left_anti")
    return files.join(fresh, "path")  # the content of fresh files alone


def newest_lines(spark: SparkSession, path: str, schema: str, at: str, where: str = "true", limit: int = 200) -> DataFrame:
    """The newest lines of JSON logs that meet a condition; lines that are no JSON are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken").where(where).orderBy(F.desc(at)).limit(limit)


def overlaid(rows: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with hand edits laid over: an edit that is not null wins, whatever a reload brings."""
    e = edits.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(e, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def fixed_columns(rows: DataFrame, layout: list[tuple[str, int, str]]) -> DataFrame:
    """Lines of a fixed layout (column, width, "left" or "right"): value, and the problem of a line that does not fit.

    Text stands left, cut to width; numbers stand right, zero-filled, a minus before the zeros. A number wider than its
    place would be another number, so such a line has no value and names its columns.
    """
    parts, wide = [], []
    for column, width, side in layout:
        text = F.coalesce(F.col(column).cast("string"), F.lit(""))
        if side == "left":
            parts.append(F.rpad(text, width, " "))
        else:
            minus = F.when(text.startswith("-"), "-").otherwise("")
            parts.append(F.concat(minus, F.lpad(F.regexp_replace(text, "^-", ""), F.lit(width) - F.length(minus), F.lit("0"))))
            wide.append(F.when(F.length(text) > width, F.lit(column)))
    problem = F.nullif(F.concat_ws(", ", *wide), F.lit("")) if wide else F.lit(None).cast("string")
    return rows.withColumn("_problem", problem).select(F.when(F.col("_problem").isNull(), F.concat(*parts)).alias("value"), F.col("_problem").alias("problem"))
