"""Tables in versions: every state is a manifest that names its folders, and a reader sees one state or the next.

A table is dealt by key into buckets. A commit writes the folders of the buckets that change, then a manifest with the
next number; until that exists the table is what it was, and folders that no manifest names are never read. The manifest
also holds which batch of which stream it contains, so a batch that comes again changes nothing, and up to which sequence
number of a change log it is current.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import date, timedelta
from typing import Any

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError

from quillmint.sources.feeds import DELETE, MassRemoval, UPSERT, read_from

RESUME_DAYS = 3  # a read that stopped longer ago starts again
RECENT_DAYS = 31  # rows dated so lately are read every time, so that one that vanished is noticed


class VersionConflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


class VersionedTable:
    """Rows (keys, values, ``sequence``, ``marker``) in ``root``; each key's row of the greatest sequence counts.

    ``buckets`` bounds the folders a manifest names and the part of the table that one key's change writes anew; choose
    it so that a bucket is some hundred megabytes. ``root`` lies on a file system whose rename refuses an existing target.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sequence: str = "seq", marker: str = "row_marker", buckets: int = 64):
        self.spark, self.root, self.keys, self.sequence, self.marker, self.buckets = spark, root.rstrip("/"), list(keys), sequence, marker, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict[str, Any] | None:
        """A version's manifest, or the newest one's; None for a table that was never written."""
        numbers = self.versions()
        if version is None and not numbers:
            return None
        stream = self._fs.open(self._path(f"versions/{numbers[-1] if version is None else version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stored(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All rows a version holds, deleted keys' last rows among them; None where there is none."""
        found = self.manifest(version)
        return None if found is None else self._stored(found, buckets)

    def _stored(self, found: dict[str, Any], buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = found["folders"] if buckets is None else {b: found["folders"][b] for b in map(str, buckets) if b in found["folders"]}
        schema = StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in wanted.values())) if wanted else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version: keys and values, deleted ones left out."""
        held = self.stored(version)
        return None if held is None else held.where(F.col(self.marker) != DELETE).drop(self.sequence, self.marker)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def _commit(self, base: dict[str, Any] | None, made: dict[str, Any]) -> int:
        number = (base["version"] if base else 0) + 1
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}.json"), self._path(f"versions/{number:020d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({**made, "version": number}).encode()))
        out.close()
        self._fs.mkdirs(self._path("versions"))
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        except (Py4JJavaError, PySparkException) as e:
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"version {number} of {self.root} exists") from e
            raise
        return number

    def _bucket(self) -> Any:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, stream: str = "", batch_id: int | None = None, notes: dict[str, Any] | None = None, upto: int | None = None) -> int | None:
        """Commit a batch of changes (keys, values, sequence, marker); None where the version has that batch already.

        Only buckets of changed keys are read and written. Rows that are not newer than the last whole read are left
        out, as it held them. ``upto`` says that the log is taken in up to that number.
        """
        base = self.manifest()
        if base and batch_id is not None and base["batches"].get(stream, -1) >= batch_id:
            return None
        floor = base["floor"] if base else None
        fresh = batch if floor is None else batch.where(F.col(self.sequence) > floor)
        rest = [c for c in batch.columns if c not in self.keys]
        last = F.max_by(F.struct(*rest), self.sequence).alias("x")
        unpacked = [*self.keys, *(F.col(f"x.{c}").alias(c) for c in rest)]
        fresh = fresh.groupBy(*self.keys).agg(last).select(*unpacked).withColumn("_bucket", self._bucket())
        fresh.persist()
        try:
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            folders = dict(base["folders"]) if base else {}
            if touched:
                held = fresh
                if base:
                    held = self._stored(base, touched).select(*self.keys, *rest).withColumn("_bucket", self._bucket()).unionByName(fresh)
                dealt = held.repartition(len(touched), "_bucket")  # grouped below without another shuffle
                folders |= self._write(dealt.groupBy("_bucket", *self.keys).agg(last).select("_bucket", *unpacked))
        finally:
            fresh.unpersist()
        batches = {**(base["batches"] if base else {}), **({stream: batch_id} if batch_id is not None else {})}
        seen = [n for n in (base and base["sequence"], upto) if n is not None]
        schema = base["schema"] if base else batch.select(*self.keys, *rest).schema.jsonValue()
        return self._commit(base, {"schema": schema, "folders": folders, "batches": batches, "floor": floor, "sequence": max(seen, default=None), "notes": {**(base["notes"] if base else {}), **(notes or {})}})

    def replace(self, rows: DataFrame, sequence: int, most_removed: float = 1.0, notes: dict[str, Any] | None = None) -> int:
        """Commit a whole read (keys, values) as of a sequence number; refused where it lacks more than a share of the keys.

        Readers see the former state until the manifest is there.
        """
        base = self.manifest()
        if base and most_removed < 1:
            held = self._stored(base).where(F.col(self.marker) != DELETE).select(*self.keys)
            before, gone = held.count(), held.join(rows.select(*self.keys), self.keys, "left_anti").count()
            if gone > most_removed * before:
                raise MassRemoval(f"{gone} of {before} rows are missing")
        values = [c for c in rows.columns if c not in self.keys]
        whole = rows.select(*self.keys, *values, F.lit(sequence).cast("long").alias(self.sequence), F.lit(UPSERT).alias(self.marker))
        schema = whole.schema.jsonValue()
        folders = self._write(whole.withColumn("_bucket", self._bucket()).repartition("_bucket"))
        return self._commit(base, {"schema": schema, "folders": folders, "batches": base["batches"] if base else {}, "floor": sequence, "sequence": sequence, "notes": {**(base["notes"] if base else {}), **(notes or {})}})

    def clean(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep``, and folders older than the newest manifest that none of those names.

        A writer whose folder is older than the newest manifest set out from an earlier one, so it cannot commit.
        """
        numbers = self.versions()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"versions/{n:020d}.json"), False)
        kept = numbers[-keep:]
        named = {f.split("/")[1] for n in kept for f in self.manifest(n)["folders"].values()}
        newest = self._fs.getFileStatus(self._path(f"versions/{kept[-1]:020d}.json")).getModificationTime() if kept else 0
        old = [f for f in self._names("data") if f not in named and self._fs.getFileStatus(self._path(f"data/{f}")).getModificationTime() < newest]
        for f in old:
            self._fs.delete(self._path(f"data/{f}"), True)
        return len(old)


def catch_up(table: VersionedTable, log: DataFrame, whole: Callable[[], DataFrame], kept_from: int | None = None, most_removed: float = 1.0) -> str:
    """Take in a bounded change log: "changes", "nothing", or "whole" where the log no longer reaches back.

    The log lacks rows where its first sequence number (``kept_from``, else its smallest) lies past the next one wanted,
    where it ends before what was taken in (the source was restored), or where it is empty and no ``kept_from`` is known.
    Its end is read before the whole read begins, so that what changes meanwhile comes again with the log.
    """
    ends = log.agg(F.min(table.sequence).alias("low"), F.max(table.sequence).alias("top")).first()
    found = table.manifest()
    done = found["sequence"] if found else None
    low = kept_from if kept_from is not None else ends["low"]
    top = ends["top"] if ends["top"] is not None else (low - 1 if low is not None else 0)
    if done is None or low is None or low > done + 1 or top < done:
        table.replace(whole(), top, most_removed)
        return "whole"
    if top == done:
        return "nothing"
    table.merge(log.where(F.col(table.sequence).between(done + 1, top)), upto=top)
    return "changes"


def follow_into(changes: DataFrame, table: VersionedTable, checkpoint: str, stream: str = "changes") -> None:
    """Merge what a stream of changes has now, each micro-batch exactly once; the next run goes on from the checkpoint."""
    query = changes.writeStream.foreachBatch(lambda batch, n: table.merge(batch, stream, n)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def nightly(table: VersionedTable, pieces: Sequence[str], read: Callable[[str, str | None], DataFrame], today: str, dated: str | None = None, most_removed: float = 0.2) -> str:
    """One night's sync in pieces: "whole" or "changes".

    ``read(piece, since)`` gives a piece's rows (keys, values, among them ``dated``): all of them where ``since`` is
    None, else those changed since that day together with those dated in the last 31 days. Each piece is written once;
    a sync that stopped is taken up again within three days, with the pieces it had, and what it asked for then. The
    table changes with the last piece alone. A whole read drops what it lacks, but never over a share of all; a read of
    changes drops only recently dated rows that it lacks, under the same share of those. What was refused is read anew
    the next day.
    """
    base = table.manifest()
    notes = base["notes"] if base else {}
    since = read_from(notes.get("at"), notes.get("whole"), today)
    ask, oldest = f"{today}_{since or 'whole'}", (date.fromisoformat(today) - timedelta(days=RESUME_DAYS)).isoformat()
    done = lambda n, p: table._fs.exists(table._path(f"syncs/{n}/{p}/_SUCCESS"))
    begun = [n for n in table._names("syncs") if oldest <= n.split("_")[0] <= today and n > notes.get("sync", "") and not all(done(n, p) for p in pieces)]
    name = begun[-1] if begun else ask
    started, asked = name.split("_")
    since = None if asked == "whole" else asked
    folders = [f"syncs/{name}/{p}" for p in pieces]
    for piece, folder in zip(pieces, folders, strict=True):
        if not done(name, piece):
            read(piece, since).write.mode("overwrite").parquet(f"{table.root}/{folder}")
    rows = table.spark.read.parquet(*(f"{table.root}/{f}" for f in folders))
    number = (base["sequence"] or 0) + 1 if base else 1
    read_at = {"at": started, "sync": name}
    if since is None:
        table.replace(rows, number, most_removed, {**read_at, "whole": started})
        return "whole"
    batch = rows.withColumns({table.sequence: F.lit(number).cast("long"), table.marker: F.lit(UPSERT)})
    if dated:
        recent = F.col(dated) >= F.date_sub(F.lit(started).cast("date"), RECENT_DAYS)
        held = table.rows().where(recent)
        gone = held.join(rows.select(*table.keys), table.keys, "left_anti")
        before, lost = held.count(), gone.count()
        if lost > most_removed * before:
            raise MassRemoval(f"{lost} of {before} rows of late are missing")
        batch = batch.unionByName(gone.withColumns({table.sequence: F.lit(number).cast("long"), table.marker: F.lit(DELETE)}))
    table.merge(batch, notes=read_at, upto=number)
    return "changes"
