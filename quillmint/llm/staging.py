"""Shared-folder tables: the lineage cuts that all operators of this package use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, a local master (tests) gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillmint-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmint/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The files survive lost executors and cut the lineage; later plans scan only the columns they use.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    # The write's own shuffle files serve no later plan.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before or "false")
    made = _made.get()
    if made is not None:
        made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: What the operator that runs in this thread has staged; operators in other threads have lists of their own.
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("staged", default=None)


def _read_paths(df: DataFrame) -> set[str]:
    """The folders that a plan reads, by its relations and not by their files."""
    found, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths().iterator()
            while roots.hasNext():
                found.add(roots.next().getName())
    return found


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete, when an operator returns, the tables it staged that its result does not read; all, when it fails."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        outer, made = _made.get(), []
        token = _made.set(made)
        read: set[str] = set()
        try:
            result = operator(*args, **kwargs)
            read = _read_paths(result) if made else read
        finally:
            _made.reset(token)
            for spark, path in made:
                if path.rsplit("/", 1)[-1] not in read:
                    remove(spark, path)
                elif outer is not None:
                    outer.append((spark, path))
        return result

    return run


def remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def low_share(hashed: Column, wanted: int, rows: int) -> Column:
    """Whether a 64-bit hash lies among the lowest of ``rows`` hashes, so that about ``wanted`` rows do.

    Before an ordered limit it keeps partitions from sending ``limit`` rows each to where the limit is taken.
    """
    share = min(1.0, wanted / max(rows, 1))
    return F.lit(True) if share == 1.0 else hashed < F.lit(int((1 << 64) * share) - (1 << 63))


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)
