"""Operator 7: exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(256 * x), in a written table. The queries are taken in batches of bounded size, each
broadcast in turn, and every task streams its candidates past the batch in blocks: a stated query set against all
rows, in blocks. A block is an inverted index, one posting list per term (dimension); each query scatters its weighted
postings into a dense score array, a partition selection keeps the best, a task keeps k a query, and the tasks'
winners merge into the final ranks. Candidates never move; only winners do, so what is shuffled grows with the rows.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id; rows repeated with the same id and vector count once; where one id has several vectors, each is a candidate and
the smallest serves as the query; a query's own id is no candidate; ties go to the smaller id; missing trailing
components count as zero; scores beyond the range of a long are ranked exactly within a block and given as its limit;
other columns are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.llm.staging import new_path, stage, tidy

SCALE = 256
QUERY_BATCH, BATCH_BYTES, ROW_BLOCK = 16_384, 64 << 20, 8192
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


class Vectors(NamedTuple):
    """Sparse rows: the weights of row i are flat[limits[i] : limits[i + 1]], one a term."""

    ids: np.ndarray
    limits: np.ndarray
    flat: np.ndarray


def vectors(batches: list[pa.RecordBatch]) -> Vectors:
    """Rows (vec_id, w) in id order."""
    t = pa.Table.from_batches(batches).combine_chunks()
    t = t.take(pa.array(np.argsort(t.column(0).to_numpy(), kind="stable")))
    w = t.column(1).combine_chunks()
    w = w.chunk(0) if isinstance(w, pa.ChunkedArray) else w
    return Vectors(t.column(0).to_numpy(), np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), w.flatten().to_numpy())


def weights(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and w, the integer weights of every whole vector that takes part."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(x) > 0) & sound)
    return some.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("w")).distinct()


def block_top(queries: Vectors, rows: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's best k of a block, scores and ids: queries x k, unused places with score LEAST and id MOST."""
    n, lengths = len(rows.ids), np.diff(rows.limits)
    width = int(lengths.max())
    row = np.repeat(np.arange(n), lengths)
    term = np.arange(len(rows.flat)) - np.repeat(rows.limits[:-1], lengths)
    used = rows.flat != 0
    row, term, flat = row[used], term[used], rows.flat[used]
    order = np.argsort(term, kind="stable")
    row, flat = row[order], flat[order]
    limits = np.searchsorted(term[order], np.arange(width + 1))
    # Sums that a long might not hold are made of whole numbers of any size.
    most = float(np.abs(rows.flat.astype(float)).max(initial=0)) * float(np.abs(queries.flat.astype(float)).max(initial=0)) * width
    kind = np.int64 if most < MOST / 2 else object
    flat = flat.astype(kind)
    postings = [(row[a:b], flat[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
    best, ids = np.full((len(queries.ids), k), LEAST), np.full((len(queries.ids), k), MOST)
    for i, query in enumerate(queries.ids):
        w = queries.flat[queries.limits[i] : queries.limits[i + 1]][:width].astype(kind)
        score = np.zeros(n, kind)
        for t in np.flatnonzero(w):
            at, value = postings[t]
            if len(at) == n:
                score += w[t] * value  # a full posting list is the whole score array in order
            else:
                score[at] += w[t] * value
        mine = np.flatnonzero(rows.ids != query)
        if len(mine) > k:
            least = np.partition(score[mine], len(mine) - k)[len(mine) - k]
            better = mine[score[mine] > least]
            level = mine[score[mine] == least][: k - len(better)]  # rows are in id order
            mine = np.concatenate([better, level])
        best[i, : len(mine)] = np.clip(score[mine], LEAST, MOST).astype(np.int64)
        ids[i, : len(mine)] = rows.ids[mine]
    return best, ids


@tidy
def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows; both inputs as ``weights`` returns them."""
    spark = rows.sparkSession
    rows = stage(rows.select("vec_id", "w"), "vectors")
    queries = stage(queries.groupBy("vec_id").agg(F.min("w").alias("w")), "queries")
    n, terms = queries.agg(F.count("*"), F.max(F.size("w"))).first()
    batches = max(1, -(-n // min(QUERY_BATCH, max(1, BATCH_BYTES // (8 * (terms or 1))))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    path = new_path(spark, "top-k")
    for batch in range(batches):
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == batch).toArrow()
        shared = spark.sparkContext.broadcast(vectors(held.to_batches()) if len(held) else None)  # of bounded size

        def search(some: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            if asked is None:
                return
            best, ids = np.full((len(asked.ids), k), LEAST), np.full((len(asked.ids), k), MOST)

            def meet(block: list[pa.RecordBatch]) -> None:
                nonlocal best, ids
                more, theirs = block_top(asked, vectors(block), k)
                more, theirs = np.hstack([best, more]), np.hstack([ids, theirs])
                first = np.lexsort((theirs, -more), axis=1)[:, :k]
                best, ids = np.take_along_axis(more, first, 1), np.take_along_axis(theirs, first, 1)

            block, size = [], 0
            for x in some:
                for at in range(0, len(x), ROW_BLOCK):
                    part = x.slice(at, ROW_BLOCK)
                    if size + len(part) > ROW_BLOCK:
                        meet(block)
                        block, size = [], 0
                    block.append(part)
                    size += len(part)
            if size:
                meet(block)
            q, j = np.nonzero(ids != MOST)
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(ids[q, j]), pa.array(best[q, j])], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(search, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
        found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP7_SQL = """
with v as (
  select distinct cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
