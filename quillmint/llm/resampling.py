"""Operator 12: importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Every text becomes counts of hashed features, runs of one and two words. A slice of at most ``SLICE_BYTES`` of texts (or one
longer text) writes its postings inverted: for each bucket one row with the places of the texts that hold it and how
often. Posting rows are shuffled by bucket, where they meet the bucket's counts in both corpora; the gain is computed
there, and rows of (text, gain) contributions are shuffled by slice and summed for each text. A bucket has at most one row
for each slice, so a word that every text holds makes its rows no more than another's, and ``LOTS`` parts of every
bucket share them out. Counts of a bucket are added up before they are shuffled.

The draw is exact at every size: scores are whole numbers of a bounded range, so a histogram of them gives the rank at
which each begins, and only rows of one score are ordered among themselves.

Defined results: a null text has no features; a text without features weighs 0; a null id draws its noise from an empty id
and comes before all others in a tie; repeated rows are documents of their own, whose order among themselves is any;
other columns of the input are left alone; an empty table gives an empty table, an empty target one without words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmint.llm import textkit as tk
from quillmint.llm.sqltext import CRC_TABLE, crc_sql
from quillmint.llm.staging import stage, tidy

BUCKETS = 10_000
LOTS = 8  # parts of a bucket's rows
SLICE_BYTES, SLICE_TEXTS = 1 << 22, 1 << 15
COUNT_KINDS = {1: "<u1", 4: "<u4"}  # by the bytes of a count; a slice has one of them
LONG_WORD = 48
BAND = 256  # scores that are counted together before they are within
POSTINGS = "slice long, bucket int, place int, doc_id long, n_words long, n_features long, places binary, counts binary, total long"
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers after each span's bytes, from the given registers; all spans step side by side."""
    state, size = state.copy(), end - start
    for i in np.flatnonzero(size > LONG_WORD):
        whole = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF)
        state[i] = whole ^ 0xFFFFFFFF
    rest = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    k = 0
    while len(rest):
        now = state[rest]
        state[rest] = _CRC[(now ^ data[start[rest] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        k += 1
        rest = rest[size[rest] > k]
    return state


def features(part: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features and the features' texts, and each text's number of words."""
    data = tk.lowered(part.data)
    w = tk.words(tk.Slice(part.first, part.offsets, data), IN_WORD)
    n = len(w.start)
    one = crc_of_spans(data, w.start, w.end, np.full(n, 0xFFFFFFFF, np.uint32))
    follows = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if n else np.zeros(0, np.int64)
    joint = one[follows]
    joint = _CRC[(joint ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (joint >> np.uint32(8))
    two = crc_of_spans(data, w.start[follows + 1], w.end[follows + 1], joint)
    bucket = (~np.concatenate([one, two])).astype(np.int64) % BUCKETS
    return bucket, np.concatenate([w.doc, w.doc[follows]]), w.count


def _small_slices(column: pa.Array) -> Iterator[tk.Slice]:
    for at in range(0, len(column), SLICE_TEXTS):
        for part in tk.slices(column.slice(at, SLICE_TEXTS), SLICE_BYTES):
            yield tk.Slice(at + part.first, part.offsets, part.data)


def posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (bucket null), and for each bucket of a slice its texts' places and counts."""
    schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in _small_slices(batch.column(1)):
            n = len(part.offsets) - 1
            bucket, doc, words = features(part)
            own, count = np.unique(bucket * n + doc, return_counts=True)
            held = own // n if n else own
            first = np.flatnonzero(np.diff(held, prepend=-1))
            limits = np.append(first, len(own)).astype(np.int32)

            def none(kind: pa.DataType, size: int) -> pa.Array:
                return pa.nulls(size, kind)

            def packed(x: np.ndarray, kind: str) -> pa.Array:
                values = x.astype(kind)
                return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(values.itemsize * limits), pa.py_buffer(values)])

            per_text = np.bincount(doc, minlength=n).astype(np.int64)
            texts = [pa.array(np.full(n, number)), none(pa.int32(), n), pa.array(np.arange(n, dtype=np.int32)), batch.column(0).slice(part.first, n), pa.array(words.astype(np.int64)), pa.array(per_text), none(pa.binary(), n), none(pa.binary(), n), none(pa.int64(), n)]
            yield pa.RecordBatch.from_arrays(texts, schema=schema)
            m = len(first)
            if m:
                total = np.add.reduceat(count, first).astype(np.int64)
                lists = [pa.array(np.full(m, number)), pa.array(held[first].astype(np.int32)), none(pa.int32(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.int64(), m), packed(own - held * n, "<u2"), packed(count, COUNT_KINDS[4 if count.max() > 255 else 1]), pa.array(total)]
                yield pa.RecordBatch.from_arrays(lists, schema=schema)
            number += 1


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, places, counts, gain) come sorted by slice; each text's sum of gains, as (slice, place, gains)."""

    def finished(name: int, sums: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name, np.int64)), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["slice", "place", "gains"])

    now, sums = None, np.zeros(SLICE_TEXTS, np.int64)
    for batch in batches:
        names, gains = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        for i in range(batch.num_rows):
            if names[i] != now:
                if now is not None:
                    yield finished(now, sums)
                now, sums = names[i], np.zeros(SLICE_TEXTS, np.int64)
            places, counts = np.frombuffer(batch.column(1)[i].as_buffer(), "<u2"), batch.column(2)[i].as_buffer()
            counts = np.frombuffer(counts, COUNT_KINDS[counts.size // len(places)])
            sums[places] += counts.astype(np.int64) * gains[i]  # a text comes once in a row
    if now is not None:
        yield finished(now, sums)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id, in whole thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def bucket_gains(held: DataFrame, target: DataFrame) -> DataFrame:
    """Each bucket's gain from its posting rows' totals in both corpora; a row for each bucket that ``held`` has."""
    sums = [x.groupBy("bucket").agg(F.sum("total").alias(name)) for x, name in ((held, "s"), (target, "t"))]
    all_s, all_t = (x.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] for x in (held, target))
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1.0) * float(all_s + BUCKETS) / ((s + 1.0) * float(all_t + BUCKETS))
    return sums[0].join(sums[1], "bucket", "left").select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


@tidy
def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight (the mean gain of its features) and score (weight and noise)."""

    def postings(rows: DataFrame, name: str) -> DataFrame:
        return stage(rows.mapInArrow(posting_batches, POSTINGS), name)

    drawn = postings(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "postings")
    lists = drawn.where("bucket is not null").select("slice", "bucket", "places", "counts", "total")
    aimed = postings(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "target-postings").where("bucket is not null")
    # A bucket's counts, one row for each of its lots, meet its posting rows in the task of bucket and lot.
    gains = bucket_gains(lists, aimed).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    dealt = lists.drop("total").withColumn("lot", F.pmod(F.xxhash64("slice"), F.lit(LOTS)).cast("int"))
    parts = dealt.join(gains.hint("merge"), ["bucket", "lot"]).select("slice", "places", "counts", "gain")
    sums = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(sum_batches, "slice long, place int, gains long")
    texts = drawn.where("bucket is null").select("slice", "place", "doc_id", "n_words", "n_features")
    met = texts.join(sums, ["slice", "place"], "left")
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("coalesce(gains, 0) div n_features - if(coalesce(gains, 0) % n_features < 0, 1, 0)")).cast("long")
    return met.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


@tidy
def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The rows of ``importance_scores`` with ``rank``, from 1, of those drawn: ``percent`` of the rows with enough words."""
    scored = stage(importance_scores(docs, target, id_col, text_col, seed), "importance-scores")
    fit = F.col("n_words") >= least_words
    # Noise and gains bound the scores, so their histogram has some tens of thousands of rows whatever the table.
    counted = stage(scored.where(fit).groupBy("score").agg(F.count("*").alias("n")), "score-histogram")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = percent * total // 100
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("band", F.floor(F.col("score") / BAND))
    bands = counted.groupBy("band").agg(F.sum("n").alias("n"))
    bands = bands.select("band", F.coalesce(F.sum("n").over(earlier.orderBy(F.desc("band"))), F.lit(0)).alias("ahead"))
    above = F.col("ahead") + F.coalesce(F.sum("n").over(earlier.partitionBy("band").orderBy(F.desc("score"))), F.lit(0))
    begins = counted.join(bands, "band").select("score", above.alias("above")).where(F.col("above") < wanted)
    met = scored.withColumn("fit", fit).join(F.broadcast(begins.withColumn("fit", F.lit(True))), ["fit", "score"], "left")
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id")))
    near = met.where("above is not null").withColumn("rank", (F.col("above") + within).cast("long"))
    near = near.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    far = met.where("above is null").withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(far).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn_rows(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that ``resampled`` has drawn; ids are expected to be unique."""
    return docs.join(ranks.where("rank is not null").select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(*docs.columns)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).drop("n_words")


OP12_SQL = f"""
with {CRC_TABLE},
low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
worded as (select doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from low),
aimed as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
held as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from worded),
sought as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from aimed),
names as (select f, {crc_sql("f")} % 10000 as bucket from (select distinct f from (select f from held union all select f from sought)), crc_table),
s as (select bucket, count(*) as s from held join names using (f) group by bucket),
t as (select bucket, count(*) as t from sought join names using (f) group by bucket),
gains as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from held) + 10000) / ((s + 1)::double * ((select count(*) from sought) + 10000)))) as bigint) as gain
          from s left join t using (bucket)),
summed as (select doc_id, count(*) as n, sum(gain) as g from held join names using (f) join gains using (bucket) group by doc_id),
scored as (
    select doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(cast(floor(g / n) as bigint), 0) as weight,
           coalesce(cast(floor(g / n) as bigint), 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
    from worded left join summed using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as fit from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * fit // 100 then rank end as rank from scored left join ranked using (doc_id)
"""
