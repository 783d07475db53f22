"""Operator 2: near duplicates by min-max hashing, confirmed on full shingle sets.

Every text becomes its set of 64-bit hashes of five-word shingles. Under each of ``BANDS * ROWS / 2`` permutations
the signature keeps both the minimum and the maximum, so a hash evaluation gives two unbiased samples. Bands of
``ROWS`` values, each from another permutation, propose candidates: at similarity 0.75 a pair shares no band with
probability (1 - 0.75 ** 5) ** 36 = 6e-5.

Documents with equal sets are one class from then on. Band buckets link their members to their smallest class, so
candidate links grow with the documents and not with the pairs; classes joined by candidate links form groups, and
within a group every pair is decided on the full sets. A group of more than ``BLOCK_SHINGLES`` shingles or
``BLOCK_SETS`` sets falls apart into its band buckets, and a bucket beyond the same bound into pairs of blocks, so
no task holds more than two blocks whatever the group's size.

Defined results: null, empty and word-free texts have no shingles, are linked with nothing and are their own
component; a null id is linked with nothing, its component is null and it is kept; rows repeat as often as they
come, and rows of one id are one node; other columns of the input are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm import textkit as tk
from quillmint.llm.components import components
from quillmint.llm.holders import sampled, shared_keys
from quillmint.llm.merkle import numbered
from quillmint.llm.staging import stage, tidy

SHINGLE = 5
ROWS, BANDS = 5, 36
PERMUTATIONS = ROWS * BANDS // 2
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 4096
_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 32-bit minima, then the maxima, of each non-empty set: sets x (2 * PERMUTATIONS)."""
    x = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * PERMUTATIONS, len(offsets) - 1), np.uint32)
    y = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, _A[k], out=y)
        np.add(y, _B[k], out=y)
        np.minimum.reduceat(y, offsets[:-1], out=out[k])
        np.maximum.reduceat(y, offsets[:-1], out=out[PERMUTATIONS + k])
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; a band's values come from different permutations."""
    by_band = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), by_band.shape[:2]).copy()
    for k in range(ROWS):
        key = tk.mix(key * np.uint64(0x9FB21C651E98DF25) ^ by_band[:, :, k])
    return key


def _sets(part: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    w = tk.words(part)
    s = tk.shingles(w, tk.word_hashes(part, w, lower=True), SHINGLE)
    return tk.distinct(s.doc, s.value, len(part.offsets) - 1)


@tk.frugal
def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch.column(1)):
            n = len(part.offsets) - 1
            value, offsets = _sets(part)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            marks = np.zeros((2, n), np.uint64)
            keys = np.zeros((0, BANDS), np.uint64)
            if len(full):
                starts = offsets[:-1][full]
                for k, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
                    marks[k, full] = np.add.reduceat(tk.mix(value ^ np.uint64(salt)), starts)
                keys = band_keys(signatures(value, np.append(starts, len(value))))
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)), pa.array(tk.signed(keys.reshape(-1)))
            )
            arrays = [batch.column(0).slice(part.first, n), pa.array(size.astype(np.int64)), pa.array(tk.signed(marks[0])), pa.array(tk.signed(marks[1])), bands]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "mark_a", "mark_b", "bands"])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, set size, a 128-bit mark of the set, and the band keys."""
    return docs.mapInArrow(sketch_batches, "doc_id long, n_shingles long, mark_a long, mark_b long, bands array<long>")


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


def links_in_group(ids: np.ndarray, side: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's sets.

    ``side``: 0 where a block meets itself; else 1 and 2, and only pairs across the sides are decided, as pairs
    within a side have a task of their own.
    """
    n = len(ids)
    order = np.lexsort((ids, np.diff(offsets)))
    token = np.unique(value, return_inverse=True)[1].astype(np.int32) if len(value) else np.zeros(0, np.int32)
    flags = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
    size = np.diff(offsets)[order]
    token = np.concatenate([token[offsets[i] : offsets[i + 1]] for i in order])
    limits = np.concatenate([[0], np.cumsum(size)])
    ids, side = ids[order], side[order]
    union, found = _Union(n), []
    for i in range(n - 1):
        last = int(np.searchsorted(size, 4 * size[i] / 3, side="right"))  # a link needs 4 * smaller >= 3 * larger
        if last <= i + 1:
            continue
        mine = token[limits[i] : limits[i + 1]]
        flags[mine] = True
        both = np.add.reduceat(flags[token[limits[i + 1] : limits[last]]].view(np.int8), limits[i + 1 : last] - limits[i + 1], dtype=np.int64)
        flags[mine] = False
        linked = 4 * both >= 3 * (size[i] + size[i + 1 : last] - both)
        if side[i]:
            linked &= side[i + 1 : last] != side[i]
        for j in i + 1 + np.flatnonzero(linked):
            a, b = union.find(i), union.find(int(j))
            if a != b:
                union.up[max(a, b)] = min(a, b)
                found.append((int(ids[i]), int(ids[j])))
    return found


@tk.frugal
def confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, doc_id, text) come sorted by key; each key's rows are one bounded group.

    Texts become sets as they come, so a group is held as its shingles alone.
    """

    def groups() -> Iterator[tuple[list, list, list]]:
        key, ids, sides, values = None, [], [], []
        for batch in batches:
            names, side, doc = (batch.column(k).to_pylist() for k in range(3))
            for part in tk.slices(batch.column(3)):
                value, limits = _sets(part)
                for i in range(len(limits) - 1):
                    at = part.first + i
                    if names[at] != key:
                        if len(ids) > 1:
                            yield ids, sides, values
                        key, ids, sides, values = names[at], [], [], []
                    ids.append(doc[at])
                    sides.append(side[at])
                    values.append(value[limits[i] : limits[i + 1]].copy())
        if len(ids) > 1:
            yield ids, sides, values

    for ids, sides, values in groups():
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int64)
        found = links_in_group(np.array(ids), np.array(sides), np.concatenate(values), offsets)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links) and kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drawn = stage(sketch(rows), "minmax-sketch")
    linkable = drawn.where("n_shingles > 0 and doc_id is not null")
    # Rows of one id are one node even where their sets differ: each set's class and the id's own classes meet below.
    members = linkable.select("doc_id", "mark_a", "mark_b", "n_shingles").distinct()
    classes = stage(members.groupBy("mark_a", "mark_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "set-classes")
    copies = members.join(classes.where("copies > 1"), ["mark_a", "mark_b", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    reps = linkable.join(classes, ["mark_a", "mark_b", "n_shingles"]).where("doc_id = rep").dropDuplicates(["mark_a", "mark_b", "n_shingles"])
    keyed, some = (x.select(F.explode("bands").alias("key"), "doc_id", "n_shingles") for x in (reps, sampled(linkable)))
    near = shared_keys(keyed, some, ["key"], ["doc_id"], "band-links", keep_key=True).select("key", F.col("first.doc_id").alias("leader"), "doc_id")
    node = components(near.select(F.col("doc_id").alias("u"), F.col("leader").alias("v")).distinct())

    sizes = classes.groupBy("rep").agg(F.max("n_shingles").alias("n")).withColumnRenamed("rep", "node")
    weighed = node.join(sizes, "node")
    total = weighed.groupBy("component").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    parts = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    grouped = stage(weighed.join(total.withColumn("parts", parts), "component").select("node", "n", "component", "parts"), "candidate-groups")
    whole = grouped.where("parts = 1").select(F.col("component").alias("key"), F.lit(0).alias("kind"), F.lit(0).alias("side"), F.col("node").alias("doc_id"))
    # Large groups: their band buckets, each dealt into block pairs.
    large = grouped.where("parts > 1").select(F.col("node").alias("doc_id"), "n")
    in_large = near.join(large.select("doc_id"), "doc_id", "left_semi")
    bucket = in_large.select("key", "doc_id").unionByName(in_large.select("key", F.col("leader").alias("doc_id"))).distinct().join(large, "doc_id")
    held = bucket.groupBy("key").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets")).withColumn("parts", parts).select("key", "parts")
    block = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = bucket.join(held, "key").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        F.xxhash64("key", low, high).alias("key"),
        (F.lit(1) + low * F.lit(1 << 15) + high).alias("kind"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == low, 1).otherwise(2).alias("side"),
        "doc_id",
    )
    wanted = stage(whole.unionByName(dealt), "groups-to-confirm")
    texts = rows.where("doc_id is not null").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    shipped = texts.join(wanted, "doc_id").select(F.struct("kind", "key").alias("group"), "side", "doc_id", F.col("text").cast("binary").alias("text"))
    shipped = shipped.repartition("group").sortWithinPartitions("group")
    shipped = shipped.select(F.concat_ws(":", "group.kind", "group.key").alias("key"), "side", "doc_id", "text")
    links = shipped.mapInArrow(confirm_batches, "u long, v long")
    final = components(links.unionByName(copies))
    out = drawn.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def with_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``_node``, a number for each id and text, which is the id where all its rows have one text.

    Of an id with several texts one keeps the id; the others are numbered past the largest id, or before the smallest
    where there is no room. Ids and 64-bit marks of texts are shuffled, whole texts only where there are such ids.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_mark")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), mark).distinct()
    several = texts.groupBy("_id").agg(F.min("_mark").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    others = stage(texts.join(several, "_id").where("_mark <> first").select("_id", "_mark"), "texts-of-repeated-ids")
    n = others.count()
    if not n:
        return docs.withColumn("_node", F.col(id_col).cast("long"))
    low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    if high + n < 1 << 63:
        place = F.lit(high) + 1 + F.col("idx")
    elif low - n >= -(1 << 63):
        place = F.lit(low) - 1 - F.col("idx")
    else:
        raise ValueError("the ids leave no room for further numbers")
    places = numbered(others.withColumn("tree", F.lit(0)), "tree", ["_id", "_mark"]).select("_id", "_mark", place.alias("_place"))
    met = docs.withColumns({"_id": F.col(id_col).cast("long"), "_mark": mark}).join(stage(places, "numbered-texts"), ["_id", "_mark"], "left")
    return met.withColumn("_node", F.coalesce("_place", "_id")).select(*docs.columns, "_node")


@tidy
def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near duplicates: of each group one text stays, the one of the smallest node, and of its rows one.

    Texts are judged by themselves, also where several have one id. Rows without an id stay as they are.
    """
    rows = with_nodes(docs, id_col, text_col)
    seen = near_duplicates(rows, "_node", text_col).where("doc_id is not null").groupBy(F.col("doc_id").alias("_node"))
    seen = stage(seen.agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "near-duplicates")
    whole = rows.join(seen.select("_node"), "_node", "left_anti").select(*docs.columns)
    several = rows.join(seen.where("kept").select("_node"), "_node", "left_semi").dropDuplicates(["_node"]).select(*docs.columns)
    return whole.unionByName(several)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
