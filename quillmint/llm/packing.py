"""Operator 3: best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Texts become token ids and an end id; only a text longer than a sequence is cut. The lengths alone are then packed:
pieces are dealt into groups of about ``GROUP_PIECES`` by a hash, each group is packed best-fit decreasing by a
segment tree over remaining capacities, and what lies in sequences filled below ``REFILL`` is pooled and packed again,
so that a group leaves about one open sequence per pool and not per group. Group sizes follow from a count, so no task
grows with the table.

Defined results: a null or empty text is the end id alone; a null id is packed like any other; rows repeat as often
as they come, each with its own place; other columns of the input are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm import textkit as tk
from quillmint.llm.staging import stage, tidy
from quillmint.llm.tokenise import word_coder

CAPACITY, END_ID = 4096, 1
GROUP_PIECES, REFILL = 8192, 0.97


class BestFit:
    """Open sequences by remaining capacity: leaf r of a segment tree counts those with r tokens free."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}
        self.capacity, self.made = capacity, 0

    def _change(self, free: int, by: int) -> None:
        at, count = free + self.size, self.count
        while at:
            count[at] += by
            at >>= 1

    def _tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open sequence has."""
        count, at = self.count, length + self.size
        if count[at]:
            return length
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """Sequence number and offset of the next piece."""
        free = self._tightest(length)
        if free is None:
            free, number = self.capacity, self.made
            self.made += 1
        else:
            number = self.open[free].pop()
            self._change(free, -1)
        left = free - length
        if left:
            self.open.setdefault(left, []).append(number)
            self._change(left, 1)
        return number, self.capacity - free


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, longest first."""
    fit = BestFit(capacity)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        number[i], offset[i] = fit.place(int(lengths[i]))
    return number, offset


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 500_000) -> DataFrame:
    """Pieces of every whole text: doc_id, piece, start, length and ids (unsigned little-endian 32-bit, binary).

    A worker remembers the ids of up to twice ``cached_words`` words, at about 200 bytes each.
    """
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer, cached_words)
        for batch in batches:
            for part in tk.slices(batch.column(1)):
                raw, limits = part.data.tobytes(), part.offsets.tolist()
                coded = coder.encode([raw[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)])
                row, piece, start, ids = [], [], [], []
                for i, x in enumerate(coded):
                    x += end
                    for k in range(0, len(x), width):
                        row.append(part.first + i)
                        piece.append(k // width)
                        start.append(k // 4)
                        ids.append(x[k : k + width])
                length = pa.array([len(x) // 4 for x in ids], pa.int64())
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), length, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _pack_groups(pieces: DataFrame, groups: int, first: int, capacity: int) -> DataFrame:
    """Pack each hash group on its own; sequence_id is unique over groups and passes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch], group: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            number, offset = pack_lengths(table.column("length").to_numpy(), capacity)
            fill = np.bincount(number, weights=table.column("length").to_numpy())[number].astype(np.int64)
            extra = [pa.array(((first + group) << 32) + number), pa.array(offset), pa.array(fill)]
            whole = table.to_batches()[0]
            return pa.RecordBatch.from_arrays([*whole.columns, *extra], names=[*whole.schema.names, "sequence_id", "offset", "_pack_fill"])

        held, group = [], None
        for batch in batches:
            keys = batch.column("_pack_group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if group is not None and keys[a] != group:
                    yield flush(held, group)
                    held = []
                group = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(held, group)

    fields = [f for f in pieces.schema.fields if f.name not in ("_pack_group", "sequence_id", "offset", "_pack_fill")]
    names = [f.name for f in fields]
    dealt = pieces.select(*names, F.pmod(F.xxhash64(F.lit(first), "_pack_row"), F.lit(groups)).cast("int").alias("_pack_group"))
    dealt = dealt.repartition(min(groups, 4096), "_pack_group").sortWithinPartitions("_pack_group", F.desc("length"), "_pack_row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return dealt.mapInArrow(pack, f"{schema}, _pack_group int, sequence_id long, offset long, _pack_fill long").drop("_pack_group")


@tidy
def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, refill: float = REFILL) -> DataFrame:
    """Add sequence_id and offset to rows with a column length (1 to ``capacity``); other columns are joined again by row."""
    kept = pieces.columns
    full = F.col("length") == capacity
    rows = stage(pieces.withColumn("_pack_row", F.monotonically_increasing_id()), "pieces")
    part = rows.where(~full).select("_pack_row", "length")
    once = stage(_pack_groups(part, max(1, -(-part.count() // group_pieces)), 1, capacity), "packed-once")
    loose = F.col("_pack_fill") < refill * capacity
    m = once.where(loose).count()
    # The sequence count of each pass bounds its groups, so pass 2 starts numbering beyond pass 1.
    again = _pack_groups(once.where(loose), max(1, -(-m // (4 * group_pieces))), 1 << 24, capacity)
    alone = rows.where(full).select("_pack_row", (F.col("_pack_row") - F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = ["_pack_row", "sequence_id", "offset"]
    place = once.where(~loose).select(*placed).unionByName(again.select(*placed)).unionByName(alone)
    return rows.join(place.hint("merge"), "_pack_row").select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary) and the doc_ids in order.

    A sequence holds at most its capacity in tokens, which bounds the group that is gathered.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (acc, x) -> acc || x.ids)").alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(digest)
