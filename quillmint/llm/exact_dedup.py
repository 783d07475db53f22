"""Operator 13: exact duplicates by content-defined chunk recipes.

A text, A-Z lowered, is cut where a rolling hash of its last 32 bytes says so, so the cuts depend on the text alone. A chunk's
mark is a keyed 128-bit digest, and a text's recipe the marks of its chunks in order. Texts whose recipes another row
shares go through the chunker again; their chunks, each once for a map task, are brought together by mark, and the bytes
under a mark are compared. Where no mark stands for two chunks, the marks are verified identifiers: equal recipes are
equal texts. Otherwise the whole is done again under another key. Only recipes and the chunks of shared texts are
shuffled, whole texts never.

A filter of ``filter_bits`` bits tells tasks which recipes are shared; it is the only thing that is broadcast whatever
the table's size. A full filter lets more chunks be compared and changes no result. Groups of more than 1 / HOT_GROUPS of
all rows, so fewer than HOT_GROUPS, meet their rows by a broadcast, the others by a shuffle.

Defined results: a null text counts as empty, and empty texts are equal; of the rows of one group the one with the largest
id stays, a null id being smaller than any other, and of several rows of that id and text one; rows repeat as often as
they come; other columns of the input are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm import textkit as tk
from quillmint.llm.staging import stage, tidy

LEAST_CHUNK, MEAN_BITS, MOST_CHUNK = 256, 10, 8192  # bytes; a cut falls after a byte with a chance of 2 ** -MEAN_BITS
MARK_BYTES = 16
HOT_GROUPS, SHORT_RECIPE = 1024, 4096
_GEAR = (tk.mix(np.arange(301, 557, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: the last 32 bytes' rolling sum has only zeros in its upper bits."""
    total = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        before = total[:-width] << np.uint32(width)
        total[width:] += before
    return np.flatnonzero(total < np.uint32(1 << (32 - MEAN_BITS))) + 1


def chunk_ends(places: np.ndarray, start: int, end: int) -> list[int]:
    """The chunks' ends between two byte positions, each LEAST_CHUNK to MOST_CHUNK bytes long but for the last."""
    ends, at = [], start
    while at < end:
        k = int(np.searchsorted(places, at + LEAST_CHUNK))
        cut = min(at + MOST_CHUNK, int(places[k]) if k < len(places) else end, end)
        ends.append(cut)
        at = cut
    return ends


def mark_of(chunk: bytes, key: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=MARK_BYTES, key=key.to_bytes(8, "little")).digest()


def chunked(column: pa.Array, key: int) -> Iterator[tuple[bytes, list[bytes], list[bytes]]]:
    """Of each text: its bytes with A-Z lowered, its chunks, and their marks."""
    for part in tk.slices(column):
        data = tk.lowered(part.data)
        places, whole = cut_places(data), data.tobytes()
        for start, end in itertools.pairwise(part.offsets.tolist()):
            ends = chunk_ends(places, start, end)
            chunks = [whole[a:b] for a, b in zip([start, *ends], ends, strict=False)]
            yield whole[start:end], chunks, [mark_of(c, key) for c in chunks]


def recipe_batches(key: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, digests = [], []
            for text, _, marks in chunked(batch.column(2), key):
                recipes.append(b"".join(marks))
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(recipes, pa.binary()), pa.array(digests, pa.string())], names=["row", "doc_id", "recipe", "text_sha256"])

    return run


def shared_chunk_batches(key: int, held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chunks of the texts whose recipes the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            marks, chunks, size = [], [], 0
            for _, own, names in chunked(batch.column(0), key):
                at = zlib.crc32(b"".join(names)) % (64 * len(words))
                if names and int(words[at >> 6]) >> (at & 63) & 1:
                    marks += names
                    chunks += own
                    size += sum(map(len, own))
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(chunks, pa.binary())], names=["mark", "chunk"])
                    marks, chunks, size = [], [], 0
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(chunks, pa.binary())], names=["mark", "chunk"])

    return run


def _filter(shared: DataFrame, bits: int) -> np.ndarray:
    """One bit for each place that a shared recipe has; at most bits / 64 rows reach the driver."""
    at = F.crc32("recipe") % bits
    places = shared.where(F.length("recipe") > 0).select(F.floor(at / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(crc32(recipe) % 64 as int))").alias("bit"))
    found = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint64)


@tidy
def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 24) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256, the digest of the text with A-Z lowered."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text)
    for key in itertools.count():
        drawn = stage(rows.mapInArrow(recipe_batches(key), "row long, doc_id long, recipe binary, text_sha256 string"), "recipes")
        stays = F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("stays")
        groups = drawn.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), stays)
        groups = stage(groups.where("group_size > 1"), "shared-recipes")
        held = spark.sparkContext.broadcast(_filter(groups, filter_bits))
        chunks = docs.select(text).mapInArrow(shared_chunk_batches(key, held), "mark binary, chunk binary").distinct()
        if not chunks.groupBy("mark").count().where("count > 1").limit(1).count():
            break
    total = drawn.count()
    short = (F.col("group_size") * HOT_GROUPS > total) & (F.length("recipe") <= SHORT_RECIPE)
    hot = groups.where(short).withColumn("hot", F.lit(True))
    met = drawn.join(F.broadcast(hot), "recipe", "left")
    done = met.where("hot").drop("hot", "recipe")
    rest = met.where("hot is null").select(*drawn.columns).join(groups.where(~short), "recipe", "left").drop("recipe")
    out = done.unionByName(rest.select(*done.columns))
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("stays"))).alias("kept"), "text_sha256",
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""
