"""Operator 11: a Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

Every row is a leaf, the SHA-256 of its columns. The leaves of one source ascend by id and form a tree whose runs are 16
nodes wide; the sources' roots, ordered by source, form a second tree in the same way. In an upward superstep every node
sends its digest to its parent; a parent that has its children, at most 16, hashes them and takes part in the next
superstep. In the reverse supersteps a parent hands every child the path from it to the root: its slot in the run and its
siblings' digests, and so on upward. The runs of leaves fold their claimed digests along these paths.

A leaf's number comes from one range sort, so a source may hold any share of the rows; a node's key is its tree and
number, so no group has more than 16 members and a path. Every superstep is a file in the shared folder, from which lost
executors' work is done again. Each run of leaves gets its path once; whole paths of single leaves are written only with
``keep_proofs``.

Defined results: a null value is encoded as ``-``, an empty text as ``0:``; a null source is a tree of its own and comes
first, a null id comes first in its source; rows of one id are leaves of their own, ordered by their digests; a source of
one row has its leaf as root; other columns of the input are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from binascii import hexlify
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmint.llm.sqltext import CRC_TABLE, crc_sql
from quillmint.llm.staging import new_path, remove, stage, tidy

FAN = 16
WIDTH = 32  # bytes of a digest
NODES_A_TASK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Key = tuple[str | None, int]  # a tree and a number in a level
State = tuple[bytes, bytes, tuple[tuple[int, bytes], ...]]  # subroot, root, and (slot, siblings) from a node upward


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def node_digest(children: bytes) -> bytes:
    """The digest of a run, whose members' digests are hashed as hexadecimal text."""
    return hashlib.sha256(hexlify(children)).digest()


def _place(key: Key) -> int:
    return zlib.crc32(repr(key).encode())


def _numbering(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, the tree in the first column: their partition, the tree's run in it, and their place in the run."""
    part, run, at, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        runs, places = [], []
        for tree in batch.column(0).to_pylist():
            if run < 0 or tree != last:
                run, at, last = run + 1, 0, tree
            runs.append(run)
            places.append(at)
            at += 1
        more = [pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "_run", "_at"])


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with ``idx``, their number within the tree, and ``n``, the tree's size; the tree is the first column.

    One range sort numbers all trees: a partition numbers its own rows, and what earlier partitions hold of a tree is added.
    """
    rows = rows.select(tree, *(c for c in rows.columns if c != tree))
    keys = list(dict.fromkeys([tree, *order]))
    kinds = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_at", T.LongType())])
    placed = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_numbering, kinds), "numbered")
    runs = placed.groupBy("_part", "_run").agg(F.first(tree).alias(tree), F.count("*").alias("rows"))
    of_tree = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stage(runs.select("_part", "_run", before.alias("_before"), F.sum("rows").over(of_tree).alias("n")), "tree-runs")
    return placed.join(runs, ["_part", "_run"]).withColumn("idx", F.col("_before") + F.col("_at")).drop("_part", "_run", "_at", "_before")


def _to_parent(tree: str | None, idx: int, n: int, digest: bytes, own: tuple = ()) -> tuple[Key, tuple]:
    return (tree, idx // FAN), (idx % FAN, n, digest, own)


def _completed(group: tuple[Key, Iterable[tuple]]) -> tuple[Key, tuple]:
    """A parent with its children in order: the size of their level, their digests, and what they carry."""
    (tree, at), children = group[0], sorted(group[1], key=lambda c: c[0])
    n = children[0][1]
    if [c[0] for c in children] != list(range(min(FAN, n - FAN * at))):
        raise ValueError(f"run {at} of {tree!r} lacks children")
    return (tree, at), (n, b"".join(c[2] for c in children), [c[3] for c in children])


def _hashed(parent: tuple[Key, tuple]) -> tuple[str | None, int, int, bytes]:
    """The parent as a node: tree, number, size of its level, digest. A lone leaf stays what it is."""
    (tree, at), (n, digests, _) = parent
    return tree, at, -(-n // FAN), digests if n == 1 else node_digest(digests)


def rise(spark: SparkSession, messages: RDD, largest: int, leaves: int) -> tuple[list[str], RDD]:
    """Upward supersteps: the files of every level's runs, and each tree's (tree, (level of its runs, root)).

    ``messages`` are the leaves' to their parents. As many supersteps follow as the largest tree has levels.
    """
    sc, files, tops = spark.sparkContext, [], []
    while True:
        level = len(files)
        nodes = leaves // FAN**level
        parts = max(4, min(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes // 1000), nodes // NODES_A_TASK)
        files.append(new_path(spark, f"runs-{level}"))
        messages.groupByKey(parts, _place).map(_completed).coalesce(parts).saveAsPickleFile(files[-1])
        grown = sc.pickleFile(files[-1]).map(_hashed)
        tops.append(grown.filter(lambda x: x[2] == 1).map(lambda x, level=level: (x[0], (level, x[3]))))
        messages = grown.filter(lambda x: x[2] > 1).map(lambda x: _to_parent(*x))
        if FAN ** len(files) >= largest:
            return files, sc.union(tops)


def _met(group: tuple[Key, Iterable[tuple]]) -> tuple[Key, tuple, State]:
    """A run and the state that its parent has sent."""
    (_, *run), (_, state) = sorted(group[1], key=lambda x: x[0])
    return group[0], tuple(run), state


def _siblings(digests: bytes, slot: int) -> bytes:
    return digests[: slot * WIDTH] + digests[(slot + 1) * WIDTH :]


def _handed_down(met: tuple[Key, tuple, State]) -> Iterator[tuple[Key, State]]:
    """Every child of a run with the path from it to the root."""
    (tree, at), (n, digests, carried), (subroot, root, path) = met
    for i in range(len(carried)):
        yield (tree, at * FAN + i), (subroot, root, ((i, _siblings(digests, i)), *path) if n > 1 else path)


def descend(spark: SparkSession, runs: list[str], starts: RDD) -> tuple[RDD, list[str]]:
    """Reverse supersteps: runs of leaves with their parents' states, and the files written meanwhile.

    ``starts`` are the trees' roots as (tree, (level of its runs, state)); a root enters in the superstep of that level.
    """
    sc, handed, files = spark.sparkContext, None, []
    for level in reversed(range(len(runs))):
        below = sc.pickleFile(runs[level])
        states = starts.filter(lambda x, level=level: x[1][0] == level).map(lambda x: ((x[0], 0), x[1][1]))
        states = states if handed is None else states.union(handed)
        both = below.map(lambda x: (x[0], (0, *x[1]))).union(states.map(lambda x: (x[0], (1, x[1]))))
        parts = max(4, below.getNumPartitions())
        met = both.groupByKey(parts, _place).map(_met).coalesce(parts)
        if level:
            files.append(new_path(spark, f"paths-{level}"))
            met.flatMap(_handed_down).saveAsPickleFile(files[-1])
            handed = sc.pickleFile(files[-1])
    return met, files


def fold(digest: bytes, path: Iterable[tuple[int, bytes]]) -> bytes:
    """The root that a digest and its siblings lead to."""
    for slot, siblings in path:
        digest = node_digest(siblings[: slot * WIDTH] + digest + siblings[slot * WIDTH :])
    return digest


def _verified(met: tuple[Key, tuple, State]) -> Iterator[tuple]:
    """A run's leaves, folded from the claimed digests; what lies above the run is hashed once for each start."""
    _, (n, digests, carried), (subroot, root, path) = met
    above, ends = hexlify(b"".join(s for _, s in path)), {}
    for i, (doc_id, claimed) in enumerate(carried):
        own = _siblings(digests, i)
        start = fold(claimed, [(i, own)]) if n > 1 else claimed
        if start not in ends:
            ends[start] = fold(start, path)
        proof = hexlify(own) + above
        yield doc_id, digests[i * WIDTH : (i + 1) * WIDTH].hex(), subroot.hex(), root.hex(), proof, ends[start].hex(), ends[start] == root


RESULT = "doc_id long, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean"


def _tree(spark: SparkSession, rows: DataFrame, carried: list[str]) -> tuple[list[str], RDD]:
    """Rise from numbered rows (tree, idx, n, digest), which carry the named columns."""
    sizes = rows.agg(F.max("n"), F.count("*")).first()
    vertices = rows.select(rows.columns[0], "idx", "n", "digest", *carried).rdd
    return rise(spark, vertices.map(lambda r: _to_parent(r[0], r[1], r[2], bytes(r[3]), tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[4:]))), *sizes)


@tidy
def manifest(leaves: DataFrame, keep_proofs: bool = False) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``leaves`` has source, doc_id, ``digest`` and ``claimed``, the digest that is to be verified, both binary. With
    ``keep_proofs`` the column ``proof`` holds the siblings' hexadecimal digests from the leaf to the root.
    """
    spark = leaves.sparkSession
    leaves = stage(leaves.select("source", F.col("doc_id").cast("long").alias("doc_id"), "digest", "claimed"), "leaves")
    if leaves.isEmpty():
        return _digests(spark.createDataFrame([], RESULT), keep_proofs)
    own = stage(numbered(leaves, "source", ["doc_id", "digest", "claimed"]), "numbered-leaves")
    runs, tops = _tree(spark, own, ["doc_id", "claimed"])
    roots = spark.createDataFrame(tops.map(lambda x: (None, x[0], *x[1])), "forest string, source string, level int, digest binary")
    roots = stage(roots, "subroots")
    over, top = _tree(spark, stage(numbered(roots, "forest", ["source"]), "numbered-subroots"), ["source", "level", "digest"])
    ((_, (level, root)),) = top.collect()  # the one root of the one upper tree
    upper, paths = descend(spark, over, spark.sparkContext.parallelize([(None, (level, (root, root, ())))], 1))

    def started(met: tuple[Key, tuple, State]) -> Iterator[tuple[str | None, tuple[int, State]]]:
        for (_, (_, _, path)), (source, at, subroot) in zip(_handed_down(met), met[1][2], strict=True):
            yield source, (at, (subroot, root, path))

    begun = new_path(spark, "subroot-paths")
    upper.flatMap(started).saveAsPickleFile(begun)
    lower, more = descend(spark, runs, spark.sparkContext.pickleFile(begun))
    rows = spark.createDataFrame(lower.flatMap(_verified), RESULT, verifySchema=False)
    out = stage(_digests(rows, keep_proofs), "manifest")
    for path in (*runs, *over, *paths, *more, begun):
        remove(spark, path)
    return out


def _digests(rows: DataFrame, keep_proofs: bool) -> DataFrame:
    kept = [F.col("proof").cast("string").alias("proof")] if keep_proofs else []
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified", *kept)


def tampered(docs: DataFrame) -> Column:
    """The text, A-Z lowered where 5 divides the CRC-32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def document_leaves(docs: DataFrame, claimed_text: Column) -> DataFrame:
    """Leaves of documents, and the digests they would have with the other text."""
    first = [F.col(c) for c in COLUMNS[:-1]]
    return docs.select("source", "doc_id", leaf_digest(*first, F.col("text")).alias("digest"), leaf_digest(*first, claimed_text).alias("claimed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(document_leaves(docs, tampered(docs)))


def _sql(levels: int, upper: int) -> str:
    """SQL of the whole manifest for sources of up to 16 ** levels rows and up to 16 ** upper sources."""

    def part(x: str) -> str:
        return f"case when {x} is null then '-' else octet_length(encode(cast({x} as varchar))) || ':' || {x} end"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(part, (*COLUMNS[:-1], text)))})"

    changed = f"case when {crc_sql('cast(doc_id as varchar)')} % 5 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end"
    steps = [
        CRC_TABLE,
        f"read as (select *, {changed} as other from documents, crc_table)",
        f"leaves as (select source, doc_id, {leaf('text')} as d, {leaf('other')} as claimed from read)",
        "n0 as (select source, row_number() over (partition by source order by doc_id nulls first, d, claimed) - 1 as i, count(*) over (partition by source) as n, d, doc_id, claimed from leaves)",
        "w0 as (select doc_id, source as tree, source, i, d as leaf, claimed as folded, '' as proof from n0)",
        "t0 as (select source as tree, i, n, d from n0)",
    ]

    def level(t: str, w: str, k: int) -> None:
        steps.append(f"r{t}{k} as (select tree, i // 16 as r, any_value(n) as n, list(d order by i) as ds from {t}{k} group by all)")
        steps.append(f"{t}{k + 1} as (select tree, r as i, (n + 15) // 16 as n, case when n = 1 then ds[1] else sha256(array_to_string(ds, '')) end as d from r{t}{k})")
        before, after = "array_to_string(ds[1:i % 16], '')", "array_to_string(ds[i % 16 + 2:], '')"
        steps.append(
            f"{w}{k + 1} as (select doc_id, {w}{k}.tree, source, i // 16 as i, leaf, case when n = 1 then folded else sha256({before} || folded || {after}) end as folded, "
            f"case when n = 1 then proof else proof || {before} || {after} end as proof from {w}{k} join r{t}{k} on r{t}{k}.tree is not distinct from {w}{k}.tree and r = i // 16)"
        )

    for k in range(levels):
        level("t", "w", k)
    steps.append(f"u0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as i, count(*) over () as n, d, tree as source from t{levels})")
    steps.append(f"v0 as (select doc_id, 0 as tree, w{levels}.source, u0.i, leaf, folded, proof from w{levels} join u0 on w{levels}.tree is not distinct from u0.source)")
    steps.append("x0 as (select tree, i, n, d from u0)")
    for k in range(upper):
        level("x", "v", k)
    # The walks keep no subroot; it is joined again by source.
    return (
        "with " + ",\n".join(steps) + f"""
select doc_id, leaf, u0.d as subroot, x{upper}.d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = x{upper}.d as verified
from v{upper} join u0 on u0.source is not distinct from v{upper}.source, x{upper}
"""
    )


OP11_SQL = _sql(4, 2)
