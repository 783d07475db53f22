"""Who holds a key first, where a third of all rows may hold one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmint.llm.staging import low_share, stage

SAMPLED = 32  # one document in so many is sampled to find hot keys
HOT_KEYS = 1 << 14
LOT = 4096  # rows of a hot key that one group should hold


def sampled(rows: DataFrame) -> DataFrame:
    """The rows of about one in SAMPLED ids, by a hash."""
    return rows.where(low_share(F.xxhash64(F.lit("sampled"), "doc_id"), 1, SAMPLED))


def hot_keys(sample: DataFrame, key: list[str]) -> DataFrame:
    """Keys that hold more than 1 / HOT_KEYS of the sampled rows, so fewer than HOT_KEYS, and their numbers of lots."""
    counted = stage(sample.groupBy(*key).agg(F.count("*").alias("n")), "sampled-keys")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.col("n") > max(8, total // HOT_KEYS)).select(*key, F.ceil(F.col("n") * SAMPLED / LOT).cast("int").alias("lots"))


def shared_keys(keys: DataFrame, sample: DataFrame, key: list[str], who: list[str], name: str, keep_key: bool = False, firsts: str = "false", kept: str = "false") -> DataFrame:
    """Rows whose key a smaller id holds too, with the key's ``first`` holder and the holder just ``before``, structs of ``who``.

    Of rows with ``firsts``, a condition, those of the first holder come as well, if another id holds the key too.
    Rows with ``kept``, a condition, come with their key, if three rows or more hold it, and ``held``, how many do
    (LOT at least for a hot key); so all its holders can be met.

    ``who`` begins with doc_id and orders the holders. ``sample``, the keys of ``sampled`` rows, decides only which keys
    are dealt into lots: a hot key is ordered lot by lot and its first holder is the least of the lots', of which the
    driver broadcasts fewer than HOT_KEYS rows; ``before`` is then the holder before in the same lot.
    """
    lot = F.when(F.col("lots").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("lots"))).cast("int")
    dealt = keys.join(F.broadcast(hot_keys(sample, key)), key, "left").withColumn("lot", lot)
    order = Window.partitionBy(*key, "lot").orderBy(*who)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct(*who)
    met = dealt.withColumns({"first": F.first(me).over(whole), "last": F.last("doc_id").over(whole), "before": F.lag(me).over(order)})
    stays = F.col("lots").isNotNull()
    if kept != "false":
        met = met.withColumn("held", F.when(F.col("lots").isNull(), F.count("*").over(whole)).otherwise(LOT).cast("int"))
        stays |= F.expr(f"held > 2 and {kept}")
    met = met.where(f"lots is not null or first.doc_id <> doc_id or first.doc_id <> last and {firsts}").drop("lot", "last")
    hot_only = [F.col(k) if keep_key else F.when(stays, F.col(k)).alias(k) for k in key]
    met = stage(met.select(*hot_only, *(c for c in met.columns if c not in key)), name)
    lead = met.where("lots is not null").groupBy(*key).agg(F.min("first").alias("lead"))
    found = met.join(F.broadcast(lead), key, "left").withColumn("first", F.coalesce("lead", "first"))
    return found.where(f"first.doc_id <> doc_id or {firsts}").drop("lead", "lots", *([] if keep_key or kept != "false" else key))
