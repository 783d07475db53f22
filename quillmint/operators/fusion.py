"""Fusing what several readers read: classes of comparable values, dependent readers once, rivals, checks, calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# At and above which confidence a confirmed value is verified, and without a confirmation at most so sure;
# what a failed check leaves at most, and a check whose failure has innocent reasons; how many cases of a pattern the
# readers' own confidence weighs in calibration; a rival that has so much of the chosen value's strength is named.
VERIFIED_AT, UNCONFIRMED, FAILED, SOFT, OWN_CASES, NAMED_RIVAL = 0.985, 0.98, 0.5, 0.97, 2, 0.5
MOST_SURE = 0.995  # of one reader alone


def six(x: Column) -> Column:
    """Six places; what lies on a half but for the last bits of a double goes up."""
    return F.round(x + 1e-9, 6)


def fused(readings: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """Per key: the chosen value, its confidence, its readers' families, the strongest rival's value and share, the evidence.

    ``readings`` has value (long; texts come as numbered forms), family and probability. Sorted values no more than
    ``tolerance`` apart are one class. Of a family, whose readers err together, the surest reader of a class counts;
    families are independent: a class is wrong only if all of its families are. With odds w = p / (1 - p) of each class
    its confidence is its share of 1 + the sum of all odds, where 1 stands for none of them. A class's value is the one
    its surest family read, the smallest on a tie.
    """
    of_key = Window.partitionBy(*key)
    apart = F.coalesce((F.col("value") - F.lag("value").over(of_key.orderBy("value")) > tolerance).cast("int"), F.lit(0))
    classed = readings.where("value is not null").withColumn("apart", apart)
    classed = classed.withColumn("class", F.sum("apart").over(of_key.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)))
    surest = F.max_by("value", F.struct("probability", -F.col("value")))
    families = classed.groupBy(*key, "class", "family").agg(F.least(F.max("probability"), F.lit(MOST_SURE)).alias("p"), surest.alias("value"))
    classes = families.groupBy(*key, "class").agg(
        F.round(1 - F.exp(F.sum(F.log(1 - F.col("p")))), 9).alias("strength"), F.max_by("value", F.struct("p", -F.col("value"))).alias("value"), F.array_join(F.array_sort(F.collect_list("family")), "+").alias("families"),
    )
    odds = F.col("strength") / (1 - F.col("strength"))
    best_first = of_key.orderBy(F.desc("strength"), "value")
    ranked = classes.withColumns({"n": F.row_number().over(best_first), "odds": odds, "all_odds": F.sum(odds).over(of_key), "rival": F.lead("value").over(best_first), "rival_strength": F.lead("strength").over(best_first)})
    share = F.coalesce(F.col("rival_strength") / F.col("strength"), F.lit(0.0))
    top = ranked.where("n = 1").select(*key, "value", six(F.col("odds") / (1 + F.col("all_odds"))).alias("confidence"), "families", "rival", six(share).alias("rival_share"))
    return top.withColumn("evidence", evidence_of(F.col("families"), F.col("rival_share")))


def _fused_lists(readings: pa.ListArray, tolerance: int) -> pa.StructArray:
    """What ``fused`` finds, of each list of readings (value, family, probability): the confidence and the rival's share not yet rounded."""
    rows, flat = len(readings), readings.flatten()
    owner = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(readings), 0).to_numpy(zero_copy_only=False))
    read = flat.field("value").is_valid().to_numpy(zero_copy_only=False)
    names = flat.field("family").filter(pa.array(read))
    known = sorted(x for x in names.unique().to_pylist())
    family = pc.index_in(names, value_set=pa.array(known, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    value, sure, owner = flat.field("value").filter(pa.array(read)).to_numpy(zero_copy_only=False), flat.field("probability").to_numpy(zero_copy_only=False)[read], owner[read]

    def begins(*keys: np.ndarray) -> np.ndarray:
        """Where rows in order differ from the row before."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return new

    at = np.lexsort((value, owner))
    value, sure, owner, family = value[at], sure[at], owner[at], family[at]
    apart = begins(owner)
    apart[1:] |= np.diff(value) > tolerance
    of_class = np.cumsum(apart) - 1
    at = np.lexsort((value, -sure, family, of_class))
    at = at[begins(of_class[at], family[at])] if len(at) else at  # of a family its surest reader, the smallest value on a tie
    value, p, family, of_class, owner = value[at], np.minimum(sure[at], MOST_SURE), family[at], of_class[at], owner[at]
    first = np.flatnonzero(begins(of_class)) if len(at) else at
    doubt = np.add.reduceat(np.log(1 - p), first) if len(at) else p
    strength, of_row = np.round(1 - np.exp(doubt), 9), owner[first]
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(known, pa.string()).take(pa.array(family)))
    families = pc.binary_join(lists, "+")
    best = np.lexsort((value, -p, of_class))
    chosen = value[best[first]]  # classes begin at the same places in this order
    odds = strength / (1 - strength)
    every = np.bincount(of_row, odds, rows)
    order = np.lexsort((chosen, -strength, of_row))
    top = np.flatnonzero(begins(of_row[order])) if len(order) else order
    after = np.minimum(top + 1, max(len(order) - 1, 0))
    has_rival = (after > top) & (of_row[order[after]] == of_row[order[top]])
    one, two = order[top], order[after]
    place = np.full(rows, -1)
    place[of_row[one]] = np.arange(len(top))
    found = {
        "value": pa.array(chosen[one]), "confidence": pa.array(odds[one] / (1 + every[of_row[one]])), "families": families.take(pa.array(one)),
        "rival": pa.array(chosen[two], mask=~has_rival), "rival_share": pa.array(np.where(has_rival, strength[two] / strength[one], 0.0)),
    }
    take = pa.array(place, mask=place < 0)
    return pa.StructArray.from_arrays([x.take(take) for x in found.values()], names=list(found))


def fused_lists(rows: DataFrame, columns: Sequence[str], tolerance: int) -> DataFrame:
    """Rows whose ``columns``, arrays of readings (value, family, probability) that come with the row, become what ``fused`` finds of
    them: a struct (value, confidence, families, rival, rival_share, evidence), null fields where nothing was read. No row moves."""
    found = "struct<value: bigint, confidence: double, families: string, rival: bigint, rival_share: double>"
    schema = ", ".join(f"{f.name} {found if f.name in columns else f.dataType.simpleString()}" for f in rows.schema)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_fused_lists(x, tolerance) if n in columns else x for n, x in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    def told(c: str) -> Column:
        share = six(F.col(f"{c}.rival_share"))
        return F.struct(F.col(f"{c}.value"), six(F.col(f"{c}.confidence")).alias("confidence"), F.col(f"{c}.families"), F.col(f"{c}.rival"), share.alias("rival_share"), evidence_of(F.col(f"{c}.families"), share).alias("evidence")).alias(c)

    return rows.mapInArrow(fuse, schema).select(*(told(c) if c in columns else c for c in rows.columns))


def evidence_of(families: Column, share: Column) -> Column:
    """The pattern of evidence that cases are counted by: who agreed, and how strong the rival was."""
    return F.concat(families, F.when(share >= NAMED_RIVAL, "|rival").when(share > 0, "|weak rival").otherwise(""))


def judged(rows: DataFrame) -> DataFrame:
    """Rows (value, confidence, rival_share, confirms, failed, soft) with the confidence that checks leave and a status.

    Every check that confirms a value halves its doubt. Caps come after: a failed check, a soft one, none that confirms.
    Statuses: missing, check (a failed check, or a rival as strong), likely, verified.
    """
    confirmed = (F.col("confirms") > 0) & ~F.col("failed")
    sure = F.when(confirmed, 1 - (1 - F.col("confidence")) * F.pow(F.lit(0.5), F.col("confirms"))).otherwise(F.col("confidence"))
    capped = F.least(sure, F.when(F.col("failed"), FAILED).when(F.col("soft"), SOFT).when(~confirmed, UNCONFIRMED).otherwise(1.0))
    status = F.when(F.col("value").isNull(), "missing").when(F.col("failed") | (F.col("rival_share") >= 1), "check").when(confirmed & (capped >= VERIFIED_AT), "verified").otherwise("likely")
    return rows.withColumns({"confidence": six(F.when(F.col("value").isNull(), 0.0).otherwise(capped)), "status": status})


def calibrated(rows: DataFrame, past: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the confidence that past cases of their evidence (``key``; cases, right) support, as so many cases beside OWN_CASES of their own."""
    met = rows.join(past, key, "left")
    learned = (F.col("right") + OWN_CASES * F.col("confidence")) / (F.col("cases") + OWN_CASES)
    return met.withColumn("calibrated", six(F.coalesce(learned, F.col("confidence")))).drop("cases", "right")
