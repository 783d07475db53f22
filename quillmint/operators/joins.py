"""Joins of the payables domain: as-of, overlap, successor, tiered linkage, fuzzy equality, consumption."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from quillmint.operators.carry import runs


def as_of(facts: DataFrame, rates: DataFrame, key: str, at: str, start: str, end: str, rank: Column, row: str) -> DataFrame:
    """The rate row in force at a fact's date: start <= at <= end (null: open); the best ``rank`` wins, then the latest start.

    ``row`` identifies a fact. Facts without a rate stay, with nulls. A rate table is a dimension; where it is large
    the equality on ``key`` still makes this a hash or merge join.
    """
    r = rates.withColumnRenamed(key, "_k").withColumn("_rank", rank)
    hit = (F.col(key) == F.col("_k")) & (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    best = F.row_number().over(Window.partitionBy(row).orderBy(F.desc_nulls_last("_rank"), F.desc_nulls_last(start)))
    return facts.join(r, hit, "left").withColumn("_best", best).where("_best = 1").drop("_best", "_rank", "_k")


def overlaps(spans: DataFrame, key: str, start: str, end: str, row: str) -> DataFrame:
    """Pairs of a key's rows whose closed intervals overlap, the smaller ``row`` first."""
    a = spans.select(F.col(key), F.col(row).alias("a"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = spans.select(F.col(key), F.col(row).alias("b"), F.col(start).alias("_t"), F.col(end).alias("_f"))
    far = F.lit("9999-12-31").cast("date")
    return a.join(b, key).where((F.col("a") < F.col("b")) & (F.col("_s") <= F.coalesce("_f", far)) & (F.col("_t") <= F.coalesce("_e", far))).select(key, "a", "b")


def linked_by_tiers(left: DataFrame, right: DataFrame, tiers: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Record linkage by ordered fallbacks: the first tier with a match decides; several matches there mean none.

    ``tiers`` are (left column, right column); blank keys match nothing. Returns every left id, its match and tier.
    """
    found = None
    for n, (a, b) in enumerate(tiers, 1):
        l = left.select(left_id, F.nullif(F.col(a), F.lit("")).alias("_key")).where("_key is not null")
        r = right.select(F.col(right_id).alias("match"), F.nullif(F.col(b), F.lit("")).alias("_key")).where("_key is not null").distinct()
        tier = l.join(r, "_key").select(left_id, "match", F.lit(n).alias("tier"))
        found = tier if found is None else found.unionByName(tier)
    first = found.groupBy(left_id).agg(F.min(F.struct("tier")).alias("t")).select(left_id, F.col("t.tier").alias("tier"))
    one = found.join(first, [left_id, "tier"]).groupBy(left_id, "tier").agg(F.count_distinct("match").alias("n"), F.min("match").alias("match")).where("n = 1")
    return left.select(left_id).distinct().join(one.select(left_id, "match", "tier"), left_id, "left")


def deletion_variants(x: Column) -> Column:
    """A string and every string with one character less: equal sets of variants propose one-keystroke pairs."""
    n = F.length(x)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, n)))
    return F.array_distinct(F.concat(F.array(x), cut))


def one_keystroke(a: Column, b: Column) -> Column:
    """Two different strings are one edit or one swap of neighbours apart."""
    d = F.levenshtein(a, b)
    chars = lambda s: F.split(s, "")
    swap = (F.length(a) == F.length(b)) & (d == 2) & (F.array_join(F.array_sort(chars(a)), "") == F.array_join(F.array_sort(chars(b)), ""))
    at = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    near = (F.size(at) == 2) & (F.get(at, F.lit(1)) - F.get(at, F.lit(0)) == 1)
    return (d == 1) | (swap & near)


def greedy_match(left: DataFrame, right: DataFrame, keys: Sequence[str], within: float) -> DataFrame:
    """The pairs of ``greedy_sides``: every left row's id, and the right row's that it takes, if any (left_id, right_id)."""
    columns = [*keys, "id", "at", "amount"]
    both = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))
    return greedy_sides(both, keys, within).where("left_id is not null").select("left_id", "right_id")


def greedy_sides(both: DataFrame, keys: Sequence[str], within: float) -> DataFrame:
    """Match rows of equal ``keys`` one to one: left in (at, id) order takes the free right row of the same sign and
    amount within a tolerance that is nearest in date, then smallest in id. A row without a date comes after the dated
    ones and lies farther from any row than they do.

    Rows have id, at (date), amount (double) and side, 0 left or 1 right; a row without an amount or a key matches none.
    Every row comes back once, alone or in its pair, so that no join has to find it again: keys, left_id, left_amount,
    right_id, right_amount.

    Rows whose amounts are a gap wider than the tolerance apart never compete, so a key falls into runs of amounts at
    such gaps, exactly, found in ranges of amounts. A task streams run after run and holds one run's rows; free rows are
    looked up by amount.
    """
    order = [*keys, "_run", F.desc("side"), F.asc_nulls_last("at"), "id"]
    dealt = runs(both.select(*keys, "id", "at", "amount", "side"), keys, "amount", within, "_run").select(*keys, "_run", "side", "id", "at", "amount").repartition(*keys, "_run").sortWithinPartitions(*order)
    sides = [StructField(f"{side}_{c}", kind) for side in ("left", "right") for c, kind in (("id", LongType()), ("amount", dealt.schema["amount"].dataType))]
    result = StructType([*(StructField(k, dealt.schema[k].dataType) for k in keys), *sides])
    arrow = to_arrow_schema(result)

    def apart_in_days(a, b) -> float:
        return float("inf") if a is None or b is None else abs((a - b).days)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free, days = None, [], {}  # free rows as (amount, id), in order; the dates by (amount, id)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def alone() -> list[tuple]:
            return [(*key[:-1], None, None, i, amount) for amount, i in free]

        for batch in batches:
            done = []
            for *own, side, i, at, amount in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key or None in own:
                    done += alone()
                    key, free, days = own, [], {}
                if side:
                    bisect.insort(free, (amount, i))
                    days[amount, i] = at
                    continue
                low, high = bisect.bisect_left(free, (amount - within,)), bisect.bisect_right(free, (amount + within, float("inf")))
                fits = [(apart_in_days(at, days[free[n]]), free[n][1], n) for n in range(low, high) if amount * free[n][0] >= 0 and abs(amount - free[n][0]) <= within]
                best = min(fits, default=None)
                taken = free.pop(best[2])[::-1] if best else (None, None)
                done.append((*own[:-1], i, amount, *taken))
            yield told(done)
        yield told(alone())

    unknown = both.where(F.col("amount").isNull())
    one_side = lambda n: F.when(F.col("side") == n, F.col("id").cast("long"))
    apart = unknown.select(*keys, one_side(0).alias("left_id"), F.col("amount").alias("left_amount"), one_side(1).alias("right_id"), F.col("amount").alias("right_amount"))
    return dealt.mapInArrow(match, result).unionByName(apart)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter side (arrays of distinct words)."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def best_match(pairs: DataFrame, left: str, right: str, score: Column, least: float) -> DataFrame:
    """Each left row's best right row of at least a score; ties go to the smallest right row."""
    ranked = pairs.withColumn("score", score).where(F.col("score") >= least)
    order = Window.partitionBy(left).orderBy(F.desc("score"), right)
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
