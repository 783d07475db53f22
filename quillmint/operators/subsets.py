"""Which of an invoice's lines make a sum: exact counts of subset sums in cents, with lines of either sign."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MOST_WAYS = 20  # more ways than these cannot say which lines are meant
MOST_SUMS = 1 << 21  # different sums of one half of the lines that a task holds
MOST_LINES = 12  # up to so many lines an invoice, the sets of many invoices are added up side by side


class TooManySums(Exception):
    """A half of the lines has more different sums than MOST_SUMS."""


class _Half(NamedTuple):
    places: list[int]
    values: list[int]
    levels: list[np.ndarray]  # the different sums of the first k lines, in order
    counts: np.ndarray  # the ways of each sum of all lines of the half


def _half(places: list[int], values: list[int]) -> _Half:
    levels, counts = [np.zeros(1, np.int64)], np.ones(1)
    for v in values:
        both, where = np.unique(np.concatenate([levels[-1], levels[-1] + v]), return_inverse=True)
        if len(both) > MOST_SUMS:
            raise TooManySums
        counts = np.bincount(where, np.concatenate([counts, counts]), len(both))
        levels.append(both)
    return _Half(places, values, levels, counts)


def _ways_of(half: _Half, total: int, k: int) -> Iterator[list[int]]:
    """The sets of the first k lines of a half that make a sum."""
    if k == 0:
        if total == 0:
            yield []
        return
    for rest, own in ((total, []), (total - half.values[k - 1], [half.places[k - 1]])):
        at = int(np.searchsorted(half.levels[k - 1], rest))
        if at < len(half.levels[k - 1]) and half.levels[k - 1][at] == rest:
            for way in _ways_of(half, rest, k - 1):
                yield way + own


def subset_sums(values: list[int], low: float, high: float, most: int = MOST_WAYS) -> tuple[int, list[list[int]]]:
    """How many sets of places have a sum from ``low`` to ``high``, the empty set included, and the sets if at most ``most``.

    The different sums of either half meet in order, each with its number of ways, so lines of few different amounts cost
    little however many they are. A half with more than MOST_SUMS different sums raises TooManySums.
    """
    order = sorted(range(len(values)), key=lambda k: abs(values[k]))  # equal amounts side by side
    a, b = (_half(part, [values[k] for k in part]) for part in (order[::2], order[1::2]))
    sums_a, sums_b = a.levels[-1], b.levels[-1]
    first = np.searchsorted(sums_b, np.ceil(low) - sums_a, side="left")
    last = np.searchsorted(sums_b, np.floor(high) - sums_a, side="right")
    before = np.concatenate([[0.0], np.cumsum(b.counts)])
    ways = a.counts * np.maximum(before[last] - before[np.minimum(first, last)], 0)
    n = int(min(ways.sum(), 2.0**62))
    if n > most:
        return n, []
    found = []
    for i in np.flatnonzero(ways):
        for x in _ways_of(a, int(sums_a[i]), len(a.values)):
            for j in range(int(first[i]), int(last[i])):
                found += [sorted(x + y) for y in _ways_of(b, int(sums_b[j]), len(b.values))]
    return n, found


def taxed_lines_of(cents: list[int], tax: int, rate: float, plain: list[bool] | None = None) -> tuple[str, list[int], list[int]]:
    """Which lines carry a tax: outcome, the lines' places, and those places that are in doubt.

    A credit note, whose lines add up to less than nothing, is solved on the reversed sign. Of the sets whose tax fits the
    stated one up to the rounding of every line, all lines win ("all"); no tax at all is no line ("none due"). Else lines
    below zero, which lower what they stand beside, go with the others; where no set fits so, they are lines like any
    other. One set is "unique". Among several, up to MOST_WAYS, the likeliest is the one that leaves out the fewest lines
    that do not read as untaxed (``plain``), then the fewest lines, then the closest sum, then the first lines; the lines
    in which the sets differ are in doubt. No set: "none". More sets: "unsure", every line in doubt.
    """
    plain, every = plain or [False] * len(cents), list(range(len(cents)))
    if sum(cents) < 0:
        cents, tax = [-c for c in cents], -tax
    goal, slack = tax / rate, max(2, len(cents)) + int(0.5 / rate + 0.5)
    if abs(sum(cents) - goal) <= slack:
        return "all", every, []
    if abs(goal) <= slack:
        return "none due", [], []
    live = [k for k in every if cents[k]]
    try:
        for free in ([k for k in live if cents[k] > 0], live):
            fixed = [k for k in every if k not in set(free)]
            held = sum(cents[k] for k in fixed)
            n, sets = subset_sums([cents[k] for k in free], goal - slack - held, goal + slack - held)
            if n:
                break
    except TooManySums:
        return "unsure", every, every
    if not n:
        return "none", every, []
    if n > MOST_WAYS:
        return "unsure", every, every
    ways = [sorted([free[k] for k in s] + fixed) for s in sets]

    def rank(way: list[int]) -> tuple:
        left_out = [k for k in every if k not in way]
        return sum(not plain[k] for k in left_out), len(left_out), abs(sum(cents[k] for k in way) - goal), way

    best = min(ways, key=rank)
    doubt = {k for way in ways for k in set(best) ^ set(way)} | {k for k in every if k not in best and not plain[k]}
    return ("unique" if n == 1 else "several"), best, sorted(doubt)


def _one_set_each(cents: np.ndarray, goal: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Of invoices with as many lines each, a row an invoice: how many sets fit, and the first that does, as bits from the first line on.

    Sets are tried as ``taxed_lines_of`` tries them: with every line that is not above zero, else with every line of nothing.
    """
    rows, lines = cents.shape
    sums = np.zeros((rows, 1), np.int64)
    for k in range(lines):
        sums = np.concatenate([sums, sums + cents[:, k : k + 1]], axis=1)
    sets, bits = np.arange(1 << lines), 1 << np.arange(lines)

    def fitting(at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        held, kept = (cents[at] * fixed).sum(axis=1), (fixed * bits).sum(axis=1)[:, None]
        low, high = np.ceil(goal[at] - slack - held), np.floor(goal[at] + slack - held)
        rest = sums[at] - held[:, None]
        return (rest >= low[:, None]) & (rest <= high[:, None]) & (sets & kept == kept)

    fits = fitting(np.arange(rows), cents <= 0)
    n, first = fits.sum(axis=1), fits.argmax(axis=1)
    again = np.flatnonzero((n == 0) & (cents < 0).any(axis=1))
    if len(again):
        fits = fitting(again, cents[again] == 0)
        n[again], first[again] = fits.sum(axis=1), fits.argmax(axis=1)
    return n, first


def _solved_batch(batch: pa.RecordBatch, rate: float) -> pa.RecordBatch:
    """A batch's invoices (invoice_id, tax, lines), those of few lines side by side, the others and those of several sets one by one."""
    rows, lines = len(batch), batch.column("lines")
    flat, count = lines.flatten(), pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, owner = np.cumsum(count) - count, np.repeat(np.arange(rows), count)
    cents = flat.field("cents").cast(pa.int64()).to_numpy(zero_copy_only=False)
    plain = flat.field("plain").to_numpy(zero_copy_only=False).astype(bool)
    tax = batch.column("tax").cast(pa.int64()).to_numpy(zero_copy_only=False)
    whole = np.zeros(rows, np.int64)
    np.add.at(whole, owner, cents)
    sign = np.where(whole < 0, -1, 1)
    goal, slack = tax * sign / rate, np.maximum(2, count) + int(0.5 / rate + 0.5)
    is_all, is_none_due = np.abs(whole * sign - goal) <= slack, np.abs(goal) <= slack
    outcome = np.where(is_all, "all", np.where(is_none_due, "none due", "")).astype(object)
    taxed, doubt = np.repeat(~is_none_due | is_all, count), np.zeros(len(cents), bool)
    open_ = ~is_all & ~is_none_due
    singly = [np.flatnonzero(open_ & (count > MOST_LINES))]
    for n in np.unique(count[open_ & (count <= MOST_LINES)]).tolist():
        of_n = np.flatnonzero(open_ & (count == n))
        for at in np.array_split(of_n, -(-(len(of_n) << n) // MOST_SUMS)):
            places = begin[at][:, None] + np.arange(n)
            ways, first = _one_set_each(cents[places] * sign[at][:, None], goal[at], int(slack[at[0]]))
            outcome[at] = np.where(ways == 0, "none", np.where(ways == 1, "unique", "unsure"))
            inside = (ways != 1)[:, None] | (first[:, None] >> np.arange(n) & 1 == 1)
            taxed[places], doubt[places] = inside, np.where((ways == 1)[:, None], ~inside & ~plain[places], (ways > 1)[:, None])
            singly.append(at[(ways > 1) & (ways <= MOST_WAYS)])
    for i in np.concatenate(singly).tolist():
        own = slice(int(begin[i]), int(begin[i] + count[i]))
        outcome[i], some, unsure = taxed_lines_of(cents[own].tolist(), int(tax[i]), rate, plain[own].tolist())
        taxed[own], doubt[own] = np.isin(np.arange(count[i]), some), np.isin(np.arange(count[i]), unsure)

    def listed(kept: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=rows))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.field("line").cast(pa.int32()).filter(pa.array(kept)))

    return pa.RecordBatch.from_arrays([batch.column("invoice_id").cast(pa.int64()), pa.array(outcome, pa.string()), listed(taxed), listed(doubt)], names=["invoice_id", "outcome", "taxed", "doubt"])


def lines_with_tax(rows: DataFrame, rate: float) -> DataFrame:
    """invoice_id, outcome, taxed and doubtful line numbers from invoice_id, tax (cents) and lines, an array of (line, cents, plain) of one invoice."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _solved_batch(batch, rate)

    return rows.mapInArrow(solve, "invoice_id long, outcome string, taxed array<int>, doubt array<int>")
