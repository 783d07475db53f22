"""Which printed amounts are an invoice's subtotal, total, charge and taxes: the readings that add up, by best-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Fixed values, in thousandths: what totals that add up with taxes count, and each of their taxes; without any tax printed;
# a total equal to the subtotal though taxes are read; a subtotal that is the lines' sum; a tax at its rate. Cents that
# sums may be off.
ADDS_UP, EACH_TAX, ADDS_UP_UNTAXED, SAME_AS_SUBTOTAL, LINES_SUM, AT_RATE, OFF = 3000, 500, 2500, -1000, 1000, 300, 1
MOST_STEPS = 200_000
MOST_CHOICES = 4096  # up to so many choices an invoice, all are scored side by side for many invoices


class Read(NamedTuple):
    """A reading: its value in cents, its score in thousandths, and where it is printed."""

    value: int
    score: int
    place: int


class Solved(NamedTuple):
    outcome: str  # adds up, likeliest, nothing read, unsolved
    score: int
    chosen: tuple[int | None, ...]  # of each field the reading's number
    steps: int


def at_rate(value: int, rate: int, subtotal: int, charge: int) -> bool:
    """Whether a tax is its rate (in hundred-thousandths) of the subtotal, with or without the charge, up to two cents or a hundredth of it."""
    room = max(200_000, 1000 * abs(value))
    return any(abs(100_000 * value - rate * base) <= room for base in (subtotal, subtotal + charge))


class _Search:
    def __init__(self, fields: list[list[Read]], rates: list[int], lines_sum: int | None):
        self.fields, self.rates, self.lines_sum = fields, rates, lines_sum
        self.taxed = any(fields[3:])
        self.most = [0] * (len(fields) + 1)  # what the fields from one on can add by their scores
        for k in reversed(range(len(fields))):
            best = max((r.score + (AT_RATE if k > 2 else 0) for r in fields[k]), default=0)
            self.most[k] = self.most[k + 1] + max(best, 0)
        values = [[r.value for r in f] + [0] for f in fields]
        self.low, self.high = [0] * (len(fields) + 1), [0] * (len(fields) + 1)
        for k in reversed(range(3, len(fields))):
            self.low[k], self.high[k] = self.low[k + 1] + min(values[k]), self.high[k + 1] + max(values[k])

    def reads(self, chosen: tuple[int, ...]) -> list[Read | None]:
        return [f[n] if n < len(f) else None for f, n in zip(self.fields, chosen, strict=False)]

    def allowed(self, reads: list[Read | None]) -> bool:
        """A printed amount is not both subtotal and total, nor two taxes."""
        if len(reads) > 1 and reads[0] and reads[1] and reads[0].place == reads[1].place:
            return False
        places = [r.place for r in reads[3:] if r]
        return len(set(places)) == len(places)

    def score(self, reads: list[Read | None]) -> tuple[int, bool]:
        """The score of a whole choice, and whether it adds up."""
        sub, total, charge, *taxes = reads
        extra, present = charge.value if charge else 0, [t for t in taxes if t]
        score, sure = sum(r.score for r in reads if r), False
        if sub and total:
            if abs(sub.value + extra + sum(t.value for t in present) - total.value) <= OFF:
                sure = bool(present) or not self.taxed
                score += ADDS_UP + EACH_TAX * len(present) if present else ADDS_UP_UNTAXED if not self.taxed else 0
            elif present and abs(sub.value - total.value) <= OFF:
                score += SAME_AS_SUBTOTAL
        if sub and self.lines_sum is not None and abs(sub.value - self.lines_sum) <= OFF:
            score += LINES_SUM
        if sub and sub.value:
            score += sum(AT_RATE for t, rate in zip(taxes, self.rates, strict=True) if t and at_rate(t.value, rate, sub.value, extra))
        return score, sure

    def bound(self, reads: list[Read | None]) -> int:
        """No whole choice that begins so scores more."""
        n = len(reads)
        most = sum(r.score for r in reads if r) + self.most[n] + AT_RATE * sum(1 for r in reads[3:] if r)
        if n < 2 or reads[0] and reads[1]:
            reach = True
            if n > 2:
                open_ = reads[1].value - reads[0].value - sum(r.value for r in reads[2:] if r)
                reach = self.low[n] - OFF <= open_ <= self.high[n] + OFF
            if reach:
                most += ADDS_UP + EACH_TAX * (sum(1 for r in reads[3:] if r) + sum(1 for f in self.fields[max(n, 3) :] if f))
        return most + (LINES_SUM if n == 0 or reads[0] and self.lines_sum is not None else 0)


def solve_totals(fields: list[list[Read]], rates: list[int], lines_sum: int | None, most_steps: int = MOST_STEPS) -> Solved:
    """The choice of at most one reading a field with the greatest score; of several the first in the order of readings, none last.

    ``fields`` are the readings of subtotal, total and charge, then of each tax, whose ``rates`` are hundred-thousandths.
    Beginnings of choices wait in the order of what they can still score, so most are never completed; after
    ``most_steps`` of them the outcome is "unsolved" and nothing is chosen.
    """
    if not any(fields):
        return Solved("nothing read", 0, (None,) * len(fields), 0)
    search = _Search(fields, rates, lines_sum)
    heap: list[tuple[int, tuple[int, ...]]] = [(-search.bound([]), ())]
    for step in range(1, most_steps + 1):
        most, chosen = heapq.heappop(heap)
        if len(chosen) == len(fields):
            _, sure = search.score(search.reads(chosen))
            return Solved("adds up" if sure else "likeliest", -most, tuple(n if n < len(f) else None for n, f in zip(chosen, fields, strict=True)), step)
        for n in range(len(fields[len(chosen)]) + 1):
            longer = (*chosen, n)
            reads = search.reads(longer)
            if search.allowed(reads):
                whole = len(longer) == len(fields)
                heapq.heappush(heap, (-(search.score(reads)[0] if whole else search.bound(reads)), longer))
    return Solved("unsolved", 0, (None,) * len(fields), most_steps)


def _every_choice(values: np.ndarray, scores: np.ndarray, places: np.ndarray, own: np.ndarray, rates: list[int], lines_sum: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of invoices with a reading: the best choice's score, whether it adds up, and the readings' numbers (-1: none), as ``solve_totals`` gives them.

    ``own`` has an invoice's numbers of readings by field; ``values``, ``scores`` and ``places`` have a row an invoice and, field
    by field, as many columns as its readings are at most. Choices are tried in the order of readings, none last, and only a
    greater score takes the place of an earlier one.
    """
    sizes = own.max(axis=0).tolist()
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    rows, taxed = len(values), own[:, 3:].any(axis=1)
    there = {(k, n): own[:, k] > n for k in range(len(sizes)) for n in range(sizes[k])}
    best, best_sure, best_at = np.full(rows, np.iinfo(np.int64).min), np.zeros(rows, bool), np.zeros(rows, np.int64)
    subs = range(sizes[0])
    from_lines = {n: known & (np.abs(values[:, n] - lines_sum) <= OFF) for n in subs}
    charges = [*range(sizes[2]), sizes[2]]
    zero = np.zeros(rows, np.int64)
    extra = {c: values[:, first[2] + c] if c < sizes[2] else zero for c in charges}
    rated = {}
    for k, rate in enumerate(rates, 3):
        for t in range(sizes[k]):
            tax = values[:, first[k] + t]
            room = np.maximum(200_000, 1000 * np.abs(tax))
            for n in subs:
                alone = np.abs(100_000 * tax - rate * values[:, n]) <= room
                for c in charges:
                    near = alone if c == sizes[2] else alone | (np.abs(100_000 * tax - rate * (values[:, n] + extra[c])) <= room)
                    rated[k, t, n, c] = near & (values[:, n] != 0)
    for at, choice in enumerate(product(*(range(n + 1) for n in sizes))):
        has = [c < n for c, n in zip(choice, sizes, strict=True)]
        cols = [int(first[k] + choice[k]) for k in range(len(sizes)) if has[k]]
        taxes = [(k, int(first[k] + choice[k])) for k in range(3, len(sizes)) if has[k]]
        score, sure = scores[:, cols].sum(axis=1) if cols else zero.copy(), np.zeros(rows, bool)
        paid = sum((values[:, c] for _, c in taxes), extra[choice[2]])
        sub = values[:, choice[0]] if has[0] else None
        if has[0] and has[1]:
            total = values[:, first[1] + choice[1]]
            fits = np.abs(sub + paid - total) <= OFF
            if taxes:
                score = score + np.where(fits, ADDS_UP + EACH_TAX * len(taxes), np.where(np.abs(sub - total) <= OFF, SAME_AS_SUBTOTAL, 0))
                sure = fits
            else:
                sure = fits & ~taxed
                score = score + ADDS_UP_UNTAXED * sure
        if has[0]:
            score = score + LINES_SUM * from_lines[choice[0]]
            for k, _ in taxes:
                score = score + AT_RATE * rated[k, choice[k], choice[0], choice[2]]
        better = score > best
        for k in np.flatnonzero(has):
            better &= there[k, choice[k]]
        if has[0] and has[1]:
            better &= places[:, choice[0]] != places[:, first[1] + choice[1]]
        for n, (_, c) in enumerate(taxes):
            for _, other in taxes[:n]:
                better &= places[:, c] != places[:, other]
        best, best_sure, best_at = np.where(better, score, best), np.where(better, sure, best_sure), np.where(better, at, best_at)
    return best, best_sure, np.where((picks := np.stack(np.unravel_index(best_at, [n + 1 for n in sizes]), axis=1)) < sizes, picks, -1)


def _solved_batch(batch: pa.RecordBatch, names: list[str], rates: list[int], most_steps: int) -> pa.RecordBatch:
    """A batch's invoices (invoice_id, lines_sum, reads) solved: those of few choices side by side, the others one by one."""
    rows, reads = len(batch), batch.column("reads")
    lengths = pc.fill_null(pc.list_value_length(reads), 0).to_numpy(zero_copy_only=False)
    flat = reads.flatten()
    owner = np.repeat(np.arange(rows), lengths)
    field = pc.fill_null(pc.index_in(flat.field("field"), value_set=pa.array(names)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.flatnonzero(field >= 0)
    own = own[np.lexsort((own, field[own], owner[own]))]  # by invoice and field, in the order of readings
    numbers = np.column_stack([flat.field(c).cast(pa.int64()).to_numpy(zero_copy_only=False)[own] for c in Read._fields]).astype(np.int64)
    sizes = np.zeros((rows, len(names)), np.int64)
    np.add.at(sizes, (owner[own], field[own]), 1)
    known = batch.column("lines_sum").is_valid().to_numpy(zero_copy_only=False)
    lines_sum = pc.fill_null(batch.column("lines_sum").cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    outcome, score = np.full(rows, "nothing read", object), np.zeros(rows, np.int64)
    chosen = np.full((rows, len(names)), -1, np.int64)  # places in ``numbers``
    field_begin = np.cumsum(sizes.reshape(-1)).reshape(sizes.shape) - sizes
    numbers = np.vstack([numbers, np.zeros((1, 3), np.int64)])
    fit = max(np.abs(numbers).max(), np.abs(lines_sum).max(initial=0)) < 1 << 40  # products fit 64 bits
    most_choices = min(MOST_CHOICES, most_steps // (len(names) + 1)) if fit else 0
    some = sizes.any(axis=1)
    few = some & ((sizes + 1.0).prod(axis=1) <= most_choices)
    # All together, where their greatest numbers of readings still make few choices; else those of one shape together.
    together = (sizes[few].max(axis=0, initial=0) + 1.0).prod() <= most_choices
    shape_of = np.zeros(rows, np.int64) if together else np.unique(sizes, axis=0, return_inverse=True)[1].reshape(-1)
    for shape in np.unique(shape_of[few]):
        at = np.flatnonzero(few & (shape_of == shape))
        columns = [np.where(n < sizes[at, k], field_begin[at, k] + n, len(numbers) - 1) for k, most in enumerate(sizes[at].max(axis=0)) for n in range(most)]
        part = numbers[np.stack(columns)]
        score[at], sure, picks = _every_choice(*(np.asfortranarray(part[:, :, c].T) for c in range(3)), sizes[at], rates, lines_sum[at], known[at])
        outcome[at] = np.where(sure, "adds up", "likeliest")
        chosen[at] = np.where(picks >= 0, field_begin[at] + picks, -1)
    for i in np.flatnonzero(some & ~few):
        mine = [[Read(*map(int, numbers[field_begin[i, k] + n])) for n in range(sizes[i, k])] for k in range(len(names))]
        found = solve_totals(mine, rates, int(lines_sum[i]) if known[i] else None, most_steps)
        outcome[i], score[i] = found.outcome, found.score
        chosen[i] = [-1 if n is None else field_begin[i, k] + n for k, n in enumerate(found.chosen)]
    values = numbers[:, 0][chosen]
    picked = [pa.array(values[:, k], mask=chosen[:, k] < 0) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([batch.column("invoice_id").cast(pa.int64()), pa.array(outcome, pa.string()), pa.array(score), *picked], names=["invoice_id", "outcome", "score", *names])


def totals_of(rows: DataFrame, taxes: Mapping[str, int], most_steps: int = MOST_STEPS) -> DataFrame:
    """invoice_id, outcome, score and the chosen value of each field (cents).

    ``rows`` has invoice_id, lines_sum (cents or null) and reads, an array of (field, value, score, place) whose order is
    the readings'; ``taxes`` are the tax fields with their rates. Readings of other fields are left out.
    """
    names = ["subtotal", "total", "charge", *taxes]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _solved_batch(batch, names, list(taxes.values()), most_steps)

    return rows.mapInArrow(solve, f"invoice_id long, outcome string, score long, {', '.join(f'{n} long' for n in names)}")
