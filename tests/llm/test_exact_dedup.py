"""Exact duplicates against grouping by whole texts."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from quillmint.llm import exact_dedup as E
from tests.llm.helpers import ODD, REPEATED, documents, frame, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = [i == keep for i in ids]
        first = kept.index(True)
        out += [(i, keep, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def copies():
    rng = random.Random(5)
    long = " ".join(prose(rng, 9000))
    changed = long[:40_000] + "#" + long[40_001:]
    moved = long[20_000:] + long[:20_000]
    rows = [(i, t) for i, t in enumerate([long, long.upper(), long, changed, changed, moved, long + " ", "É" * 500, "é" * 500, "É" * 500, "A" * 30_000, "a" * 30_000, "", None, "Ab", "aB"], 20_000)]
    return rows + [(None, "aB"), (None, "only nulls here"), (None, "ONLY nulls here"), (20_100, "twice"), (20_100, "TWICE")]


def test_groups_match_brute_force(spark):
    rows = documents() + documents(30) + ODD + REPEATED + copies()
    got = [tuple(r) for r in E.exact_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_full_filter_and_hot_groups(spark, monkeypatch):
    rows = [(i, "the very same text of a few words") for i in range(500)] + copies()
    for hot, short in ((2, 4096), (2, 0), (10**9, 4096)):
        monkeypatch.setattr(E, "HOT_GROUPS", hot)
        monkeypatch.setattr(E, "SHORT_RECIPE", short)
        got = [tuple(r) for r in E.exact_duplicates(frame(spark, rows), filter_bits=64).collect()]
        assert sorted(got, key=repr) == brute(rows)


def test_marks_that_two_chunks_share_are_drawn_again(spark, monkeypatch):
    source = E.recipe_batches, E.shared_chunk_batches
    seen = []

    def narrow(key, *rest, which):
        """Under the first key all chunks of a length have one mark."""
        seen.append(key)
        made = source[which](key, *rest)

        def run(batches):
            if key == 0:
                E.mark_of = lambda chunk, _: len(chunk).to_bytes(16, "little")
            else:
                E.mark_of = lambda chunk, k: hashlib.blake2b(chunk, digest_size=16, key=k.to_bytes(8, "little")).digest()
            yield from made(batches)

        return run

    monkeypatch.setattr(E, "recipe_batches", lambda *a: narrow(*a, which=0))
    monkeypatch.setattr(E, "shared_chunk_batches", lambda *a: narrow(*a, which=1))
    rows = [(1, "aaaa"), (2, "bbbb"), (3, "AAAA"), (4, "cc")]
    assert sorted((tuple(r) for r in E.exact_duplicates(frame(spark, rows)).collect()), key=repr) == brute(rows)
    assert 1 in seen and 2 not in seen


def test_empty_table(spark):
    assert E.exact_duplicates(frame(spark, documents(3)).limit(0)).collect() == []


@pytest.mark.parametrize("text", [b"", b"x", b"x" * 100_000, bytes(range(97, 123)) * 900, b" ".join(str(i).encode() for i in range(9000))])
def test_chunks_make_up_the_text(text):
    data = np.frombuffer(text, np.uint8)
    ends = E.chunk_ends(E.cut_places(data), 0, len(text))
    sizes = [b - a for a, b in itertools.pairwise([0, *ends])]
    assert sum(sizes) == len(text) and all(0 < n <= E.MOST_CHUNK for n in sizes) and all(n >= E.LEAST_CHUNK for n in sizes[:-1])


def test_cuts_follow_the_content():
    """Text before a place moves no later cut once the cuts meet again."""
    rng = random.Random(3)
    tail = " ".join(prose(rng, 4000)).encode()

    def cuts(text):
        data = np.frombuffer(text, np.uint8)
        return {len(text) - e for e in E.chunk_ends(E.cut_places(data), 0, len(text))}

    a, b = cuts(tail), cuts(b"some words before it " * 7 + tail)
    assert len(a & b) > 0.8 * len(a)
