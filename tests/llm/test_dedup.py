"""Near-dedup and substring dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillmint.llm import minhash_dedup as M
from quillmint.llm import holders
from quillmint.llm import substring_dedup as S
from quillmint.llm.components import components
from quillmint.llm.holders import shared_keys
from tests.llm.helpers import ODD, documents, frame, prose, shingles_of, words_of


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles_of(t))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def mutated(rng, words, share):
    return [rng.choice("qrst") + w if rng.random() < share else w for w in words]


def near_copies(rng):
    rows, i = [], 1000
    for share in (0.0, 0.01, 0.02, 0.03, 0.05):
        base = prose(rng, 150)
        for _ in range(8):
            rows.append((i, " ".join(mutated(rng, base, share))))
            i += 1
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = documents() + near_copies(random.Random(2)) + ODD
    got = M.near_duplicates(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    sizes = {i: len(shingles_of(t)) for i, t in rows}
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == sizes[r["doc_id"]]


def test_large_groups_fall_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_SETS", 6)
    rows = near_copies(random.Random(4))
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in M.near_duplicates(frame(spark, rows)).collect()} == want


def test_repeated_rows_and_empty_table(spark):
    rows = documents(20) * 2
    got = M.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 40 and {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    assert M.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_texts_of_one_id_are_judged_apart(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(prose(rng, 80)) for _ in range(3))
    for shift in (0, (1 << 63) - 8):
        rows = [(1, a), (5, a), (5, b), (5, None), (6, c), (6, c), (7, c + " end"), (None, a), (None, a)]
        docs = frame(spark, [(i if i is None else i + shift, t) for i, t in rows])
        got = M.one_of_each_group(docs)
        assert got.columns == docs.columns
        kept = [(r["doc_id"], r["text"]) for r in got.collect()]
        texts = [t for i, t in kept if i is not None]
        assert texts.count(a) == 1 and (5 + shift, b) in kept and (5 + shift, None) in kept and texts.count(c) + texts.count(c + " end") == 1
        assert len(kept) == 6 and kept.count((None, a)) == 2
    again = M.one_of_each_group(frame(spark, [(1, a), (5, a), (5, b)])).select("doc_id", "text").collect()
    assert (5, b) in [tuple(r) for r in again] and len(again) == 2


def test_both_extremes_are_unbiased():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 2000).astype(np.uint64) for _ in range(2))
    b[:1500] = a[:1500]
    x, y = (M.signatures(np.sort(v), np.array([0, 2000]))[0] for v in (a, b))
    half = M.PERMUTATIONS
    assert abs((x == y).mean() - 0.6) < 0.12 and abs((x[:half] == y[:half]).mean() - (x[half:] == y[half:]).mean()) < 0.25


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)]
    up = {i: i for p in links for i in p}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}


@pytest.mark.parametrize("top", [1 << 60, 15])
def test_compact_windows(top):
    rng = np.random.default_rng(5)
    for n in (3, 8, 46, 90):
        for width in (2, 5, 46):
            x = rng.integers(1, top, n).astype(np.uint64)
            want = set()
            for i in range(n):
                for j in range(i + width - 1, n):
                    left = right = c = i + int(np.argmin(x[i : j + 1]))
                    while left and x[left - 1] > x[c]:
                        left -= 1
                    while right < n - 1 and x[right + 1] >= x[c]:
                        right += 1
                    want.add((left, c, right))
            assert set(zip(*(v.tolist() for v in S.compact_windows(x, np.array([0, n]), width)), strict=True)) == want


def covered(rows, least=50):
    """Words of each document inside a run of ``least`` words that a document of a smaller id holds (lower case)."""
    out = {}
    held: dict = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = [x.lower() for x in words_of(t)]
        runs = [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
        hit = {k + d for k, r in enumerate(runs) if r in held and held[r] != i for d in range(least)}
        for r in runs:
            held.setdefault(r, i)
        out[i] = hit
    return out


def test_exact_passages_are_found_and_cut(spark):
    rng = random.Random(6)
    passage, other = prose(rng, 70, 2000), prose(rng, 55, 2000)
    rows = []
    for i in range(60):
        body = prose(rng, 120, 2000)
        if i % 3 == 0:
            body[40:40] = passage
        if i % 5 == 0:
            body += other
        rows.append((i, " ".join(body)))
    rows += [(100, rows[7][1]), (101, " ".join(passage[:49]))] + ODD + [(9020, "word " * 400)]
    found = S.repeated_passages(frame(spark, rows))
    want = covered(rows)
    got = {}
    for r in found.collect():
        assert r["first_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert set(got) == {i for i, w in want.items() if w}
    for i in got:
        assert want[i] <= got[i] and len(got[i] - want[i]) <= 12
    cut = {r["doc_id"]: r["text"] for r in S.without_repeats(frame(spark, rows), found).collect()}
    assert len(cut) == len(rows) and cut[0] == rows[0][1] and cut[100] == "" and cut[9001] is None
    assert " ".join(passage) not in cut[3] and " ".join(passage) in cut[0]


def test_near_passages_are_found(spark):
    rng = random.Random(8)
    passage = prose(rng, 120, 2000)
    rows = []
    for i in range(20):
        own = list(passage)
        own[rng.randint(30, 90)] = "changed"
        rows.append((i, " ".join(prose(rng, 60, 2000) + own + prose(rng, 60, 2000))))
    longest = {}
    for r in S.repeated_passages(frame(spark, rows)).collect():
        longest[r["doc_id"]] = max(longest.get(r["doc_id"], 0), r["end_word"] - r["start_word"])
    assert set(longest) == set(range(1, 20)) and min(longest.values()) >= 110


def spans_by_text(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return got


def test_exact_passages_after_variants_that_fail(spark):
    """Earlier documents hold a passage with words changed, under 0.75; later ones repeat each other exactly."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        passage = prose(rng, 50, 2000)
        for i in range(5):
            own = list(passage)
            if i < 3:
                own[15 + i], own[32 + i] = "changed", "varied"
            rows.append((100 * i + k, " ".join(prose(rng, 40, 2000) + own + prose(rng, 40, 2000))))
    got, want = spans_by_text(S.repeated_passages(frame(spark, rows))), covered(rows)
    assert sum(bool(w) for w in want.values()) == 12
    assert all(w <= got.get(i, set()) for i, w in want.items())


def test_near_passages_after_variants_that_fail(spark):
    """As above, but the later documents repeat each other nearly: the holder before leads where the first one fails."""
    rng = random.Random(14)
    rows = []
    for k in range(30):
        passage = prose(rng, 80, 2000)
        for i in range(5):
            own = list(passage)
            if i < 3:
                for at in (9, 23 + i, 38, 55 + i, 70):
                    own[at] = f"changed{i}"
            else:
                own[20 * i - 40] = "near"
            rows.append((100 * i + k, " ".join(prose(rng, 40, 2000) + own + prose(rng, 40, 2000))))
    got = spans_by_text(S.repeated_passages(frame(spark, rows)))
    assert sum(len(got.get(400 + k, set()) & set(range(40, 120))) >= 70 for k in range(30)) >= 27


@pytest.mark.parametrize("crowd", [32, 2])
def test_near_passages_amid_variants_that_fail(spark, monkeypatch, crowd):
    """The text repeated nearly is neither the first holder nor the one before: variants under 0.75 stand on both sides."""
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(17)
    rows, line = [], prose(rng, 12, 2000)
    for k in range(20):
        passage = prose(rng, 80, 2000)
        for i in range(8):
            own = list(passage)
            if i in (3, 7):
                own[10 * i] = "near"
            else:
                for at in (9, 23, 38, 53, 66):
                    own[at + i % 4 * 5] = f"changed{i}"
            rows.append((100 * i + k, " ".join(prose(rng, 40, 2000) + own + prose(rng, 40, 2000) + line)))
    found = S.repeated_passages(frame(spark, rows))
    got = spans_by_text(found)
    assert sum(len(got.get(700 + k, set()) & set(range(40, 120))) >= 70 for k in range(20)) >= 19
    assert all(r["first_doc_id"] % 100 == r["doc_id"] % 100 for r in found.collect())


def test_links_follow_the_rows_of_a_group(spark, monkeypatch):
    """Variants under 0.75 of one text share minima pair by pair, but only those that may share a passage are linked."""
    rng, links = random.Random(21), []
    text, rows = prose(rng, 120, 2000), []
    for i in range(40):
        own = list(text)
        for at in range(4, 120, 9):
            own[at] = f"changed{i}"
        rows.append((i, " ".join(own)))

    def counted(df, name, stage=S.stage):
        made = stage(df, name)
        links.extend([made.count()] if name == "passage-links" else [])
        return made

    monkeypatch.setattr(S, "stage", counted)
    assert S.repeated_passages(frame(spark, rows)).count() == 0
    assert sum(links) <= 4 * len(rows)


def test_prints_leave_room_for_passages():
    rng = random.Random(22)
    kept = []
    for changes in (0, 1, 6):
        for slip in (0, 3):
            passage = prose(rng, 90, 2000)
            other = list(passage)
            for k in range(changes):
                other[10 + k * 14] = "changed"
            other[45:45] = prose(rng, slip, 2000)
            texts = [" ".join(prose(rng, 30, 2000) + x + prose(rng, 30, 2000)) for x in (passage, other)]
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts), pa.array([1, 2]), pa.array([[70], [70]], pa.list_(pa.int32()))], names=["doc_id", "text", "mark", "spots"])
            prints = np.array([np.frombuffer(x, np.uint8) for b in S.print_batches(iter([batch])) for x in b.column(3).to_pylist()])
            kept.append(bool(S.room(prints[:1], prints[1:])[0][0]))
    assert kept == [True, True, True, True, False, False]


def test_places_that_may_lie_in_a_passage():
    rng = np.random.default_rng(18)
    for _ in range(300):
        size = int(rng.integers(20, 80))
        kind = rng.choice([1, 0, -3], size, p=[0.7, 0.1, 0.2])
        spots = np.unique(rng.integers(0, size, 3))
        got = S.may_lie_in(spots, np.flatnonzero(kind == 1), np.flatnonzero(kind == -3), size, 20)
        want = [any(kind[a:b].sum() >= 0 for a in range(s + 1) for b in range(max(s + 1, a + 20), size + 1)) for s in spots]
        assert got.tolist() == want


def test_hot_keys_have_the_same_holders(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(rng.randrange(60), rng.randrange(3), rng.choice([1, 1, 1, 2, 3, rng.randrange(100)])) for _ in range(600)]
    keys = spark.createDataFrame(rows, "doc_id long, place int, key long")
    sides = []
    for sample in (keys.limit(0), keys):
        found = shared_keys(keys, sample, ["key"], ["doc_id", "place"], "t").collect()
        assert all(r["before"] is None or tuple(r["before"]) <= (r["doc_id"], r["place"]) for r in found)
        sides.append(sorted((r["doc_id"], r["place"], tuple(r["first"])) for r in found))
        monkeypatch.setattr(holders, "LOT", 400)
    first = {}
    for i, p, k in sorted(rows):
        first.setdefault(k, (i, p))
    assert sides[0] == sides[1] == sorted((i, p, first[k]) for i, p, k in rows if first[k][0] != i)


def met(leader, follower):
    """Words of the follower in passages verified against the leader."""
    both = []
    for t in (leader, follower):
        value, limits = S._shingled(next(S.tk.slices(pa.array([t]))))
        both.append((value, S.windows_of(value, limits)[0]))
    found = S.passages(*both[1], S.leader_of(*both[0]))
    return {k for x, y, _, _ in found for k in range(x, y + S.SHINGLE)}


def test_leaders_with_repeated_lines():
    rng = random.Random(12)
    for k in range(20):
        line, passage, foot = prose(rng, 30, 2000), prose(rng, 30, 2000), prose(rng, 25, 2000)
        for leader, follower in (
            (line + prose(rng, 80, 2000) + line + passage, line + passage),
            (passage + line + prose(rng, 80, 2000) + line, passage + line),
            (line + foot + prose(rng, 60, 2000) + line + passage + foot, line + passage + foot),
            (line + prose(rng, 60, 2000) + line + passage, line + passage[:12] + ["changed"] + passage[13:] + prose(rng, 40, 2000)),
        ):
            exact = leader[-len(follower) :] == follower or leader[: len(follower)] == follower
            got = met(" ".join(leader), " ".join(follower))
            assert len(got) >= (len(follower) if exact else 55), k


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(13)
    one, two = prose(rng, 60, 2000), prose(rng, 60, 2000)
    long, clean = prose(rng, 90, 2000), prose(rng, 40, 2000)
    texts = {1: [one + prose(rng, 30, 2000), prose(rng, 30, 2000) + two], 2: [long + one, long + two, clean, clean]}
    rows = [(i, " ".join(t)) for i, several in texts.items() for t in several] + [(3, " ".join(prose(rng, 80, 2000)))]
    rows += [(4, rows[-1][1]), (4, " ".join(prose(rng, 70, 2000)))]
    docs = frame(spark, rows)
    cut = sorted((r["doc_id"], r["text"]) for r in S.without_repeats(docs, S.repeated_passages(docs)).collect())
    left = [r for r in rows if r[0] in (1, 3)] + [(2, " ".join(long))] * 2 + [(2, " ".join(clean))] * 2 + [(4, ""), rows[-1]]
    assert cut == sorted(left)


def test_near_dedup_keeps_rows_without_an_id(spark):
    import corpus_pipeline

    rows = [(None, "a text without an id"), (None, "a text without an id"), (1, "one two three"), (1, "one two three"), (1, "four five six")]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    assert kept == [(0, "a text without an id")] * 2 + [(1, "four five six"), (1, "one two three")]


def test_no_passages(spark):
    assert S.repeated_passages(frame(spark, documents(5)).limit(0)).count() == 0
    assert S.repeated_passages(frame(spark, [(1, "short"), (2, "short")])).count() == 0
