"""Importance resampling against its definition in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillmint.llm import resampling as R
from quillmint.llm import textkit as tk
from tests.llm.helpers import ODD, REPEATED, documents, frame

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [(1, "a text of one or two words and some"), (2, None), (3, ""), (4, "Éa éA 12 b2"), (5, "plus one-two words")]


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def hashed(text):
    w = words(text)
    return [zlib.crc32(f) % R.BUCKETS for f in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]


def brute(rows, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(hashed(x))
    for _, x in target:
        t.update(hashed(x))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + R.BUCKETS) / ((s[b] + 1) * (all_t + R.BUCKETS)))) for b in s}
    out = []
    for i, x in rows:
        f = hashed(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = percent * len(fit) // 100
    ranked = Counter()
    places = {}
    for k, r in enumerate(fit[:drawn], 1):
        places.setdefault(r, []).append(k)
    done = []
    for r in out:
        rank = places.get(r, [])
        done.append((*r, rank[ranked[r]] if ranked[r] < len(rank) else None))
        ranked[r] += 1
    return sorted(done, key=repr)


def test_resampling_matches_its_definition(spark):
    rows = documents() + documents(40) + ODD + REPEATED
    got = sorted((tuple(r) for r in R.resampled(frame(spark, rows), frame(spark, TARGET)).collect()), key=repr)
    assert got == brute(rows, TARGET)  # a text of 30,000 equal words among them


def test_other_shares_and_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 500)
    monkeypatch.setattr(R, "LOTS", 1)
    rows = documents(60)
    for percent, least in ((100, 0), (0, 0), (50, 200)):
        got = R.resampled(frame(spark, rows, extra=False), frame(spark, TARGET), percent, least, seed=11).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, TARGET, percent, least, seed=11)


def test_drawn_rows_are_the_documents(spark):
    rows = documents(80)
    docs = frame(spark, rows)
    ranks = R.resampled(docs, frame(spark, TARGET))
    drawn = {r["doc_id"] for r in ranks.collect() if r["rank"]}
    kept = R.drawn_rows(docs, ranks)
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {x for x in rows if x[0] in drawn}


def test_empty_tables(spark):
    none = frame(spark, documents(2)).limit(0)
    assert R.resampled(none, frame(spark, TARGET)).collect() == []
    rows = documents(30)
    got = R.resampled(frame(spark, rows), none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, [])


def test_registers_of_spans():
    text = b"one " + b"x" * 100 + b" \xc3\xa9t\xc3\xa9 9 " + b"y" * 48
    spans = [m.span() for m in re.finditer(rb"\S+", text)]
    start, end = np.array(spans).T
    data = np.frombuffer(text, np.uint8)
    got = ~R.crc_of_spans(data, start, end, np.full(len(start), 0xFFFFFFFF, np.uint32))
    assert got.tolist() == [zlib.crc32(text[a:b]) for a, b in spans]


def test_words_at_the_edges_of_texts():
    part = next(tk.slices(pa.array(["ab", "cd ef", "", "g"])))
    bucket, doc, count = R.features(part)
    assert count.tolist() == [1, 2, 0, 1] and sorted(zip(doc.tolist(), bucket.tolist())) == sorted((i, b) for i, t in enumerate(["ab", "cd ef", "", "g"]) for b in hashed(t))
