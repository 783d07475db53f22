"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest

from quillmint.llm import merkle as M
from tests.llm.helpers import ODD, REPEATED, documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row):
    return sha("".join(map(part, row)))


def claimed(row):
    i, text = row[0], row[4]
    if i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return leaf((*row[:4], text))


def tree(digests):
    """Root, and each leaf's list of (slot, siblings) from the leaf upward."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf_no, node in enumerate(at):
            run = digests[node // 16 * 16 : node // 16 * 16 + 16]
            paths[leaf_no].append((node % 16, [d for k, d in enumerate(run) if k != node % 16]))
        digests = [sha("".join(digests[k : k + 16])) for k in range(0, len(digests), 16)]
        at = [node // 16 for node in at]
    return digests[0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((-1 if r[0] is None else r[0], leaf(r), claimed(r)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(sources[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        subroot, paths = trees[s]
        for (i, own, other), path in zip(sorted(sources[s]), paths, strict=True):
            folded = other
            for slot, siblings in [*path, *top]:
                folded = sha("".join([*siblings[:slot], folded, *siblings[slot:]]))
            proof = "".join(d for _, x in [*path, *top] for d in x)
            out.append((None if i == -1 else i, own, subroot, root, sha(proof), folded, folded == root, proof))
    return sorted(out, key=repr)


def rows_of(n, sources):
    texts = [t for _, t in documents(50)]
    return [(i * 3, sources(i), "en" if i % 7 else None, i if i % 5 else None, texts[i % 50]) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, idx int"


def made(spark, rows, keep=True):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in M.manifest(M.document_leaves(docs, M.tampered(docs)), keep).collect()), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(600, lambda i: None if i % 3 == 0 else "é" if i % 11 == 0 else f"s{i % 40}" if i % 2 else "hot"),
        rows_of(300, lambda i: "only"),
        rows_of(1, lambda i: None),
        rows_of(40, lambda i: f"each{i}"),
        [(i, "a", "en", 1, t) for i, t in ODD + REPEATED + REPEATED + [(None, "A null id"), (0, "A zero"), (5, "")]],
    ],
    ids=["skewed", "one-source", "one-row", "lone-leaves", "odd"],
)
def test_manifest_matches_its_definition(spark, rows):
    assert made(spark, rows) == brute(rows)


def test_proofs_are_left_out(spark):
    rows = rows_of(20, lambda i: "s")
    assert made(spark, rows, keep=False) == [r[:-1] for r in brute(rows)]


def test_empty_table(spark):
    assert made(spark, []) == []


def test_a_run_that_lacks_children_is_told():
    with pytest.raises(ValueError, match="lacks"):
        M._completed((("s", 0), [(0, 3, b"", ()), (2, 3, b"", ())]))
