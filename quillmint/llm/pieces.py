"""Operator 1: SentencePiece encoding and decoding by Unigram Viterbi over a double-array trie.

Pieces and their log scores come from a public model file. No piece has a white-space marker after another character,
so the best segmentation of a text is that of its words (a run of markers and the characters up to the next run), and
each different word of a batch is segmented once. Words are looked up together: all start positions walk the
double-array trie in step, and the Viterbi recursion runs over positions with all words side by side. A word longer
than ``SIDE_BY_SIDE`` walks alone, by the same rules. Of equal scores the segmentation with the longest last piece
wins; unused pieces are never taken, a user's own always; a character that no single piece covers costs the least score minus ten and falls back to its bytes' pieces.

Defined results: a null or empty text has no ids and decodes to an empty text; a null id keeps its row; rows repeat as
often as they come; other columns are left alone; an empty table gives an empty table. Decoding replaces byte pieces
that are no UTF-8 by U+FFFD.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
SIDE_BY_SIDE = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Field number, wire type and value of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type in id order."""
    out = []
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


class DoubleArray:
    """A trie of symbol sequences in two arrays: node s has child c where check[base[s] + c] == s."""

    def __init__(self, keys: list[tuple[int, ...]], values: list[int], symbols: int):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        used = np.zeros(size, bool)
        used[0] = True
        dense = {True: 1, False: 1}  # below these slots little is free, for lone children and for several
        todo = [(0, 0, len(keys), 0)]  # node, range of keys, depth
        for node, lo, hi, depth in todo:
            while lo < hi and len(keys[order[lo]]) == depth:
                self.value[node] = values[order[lo]]
                lo += 1
            if lo == hi:
                continue
            starts = [lo] + [i for i in range(lo + 1, hi) if keys[order[i]][depth] != keys[order[i - 1]][depth]]
            codes = np.array([keys[order[i]][depth] for i in starts])
            lone, chunk = len(codes) == 1, 2048
            slot = max(dense[lone], int(codes[0]) + 1)
            while True:
                if slot + chunk + symbols + 1 > len(used):
                    grow = max(len(used), chunk + symbols + 1)
                    used = np.concatenate([used, np.zeros(grow, bool)])
                    self.base = np.concatenate([self.base, np.zeros(grow, np.int32)])
                    self.check = np.concatenate([self.check, np.full(grow, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(grow, -1, np.int32)])
                free = slot + np.flatnonzero(~used[slot : slot + chunk])
                bases = free - codes[0]
                fits = bases if lone else bases[~used[bases[:, None] + codes].any(axis=1)]
                if len(fits):
                    base = int(fits[0])
                    break
                if slot == dense[lone]:
                    dense[lone] += chunk
                slot += chunk
            self.base[node] = base
            used[base + codes] = True
            self.check[base + codes] = node
            for i, (a, c) in enumerate(zip(starts, codes, strict=True)):
                todo.append((base + int(c), a, starts[i + 1] if i + 1 < len(starts) else hi, depth + 1))
        tail = np.full(symbols + 1, -1, np.int32)  # so that base + symbol never leaves the arrays
        self.base, self.check, self.value = np.append(self.base, np.zeros_like(tail)), np.append(self.check, tail), np.append(self.value, tail)


class Unigram:
    """Encoder and decoder of one model file's pieces."""

    def __init__(self, data: bytes, cache: int = 400_000):
        self.pieces = read_pieces(data)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        own = [i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER) and p]
        if any(MARK in self.pieces[i][0].lstrip(MARK) for i in own):
            raise ValueError("a piece has a white-space marker inside; words cannot be segmented one by one")
        letters = sorted({c for i in own for c in self.pieces[i][0]})
        self.symbol = np.zeros(0x110000 + 1, np.int32)  # 0: in no piece
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        code = dict(zip(letters, range(1, len(letters) + 1), strict=True))
        self.trie = DoubleArray([tuple(code[c] for c in self.pieces[i][0]) for i in own], own, len(letters))
        # A user's own piece scores as the best piece would for each of its characters, so that it is always taken.
        top = max((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
        self.score = np.array([top * len(p) - 0.1 if k == USER else s for p, s, k in self.pieces])
        self.longest = max(len(self.pieces[i][0]) for i in own)
        normal = [self.pieces[i][1] for i in own if self.pieces[i][2] == NORMAL]
        self.unknown_score = min(normal) - UNKNOWN_COST
        self.limit, self.known, self.older = cache, {}, {}

    def _bytes_of(self, character: str) -> list[int]:
        if not self.bytes_at:
            return [self.unknown]
        return [self.bytes_at[b] for b in character.encode("utf-8", "surrogatepass")]

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each non-empty word, all words side by side."""
        n = len(words)
        length = np.array([len(w) for w in words])
        limits = np.concatenate([[0], np.cumsum(length)])
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        symbol = self.symbol[flat]
        total, word = len(flat), np.repeat(np.arange(n), length)
        place = np.arange(total) - limits[word]
        best = np.full(total + n, -np.inf)  # score of a word's first k characters at limits[word] + word + k
        back, piece = np.zeros(total + n, np.int32), np.full(total + n, -1, np.int32)
        zero = limits[:-1] + np.arange(n)
        best[zero] = 0.0
        # Walk the trie from every position at once; keep the pieces found by (start, length).
        node, at = np.zeros(total, np.int32), np.arange(total)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.zeros(total, bool)
        for depth in range(self.longest):
            here = at[place[at] + depth < length[word[at]]]
            code = symbol[here + depth]
            step = self.trie.base[node[here]] + code
            ok = (code > 0) & (self.trie.check[step] == node[here])
            here, step = here[ok], step[ok]
            if not len(here):
                break
            node[here] = step
            ids = self.trie.value[step]
            hit = ids >= 0
            found.append((here[hit], ids[hit]))
            if depth == 0:
                single[here[hit]] = True
            at = here
        # Recursion over positions: starts in ascending order, so that of equal scores the earliest start stays.
        order = [(np.argsort(place[s], kind="stable"), s, i, d + 1) for d, (s, i) in enumerate(found)]
        cuts = [(s[o], i[o], d, np.searchsorted(place[s[o]], np.arange(int(length.max()) + 1))) for o, s, i, d in order]
        alone = np.flatnonzero(~single)
        alone = alone[np.argsort(place[alone], kind="stable")]
        alone_cut = np.searchsorted(place[alone], np.arange(int(length.max()) + 1))
        for k in range(int(length.max())):
            for s, i, d, cut in cuts:
                a, b = cut[k], cut[k + 1]
                if a < b:
                    self._relax(best, back, piece, s[a:b] + word[s[a:b]], d, self.score[i[a:b]], i[a:b])
            a, b = alone_cut[k], alone_cut[k + 1]
            if a < b:
                x = alone[a:b]
                self._relax(best, back, piece, x + word[x], 1, self.unknown_score, -1)
        out = []
        back, piece = back.tolist(), piece.tolist()
        for w in range(n):
            text, first, k, ids = words[w], int(limits[w]) + w, int(length[w]), []
            while k:
                d, i = back[first + k], piece[first + k]
                if i < 0:
                    ids.extend(reversed(self._bytes_of(text[k - 1])))
                else:
                    ids.append(i)
                k -= d
            out.append(ids[::-1])
        return out

    @staticmethod
    def _relax(best, back, piece, start, d, score, ids) -> None:
        reach = best[start] + score
        end = start + d
        better = reach > best[end]
        end = end[better]
        best[end] = reach[better]
        back[end] = d
        piece[end] = ids[better] if isinstance(ids, np.ndarray) else ids

    def segment_alone(self, word: str) -> list[int]:
        """Ids of one long word by the same recursion, position by position."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        code = self.symbol[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")].tolist()
        n = len(word)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            node, single, here = 0, False, best[s]
            for e in range(s, min(n, s + self.longest)):
                step = int(base[node]) + code[e]
                if not code[e] or check[step] != node:
                    break
                node = step
                i = int(value[node])
                if i >= 0:
                    single |= e == s
                    if here + self.score[i] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = here + self.score[i], s, i
            if not single and here + self.unknown_score > best[s + 1]:
                best[s + 1], back[s + 1], piece[s + 1] = here + self.unknown_score, s, -1
        ids, k = [], n
        while k:
            ids.extend([piece[k]] if piece[k] >= 0 else reversed(self._bytes_of(word[k - 1])))
            k = back[k]
        return ids[::-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; a non-empty text starts with a marker."""
        split = []
        for text in texts:
            if not text:
                split.append([])
                continue
            parts = (MARK + text.replace(" ", MARK)).split(MARK)
            words, pending = [], 0  # parts[0] is empty: the text starts with a marker
            for x in parts[1:]:
                pending += 1
                if x:
                    words.append(MARK * pending + x if pending > 1 else MARK + x)
                    pending = 0
            if pending:
                words.append(MARK * pending)
            split.append(words)
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = {w for ws in split for w in ws if w not in known}
        for w in [w for w in new if w in older]:
            known[w] = older[w]
            new.discard(w)
        short = [w for w in new if len(w) <= SIDE_BY_SIDE]
        for a in range(0, len(short), 20_000):
            some = short[a : a + 20_000]
            for w, ids in zip(some, self.segment(some), strict=True):
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w in new:
            if len(w) > SIDE_BY_SIDE:
                ids = self.segment_alone(w)
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def _surfaces(self) -> list[bytes]:
        if not hasattr(self, "_surface"):
            self._surface = [
                bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode("utf-8", "surrogatepass")
                for p, _, k in self.pieces
            ]
        return self._surface

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of id sequences: markers become spaces, byte pieces their bytes, and the leading space goes."""
        surface = self._surfaces().__getitem__
        out = []
        for x in ids:
            raw = b"".join(map(surface, np.frombuffer(x, "<u4").tolist()))
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


def load(spark: SparkSession, path: str) -> Broadcast:
    """The coder of a model file, built once; a worker process keeps it, and its cache, from task to task."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Unigram(f.read()))


def encode_pieces(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, binary) and n_ids of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model.value
        for batch in batches:
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                ids = coder.encode([x or "" for x in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, n_ids long")


def decode_pieces(encoded: DataFrame, model: Broadcast) -> DataFrame:
    """The rows of ``encoded`` with their decoded text added."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model.value
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                text = coder.decode([x or b"" for x in some.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(text, pa.string())], names=[*some.schema.names, "text"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(decode, f"{kept}, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number and CRC-32 of its ids, and the CRC-32 and characters of the text decoded from them."""
    import public_tokenizers

    model = load(spark, public_tokenizers.path("piece_bpe_32k.model"))
    both = decode_pieces(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model)
    text = F.col("text").cast("binary")
    return both.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("decoded_chars"), F.crc32(text).alias("decoded_crc32"))
