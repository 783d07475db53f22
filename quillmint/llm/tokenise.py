"""Word-cached token ids, for tokenizers that never merge across ASCII white space."""

from __future__ import annotations

import os

import numpy as np


class WordCoder:
    """Ids of a text's words as little-endian unsigned 32-bit bytes.

    The tokenizer's split rule keeps white space out of every piece, so a text's ids are its words' ids one after
    another. Two generations of at most ``limit`` words each are kept: when the newer is full it becomes the older,
    and words that are met again move back, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [x.split() for x in texts]
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = {w for ws in split for w in ws if w not in known}
        for w in [w for w in new if w in older]:
            known[w] = older[w]
            new.discard(w)
        if new:
            words = list(new)
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
            for w, e in zip(words, found, strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_coders: dict[tuple[str, int], WordCoder] = {}


def word_coder(path: str, limit: int = 500_000) -> WordCoder:
    """The worker process's coder for a vocabulary file; its cache serves one task after another."""
    if (path, limit) not in _coders:
        _coders[path, limit] = WordCoder(path, limit)
    return _coders[path, limit]
