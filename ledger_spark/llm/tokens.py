"""Token ids of whole texts, with each distinct pre-token encoded once per worker.

The byte-level BPE splits a text into pre-tokens and merges inside each on its own, so a text's ids are its pre-tokens'
ids end to end. The split is done here on arrays of code points for texts whose letters are Latin, Greek or Cyrillic;
every other text, and one that holds a special token's string, goes through the tokenizer whole. So does every text
where the tokenizer's file names another normalizer, pre-tokenizer or model than the split stands for.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .wordhash import SEEDS, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, SPACE = range(4)
PLAIN = 0x530  # code points below it, and general punctuation, have had the same classes in every Unicode version used
CACHE = 500_000
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _classes() -> np.ndarray:
    table = np.full(0x110000, 9, np.uint8)
    for c in [*range(PLAIN), *range(0x2000, 0x2070)]:
        kind = unicodedata.category(chr(c))[0]
        table[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = SPACE
    return table


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before, model = made.get("pre_tokenizer") or {}, made["model"]
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.split = byte_level and not made.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.newline = self._whole(["\n"])[0][0] if self.split else None
        self.table = _classes()
        self._clear()

    def _clear(self):
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n + 1 offsets of the texts in them."""
        if not self.split:
            parts = self._whole(texts)
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kinds = self.table[points]
        odd = np.concatenate(([0], np.cumsum(kinds == 9)))
        plain = [bool(odd[b] == odd[a]) and not any(s in t for s in self.special) for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
        if all(plain):
            return self._plain(texts, points, kinds, offsets)
        easy = [t for t, p in zip(texts, plain) if p]
        ids, ends = self.encode(easy) if easy else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        fast = iter([ids[a:b] for a, b in zip(ends[:-1], ends[1:])])
        slow = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        parts = [next(fast) if p else next(slow) for p in plain]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)

    def _plain(self, texts, points, kinds, offsets):
        begin = self._split(points, kinds, offsets)
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(points, starts, ends, SEEDS[0])
        second = span_hashes(points, starts, ends, SEEDS[1])
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if not np.array_equal(second[first][inverse], second):
            parts = self._whole(texts)  # two pre-tokens of one hash, told apart by the second
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        slot = self._slots(unique, second[first], first, "".join(texts), starts, ends)
        size = self.size[slot][inverse]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.at[slot][inverse] - done[:-1], size) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, offsets)]

    def _split(self, points, kinds, offsets) -> np.ndarray:
        """True where a pre-token starts."""
        n = len(points)
        begin = np.zeros(n + 1, bool)
        begin[1:n] = kinds[1:] != kinds[:-1]
        begin[offsets] = True
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        # the last white-space character before other text stands alone, or leads that text if it is a blank
        last = np.flatnonzero((kinds == SPACE) & begin[1:] & ~edge[1:])
        begin[last] = True
        begin[last[points[last] == 32] + 1] = False
        quote = np.flatnonzero((points == 39) & begin[:n])
        if len(quote):
            following = np.concatenate((points, np.zeros(3, np.uint32)))
            limit = offsets[np.searchsorted(offsets, quote, "right")]
            a, b = following[quote + 1], following[quote + 2]
            short = np.isin(a, [ord(c) for c in "stmd"]) & (quote + 1 < limit)
            pair = np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                pair |= (a == ord(x)) & (b == ord(y))
            pair &= quote + 2 < limit
            for hit, width in ((short, 2), (pair, 3)):
                at = quote[hit]
                begin[at + 1] = False
                begin[at + width] = True
        return begin[:n]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, end to end, and how many each has. Those that aren't white space are encoded as
        lines of one text: a line end is a pre-token of its own there."""
        blank = np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        lines = np.array(self.tokenizer.encode_batch_fast(["".join(f"{p}\n" for p, b in zip(pieces, blank) if not b)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(lines == self.newline)
        size = np.zeros(len(pieces), np.int64)
        size[~blank] = np.diff(stops, prepend=-1) - 1
        alone = self._whole([p for p, b in zip(pieces, blank) if b])
        size[blank] = [len(x) for x in alone]
        ids = np.empty(size.sum(), np.uint32)
        of = np.repeat(blank, size)
        ids[~of] = np.delete(lines, stops)
        ids[of] = np.concatenate(alone) if alone else []
        return ids, size

    def _slots(self, keys, checks, first, text, starts, ends) -> np.ndarray:
        if len(self.key) > CACHE:
            self._clear()
        at = np.minimum(np.searchsorted(self.key, keys), max(len(self.key) - 1, 0))
        known = (self.key[at] == keys) & (self.check[at] == checks) if len(self.key) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, size = self._each([text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            key = np.concatenate((self.key, keys[new]))
            order = np.argsort(key, kind="stable")
            put = len(self.flat) + np.concatenate(([0], np.cumsum(size)[:-1]))
            self.key, self.check = key[order], np.concatenate((self.check, checks[new]))[order]
            self.at, self.size = np.concatenate((self.at, put))[order], np.concatenate((self.size, size))[order]
            self.flat = np.concatenate((self.flat, ids))
            at = np.searchsorted(self.key, keys)
            at = at + (self.check[at] != checks)  # a later entry of the same key
        return at
