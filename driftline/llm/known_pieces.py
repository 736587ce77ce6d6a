"""Token ids of the pieces of texts, each distinct piece encoded once per Python worker.

A piece is a run of bytes that the tokenizer encodes alike wherever it stands. Pieces are found again by a 64-bit hash
and compared byte by byte with the piece their ids belong to; one that differs from it is encoded by itself.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

from driftline.llm.texts import KEPT, lane_hash, lanes, spread

#: So many distinct pieces are held; then the memory starts anew.
MOST_PIECES = 300_000
_ENCODED_AT_ONCE = 5_000
_JOINED = 100


class KnownPieces:
    """``at``, ``size`` and ``ids`` of the entries; ``keys`` (sorted hashes) and ``entry`` find them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.mark: tuple[str, int] | None = None
        self.clear()

    def join_by(self, tokens: list[dict]) -> None:
        """Pieces may be encoded many to a text with a special token between them. All special tokens must begin with the same character,
        which no joined piece holds, and be cut out before anything else is done to a text, without the blanks beside them."""
        if tokens and all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and
                          t["content"][0] == tokens[0]["content"][0] for t in tokens):
            self.mark = tokens[0]["content"], tokens[0]["id"]

    @classmethod
    def of(cls, path: str):
        """One per Python worker: kept beside the tokenizers module, which outlives a task, until another operator needs the room."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault(KEPT[1], {})
        if (cls, path) not in kept:
            kept[cls, path] = cls(path)
        return kept[cls, path]

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.lane, self.lane_at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(size.sum()))

    def _encoded_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same from texts of many pieces, for which the tokenizer takes less time."""
        content, number = self.mark
        size, flat = self._encoded([content.join(texts[k:k + _JOINED]) for k in range(0, len(texts), _JOINED)])
        flat = np.insert(flat, np.cumsum(size), number)
        marks = flat == number
        return np.diff(np.flatnonzero(marks), prepend=-1) - 1, flat[~marks]

    def _learn(self, texts: list[str], lane: np.ndarray, lane_at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The new entries of ``texts``, whose bytes are ``length`` long in the lanes from ``lane_at`` on."""
        sizes, flats, places = [], [], []
        single = np.array([self.mark is None or self.mark[0][0] in t for t in texts], bool)
        for which, encode in ((np.flatnonzero(single), self._encoded), (np.flatnonzero(~single), self._encoded_joined)):
            for k in range(0, len(which), _ENCODED_AT_ONCE):
                places.append(which[k:k + _ENCODED_AT_ONCE])
                size, flat = encode([texts[i] for i in places[-1].tolist()])
                sizes.append(size)
                flats.append(flat)
        place, size, before = np.concatenate(places), np.concatenate(sizes), len(self.at)
        at = np.empty(len(texts), np.int64)
        at[place] = len(self.ids) + np.cumsum(size) - size
        size[place] = size.copy()
        count = np.maximum(-(-length // 8), 1)
        self.lane_at = np.concatenate([self.lane_at, len(self.lane) + np.cumsum(count) - count])
        self.lane = np.concatenate([self.lane, lane[spread(lane_at, count)]])
        self.length = np.concatenate([self.length, length])
        self.at = np.concatenate([self.at, at])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *flats])
        return np.arange(before, len(self.at))

    def entries(self, data: np.ndarray, read: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each piece ``data[start:end]``; pieces that ``read`` (padded) shows alike are encoded alike."""
        if not len(start):
            return np.zeros(0, np.int64)
        length = end - start
        lane, number, lane_at = lanes(read, start, end)
        key = lane_hash(lane, number, lane_at, length)
        every, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        raw = data.tobytes()

        def learn(which: np.ndarray) -> np.ndarray:
            return self._learn([raw[a:b].decode() for a, b in zip(start[which].tolist(), end[which].tolist())],
                               lane, lane_at[which], length[which])

        place = np.searchsorted(self.keys, every)
        fresh = np.ones(len(every), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(place, len(self.keys) - 1)] != every
        if fresh.any():
            if len(self.at) + fresh.sum() > MOST_PIECES and len(self.keys):
                self.clear()
                place, fresh = np.zeros(len(every), np.int64), np.ones(len(every), bool)
            made = learn(first[fresh])
            self.entry = np.insert(self.entry, place[fresh], made)
            self.keys = np.insert(self.keys, place[fresh], every[fresh])
        entry = self.entry[np.searchsorted(self.keys, every)][inverse]
        other = self.length[entry] != length
        alike = np.flatnonzero(~other)
        if len(alike):
            count = np.maximum(-(-length[alike] // 8), 1)
            unequal = lane[spread(lane_at[alike], count)] != self.lane[spread(self.lane_at[entry[alike]], count)]
            other[alike] = np.bitwise_or.reduceat(unequal, np.cumsum(count) - count)
        if other.any():
            entry[other] = learn(np.flatnonzero(other))
        return entry

    def joined(self, entry: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (text ``i`` has the pieces from ``bounds[i]`` on), ``end`` after each, and their counts."""
        size = self.size[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        count = total[bounds[1:]] - total[bounds[:-1]] + 1
        ids = np.full(int(count.sum()), end, self.dtype)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(count) - 1] = False
        ids[inner] = self.ids[spread(self.at[entry], size)]
        return ids, count
