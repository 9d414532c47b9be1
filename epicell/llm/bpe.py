"""Byte-pair merges of single words, from a public vocabulary file."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from epicell.llm.batch_merge import LONGEST, PairTable, merge_all

LONG_WORD = 32
NO_RANK = 1 << 40


def byte_letters() -> list[str]:
    """The letter by which vocabulary files write each byte: printable ones are themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """First ids of bytes (and of last bytes, where a word's end is marked), merges, bytes of ids, special strings.

    A pair of ids is one number in `ranks`; `merged` has the new id of each rank.
    """

    first_ids: list[int]
    last_ids: list[int]
    ranks: dict[int, int]
    merged: list[int]
    token_bytes: dict[int, bytes]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ranks, merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[ids[left] << 20 | ids[right]] = rank
            merged.append(ids[left + right])
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        token_bytes = {i: bytes(byte_of[c] for c in token.removesuffix(end)) for token, i in ids.items() if token not in special}
        token_bytes |= {i: s.encode() for s, i in special.items()}
        return Vocabulary([ids[c] for c in letters], [ids[c + end] for c in letters], ranks, merged, token_bytes, special)

    @cached_property
    def pair_table(self) -> PairTable:
        pairs = np.array(list(self.ranks), dtype=np.int64)
        ranks = np.array(list(self.ranks.values()), dtype=np.int64)
        return PairTable(pairs >> 20, pairs & ((1 << 20) - 1), ranks, np.array(self.merged, dtype=np.int64)[ranks])

    def __getstate__(self) -> dict:
        # the table is built again where it is used
        return {k: v for k, v in self.__dict__.items() if k != "pair_table"}

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, end to end, and how many each has. Words of usual length are merged together."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        long = np.flatnonzero(sizes > LONGEST).tolist()
        alone = {i: self.merge(words[i]) for i in long}
        short = words if not long else [b"" if i in alone else w for i, w in enumerate(words)]
        lengths = np.where(sizes > LONGEST, 0, sizes)
        flat = np.frombuffer(b"".join(short), dtype=np.uint8)
        symbols = np.array(self.first_ids, dtype=np.int32)[flat]
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        last = starts[1:][lengths > 0] - 1
        symbols[last] = np.array(self.last_ids, dtype=np.int32)[flat[last]]
        ids, bounds = merge_all(self.pair_table, symbols, starts)
        if not alone:
            return ids, np.diff(bounds)
        parts, at = [], 0
        counts = np.diff(bounds)
        for i in long:
            parts += [ids[at : bounds[i]], np.array(alone[i], dtype=np.int32)]
            at = bounds[i]
            counts[i] = len(alone[i])
        return np.concatenate([*parts, ids[at:]]), counts

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank is merged first, of equal ones the leftmost."""
        ids = [self.first_ids[b] for b in word]
        if ids:
            ids[-1] = self.last_ids[word[-1]]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        find, merged = self.ranks.get, self.merged
        ranks = [find(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            new = ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << 20 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = find(new << 20 | ids[i + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words whose square would hurt."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]
