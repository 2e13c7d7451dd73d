"""Sorted suffixes of concatenated token streams, and the runs that different streams share."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Values that no token has: a block's end, and what fills up a short block.
BLOCK_END, FILL = 0, 1


class TokenHashes(dict):
    """32-bit hashes of tokens, each computed once; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = max(xxhash.xxh32_intdigest(word), 2)
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in sorted order, and the length of the common prefix of each with the one before (the first: 0).

    By prefix doubling: all suffixes are sorted by their first two tokens, then those that
    tie by 4, 8, ... tokens. The ranks of each level give the common prefixes too.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64)
    key = rank * (n + 1)
    key[:-1] += rank[1:] + 1
    order = np.argsort(key)
    levels, span, at, ordered = [rank], 2, np.arange(n), key[order]
    while True:
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank = levels[-1].copy() if len(levels) > 1 else np.empty(n, np.int64)
        rank[order[at]] = at[first]  # a suffix has the rank of the first one that ties with it
        levels.append(rank)
        at = at[~(new & np.append(new[1:], True))]
        if not len(at):
            break
        places = order[at]
        after = np.where(places + span < n, rank[np.minimum(places + span, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + after
        resorted = np.argsort(key)
        order[at], ordered = places[resorted], key[resorted]
        span *= 2
    before, own, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.maximum(before, own) + common + (1 << k) <= n
        same = fits & (levels[k][np.minimum(before + common, n - 1)] == levels[k][np.minimum(own + common, n - 1)])
        common += same << k
    return order, np.concatenate([[0], common])


def _mixed(columns, size: int) -> np.ndarray:
    total = np.zeros(size, np.uint64)
    for column in columns:
        total = (total ^ column.astype(np.uint64)) * _MULTIPLIER
        total ^= total >> np.uint64(29)
    return total


def window_hashes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the ``depth`` tokens from each place on."""
    size = max(len(tokens) - depth + 1, 0)
    return _mixed((tokens[j : j + size] for j in range(depth)), size)


def shared_prefixes(streams: list[np.ndarray], depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the runs of ``depth`` tokens that at least ``least`` of the streams have.

    A stream is the token hashes of its blocks, a BLOCK_END after each; no run goes over a
    block's end. The streams are one concatenation; suffixes with a common prefix of
    ``depth`` tokens are neighbours in sorted order.
    """
    tokens = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    ids, ends = tokens.astype(np.int64), np.flatnonzero(tokens == BLOCK_END)
    ids[ends] = -1 - np.arange(len(ends))  # an end of its own for each block
    order, common = suffix_array(ids)
    first = np.flatnonzero(common < depth)
    sizes = np.diff(np.append(first, len(order)))
    until_end = np.append(ends, len(ids))[np.searchsorted(ends, order[first])] - order[first]
    chosen = np.flatnonzero((sizes >= least) & (until_end >= depth))
    first, sizes = first[chosen], sizes[chosen]
    members = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    pairs = np.unique(np.repeat(np.arange(len(first)), sizes) * max(len(streams), 1) + owner[order[members]])
    counts = np.bincount(pairs // max(len(streams), 1), minlength=len(first))
    enough = counts >= least
    at = order[first[enough]]
    return _mixed((tokens[at + j] for j in range(depth)), len(at)), counts[enough]
