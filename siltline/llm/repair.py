"""Re-Pair grammars of many token sequences at once.

Classic Re-Pair replaces the most frequent pair, one rule at a time. Here a round replaces every pair that repeats in
its sequence and is the locally most frequent (more frequent than the pairs it overlaps, ties by hash), for all
sequences of a batch in one vectorised step; rounds go on until no pair repeats. Rules still stand for pairs that
repeat, and the rounds needed grow with the logarithm of the length.
"""

from __future__ import annotations

import numpy as np

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _P[0]
    return x ^ (x >> np.uint64(29))


def grammar_sizes(symbols: np.ndarray, owner: np.ndarray, count: int, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length left, rules, rules with a marked symbol in their expansion) of each of ``count`` sequences.

    ``symbols`` holds the sequences one after the other, ``owner`` the sequence of each symbol, ascending.
    """
    sym, own = symbols.astype(np.uint64), owner.astype(np.int64)
    mark = np.zeros(len(sym), bool) if marked is None else marked.copy()
    left, rules, with_mark = (np.zeros(count, np.int64) for _ in range(3))
    with np.errstate(over="ignore"):
        while len(sym) > 1:
            inside = own[1:] == own[:-1]
            pair = mix(sym[:-1] * _P[1] + mix(sym[1:]))
            key = mix(pair ^ (own[:-1].astype(np.uint64) * _P[2]))
            border = np.flatnonzero(~inside)
            key[border] = mix(_P[0] ^ border.astype(np.uint64))  # pairs across two sequences count for neither
            order = np.argsort(key)
            ends = np.flatnonzero(np.r_[key[order[1:]] != key[order[:-1]], True])
            counts = np.diff(np.r_[-1, ends])
            often = np.empty(len(key), np.int64)
            often[order] = np.repeat(counts, counts)
            able = inside & (often > 1)
            same = inside & (sym[1:] == sym[:-1])
            if same.any():  # in a run of one symbol every other pair may be taken
                place = np.arange(len(same))
                start = np.maximum.accumulate(np.where(same & ~np.r_[False, same[:-1]], place, 0))
                able &= ~(same & ((place - start) % 2 == 1))
            rank = np.where(able, (often << 24) + (pair >> np.uint64(41)).astype(np.int64), 0)
            before, after = np.r_[0, rank[:-1]], np.r_[rank[1:], 0]
            at = np.flatnonzero(able & (rank > before) & (rank >= after))
            # a rule must be used twice after overlaps are settled
            _, first, again, uses = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
            new, at = at[first[uses > 1]], at[uses[again] > 1]
            mark[at] |= mark[at + 1]
            np.add.at(rules, own[new], 1)
            np.add.at(with_mark, own[new], mark[new])
            sym[at] = pair[at] | np.uint64(1 << 63)
            # sequences without a new rule are done and leave
            open_still = np.zeros(count, bool)
            open_still[own[new]] = True
            keep = open_still[own]
            left += np.bincount(own[~keep], minlength=count)
            keep[at + 1] = False
            sym, own, mark = sym[keep], own[keep], mark[keep]
    return left + np.bincount(own, minlength=count), rules, with_mark


def shared_phrases(symbols: np.ndarray, owner: np.ndarray, levels: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, width) of phrases that are cut alike wherever the same symbols stand.

    Pairs of a round are set by the symbols alone: a phrase ends before a symbol whose hash is a local minimum. So two
    sequences that share a stretch share the phrases inside it, which rules chosen by frequency would not give.
    """
    sym, own, width = mix(symbols.astype(np.uint64)), owner.astype(np.int64), np.ones(len(symbols), np.int64)
    with np.errstate(over="ignore"):
        for level in range(levels):
            n = len(sym)
            if n == 0:
                break
            new = np.r_[True, own[1:] != own[:-1]]
            h = mix(sym + np.uint64(level))
            low = np.zeros(n, bool)
            if n > 2:
                low[1:-1] = (h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])
            start = np.flatnonzero(new | low)
            place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
            mixed = mix(sym + (place.astype(np.uint64) + np.uint64(1)) * _P[1])
            sym = mix(np.add.reduceat(mixed, start))
            width = np.add.reduceat(width, start)
            own = own[start]
    return sym.view(np.int64), own, width
