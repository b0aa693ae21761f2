"""Double-array tries of phrases, walked by numpy from all positions of a text at once.

A state is a slot. Child ``w`` of state ``s`` is the slot ``base[s] + w`` if ``check`` of that slot is ``s``.
"""

from __future__ import annotations

import numpy as np

#: Positions that are tried together for the children of a state, and how often before a place past all others is taken.
WINDOW = 256
WINDOWS = 6
#: Word numbers up to this are looked up in a table, higher ones by binary search.
TABLE_WORDS = 1 << 22


class DoubleArray:
    """A trie of different phrases of equal length; ``phrases`` is [phrase, word], with word numbers from 1 on."""

    def __init__(self, phrases: np.ndarray):
        count, self.depth = phrases.shape
        self.phrases = phrases = phrases[np.lexsort(phrases.T[::-1])].astype(np.int32)
        self.alphabet = np.unique(phrases)
        own = np.searchsorted(self.alphabet, phrases) + 1
        # Nodes are numbered level by level; the edges of a node stand together, in the order of its words.
        node, nodes = np.zeros(count, dtype=np.int64), 1
        parents, words = [], []
        for level in range(self.depth):
            new = np.ones(count, dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (own[1:, level] != own[:-1, level])
            parents.append(node[new])
            words.append(own[new, level])
            node = nodes + np.cumsum(new) - 1
            nodes += int(new.sum())
        parent, word = np.concatenate([np.empty(0, np.int64), *parents]), np.concatenate([np.empty(0, np.int64), *words])
        bases, size = _placed(parent, word, nodes, len(self.alphabet) + 1)
        slots = np.zeros(nodes, dtype=np.int64)
        slots[1:] = bases[parent] + word
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.accept = np.full(size, -1, dtype=np.int32)
        self.base[slots] = bases
        self.check[slots[1:]] = slots[parent]
        self.accept[slots[node]] = np.arange(count)

    def _letters(self, words: np.ndarray) -> np.ndarray:
        """The trie's own numbers of the words; 0 for those that no phrase has."""
        if not len(self.alphabet):
            return np.zeros(len(words), dtype=np.int32)
        if self.alphabet[-1] <= TABLE_WORDS:
            table = np.zeros(self.alphabet[-1] + 2, dtype=np.int32)
            table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            return table[np.minimum(words, len(table) - 1)]
        place = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == words, place + 1, 0).astype(np.int32)

    def walk(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, phrases): where in the text a phrase begins, and its row in ``phrases``. Word 0 is in no phrase."""
        letters = np.concatenate([self._letters(words), np.zeros(self.depth, dtype=np.int32)])
        at = np.flatnonzero(letters)
        state = np.zeros(len(at), dtype=np.int32)
        for level in range(self.depth):
            slot = self.base[state] + letters[at + level]
            there = self.check[slot] == state
            at, state = at[there], slot[there]
        return at, self.accept[state]


def _placed(parent: np.ndarray, word: np.ndarray, nodes: int, letters: int) -> tuple[np.ndarray, int]:
    """The base of each node, and the size of the arrays.

    Nodes with most children are placed first, each at the next place where all its children are free; those with one
    child fill what is left. ``letters`` slots stay free at both ends, so that no look-up leaves the arrays.
    """
    bases = np.zeros(nodes, dtype=np.int64)
    counts = np.bincount(parent, minlength=nodes)
    firsts = np.searchsorted(parent, np.arange(nodes))
    used = np.zeros(2 * len(parent) + 2 * letters + WINDOW, dtype=bool)
    steps = np.arange(WINDOW)
    last, at, top = 0, letters, letters
    several = np.flatnonzero(counts > 1)
    for node in several[np.argsort(-counts[several], kind="stable")]:
        own = word[firsts[node] : firsts[node] + counts[node]]
        if counts[node] != last:
            last, at = counts[node], letters
        for _ in range(WINDOWS):
            if at + WINDOW + letters > len(used):
                used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
            taken = used[(at + own - own[0])[:, None] + steps].any(axis=0)
            if not taken.all():
                at += int(np.argmin(taken))
                break
            at += WINDOW
        else:
            at = max(at, top)
            if at + 2 * letters > len(used):
                used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
        bases[node] = at - own[0]
        used[bases[node] + own] = True
        top = max(top, int(bases[node] + own[-1]) + 1)
    single = np.flatnonzero(counts == 1)
    free = np.flatnonzero(~used[letters:])[: len(single)] + letters
    if len(free) < len(single):
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
    bases[single] = free - word[firsts[single]]
    most = max(np.flatnonzero(used).max(initial=0), free.max(initial=0))
    return bases, int(most) + letters + 1
