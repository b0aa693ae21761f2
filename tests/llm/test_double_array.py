import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from covermap.llm.double_array import DoubleArray


def plain(phrases, text):
    rows = {tuple(phrase): row for row, phrase in enumerate(phrases.tolist())}
    depth = phrases.shape[1]
    return [(at, rows[tuple(text[at:at + depth])]) for at in range(len(text) - depth + 1) if tuple(text[at:at + depth]) in rows]


def walked(trie, text):
    at, row = trie.walk(np.array(text, dtype=np.int32))
    return list(zip(at.tolist(), row.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda depth: st.lists(st.lists(st.integers(1, 9), min_size=depth, max_size=depth), min_size=1, max_size=40)),
       st.lists(st.integers(0, 10), max_size=80))
def test_walks_find_what_a_plain_search_finds(phrases, text):
    trie = DoubleArray(np.unique(np.array(phrases), axis=0))
    assert walked(trie, text) == plain(trie.phrases, text)


@pytest.mark.parametrize("letters", [50, 3000, 6_000_000])
def test_large_tries(letters):
    draw = np.random.default_rng(letters)
    phrases = np.unique(np.minimum(draw.zipf(1.3, (20_000, 3)), letters), axis=0)
    trie = DoubleArray(phrases)
    text = np.minimum(draw.zipf(1.3, 30_000), letters + 1).tolist()
    assert walked(trie, text) == plain(trie.phrases, text)
    assert len(trie.phrases) == len(phrases)


def test_no_phrases():
    assert walked(DoubleArray(np.empty((0, 3), dtype=np.int32)), [1, 2, 3]) == []
