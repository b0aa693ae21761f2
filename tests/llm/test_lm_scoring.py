import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from covermap.llm import gru, lm_scoring
from covermap.llm.common import id_remainder
from covermap.llm.gru import CLASS_WORDS, HIDDEN, Gru, Vocabulary, lanes_of, new_weights
from covermap.llm.lm_scoring import Lexicon, score_texts, scored_documents, tail_class, words_of


def model(dtype=np.float64):
    classes = np.concatenate([np.arange(128) // 64, 2 + np.arange(72) % 4])
    places = np.concatenate([np.arange(128) % 64, np.full(72, -1)])
    vocabulary = Vocabulary(classes, places, np.concatenate([np.arange(128), 128 + np.arange(72) % 4]), 6, 2, 133)
    weights = new_weights(vocabulary, np.full(6, 1 / 6), np.full((2, CLASS_WORDS), 1 / CLASS_WORDS))
    return Gru(vocabulary, {name: w.astype(dtype) for name, w in weights.items()})


def test_gradients_against_differences():
    net, draw = model(), np.random.default_rng(1)
    documents = [draw.integers(0, 200, n) for n in (30, 17, 5)]
    tokens, owner, first = lanes_of(documents, 2)
    rows, start = net._inputs(tokens, first), np.zeros((len(tokens), HIDDEN))
    there = np.flatnonzero(owner.ravel() >= 0)
    ids = tokens.ravel()[there]
    loss = lambda: -net._token_logs(net._states(rows, first, start).reshape(-1, HIDDEN)[there], ids).mean()
    keep = []
    states = net._states(rows, first, start, keep)
    gradients, total = net._gradients(rows, first, states, keep, ids, there)
    assert total / len(ids) == pytest.approx(loss(), rel=1e-5)
    for name, gradient in gradients.items():
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        net.weights[name][place] += 0.01
        above = loss()
        net.weights[name][place] -= 0.02
        assert gradient[place] == pytest.approx((above - loss()) / 0.02, rel=0.02)
        net.weights[name][place] += 0.01


def test_scores_do_not_depend_on_lanes_or_windows(monkeypatch):
    net, draw = model(), np.random.default_rng(2)
    documents = [draw.integers(0, 200, n) for n in draw.integers(1, 400, 40)]
    alone = np.array([net.log_probabilities([one])[0] for one in documents])
    assert np.allclose(net.log_probabilities(documents), alone, atol=1e-3)
    monkeypatch.setattr(gru, "WINDOW", 7)
    assert np.allclose(net.log_probabilities(documents), alone, atol=1e-3)


def test_probabilities_of_the_next_token_sum_to_one():
    net = model()
    before = np.array([3, 150, 77])
    every = net.log_probabilities([np.append(before, token) for token in range(200)]) - net.log_probabilities([before])[0]
    classes, places = net.vocabulary.classes, net.vocabulary.places
    total = np.exp(every[places >= 0]).sum() + sum(np.exp(every[np.flatnonzero((classes == c) & (places < 0))[0]]) for c in range(2, 6))
    assert total == pytest.approx(1, abs=1e-3)


def test_training_learns_what_follows_what():
    net, draw = model(np.float32), np.random.default_rng(3)
    documents = [np.cumsum(draw.integers(1, 3, 200)) % 100 for _ in range(60)]
    first = net.train(documents, 8)
    for _ in range(6):
        last = net.train(documents, 8)
    assert last < 2.5 < first  # one of two follows, of a hundred




def test_base_scores_against_their_formula(documents, rows_of, monkeypatch):
    monkeypatch.setattr(lm_scoring, "DICTIONARY", 150)
    counts = Counter()
    for doc_id, text, _ in rows_of:
        if id_remainder(doc_id, 7) != 2:
            counts.update([*words_of((text or "").encode()), None])
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(((doc_id, id_remainder(doc_id, 7) == 2, len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), total, round(sum(
        math.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*words, None]), 6)) for doc_id, text, _ in rows_of for words in [words_of((text or "").encode())]), key=repr)
    found = scored_documents(documents).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_tail_words_share_their_classes_mass():
    words = [(f"w{n}".encode(), 4000 - n) for n in range(3000)]
    tail_counts, tail_words = np.zeros(32), np.zeros(32)
    rare = {f"rare{n}".encode(): 2 for n in range(500)}
    for word, n in [*words, *rare.items()]:
        tail_counts[tail_class(word)] += n
        tail_words[tail_class(word)] += 1
    lexicon = Lexicon(words, 100, tail_counts, tail_words)
    for number in range(32):
        own = [i + 1 for i, (word, _) in enumerate(words) if tail_class(word) == number and lexicon.vocabulary.places[i + 1] < 0]
        other = lexicon.others + number
        outside = sum(10 ** lexicon.fixed[other] * (n + 1) for word, n in rare.items() if tail_class(word) == number)
        assert sum(10 ** lexicon.fixed[own]) + outside + 10 ** lexicon.fixed[other] == pytest.approx(1)


def test_the_model_beats_the_base_on_held_out_text(spark):
    """Words follow each other in a fixed way, which counts alone cannot see."""
    draw = np.random.default_rng(0)
    rows = [(n, " ".join(f"w{(start + 7 * i) % 97}" for i in range(40))) for n, start in enumerate(draw.integers(0, 97, 900))]
    held = [r for r in scored_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.held_out]
    assert len(held) > 80 and np.mean([r.score for r in held]) > 0.85 * np.mean([r.base_score for r in held])


def test_nothing_to_learn_from(spark, nothing):
    assert scored_documents(nothing).collect() == []
    rows = score_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in rows)


def test_a_training_pass_copies_little():
    """The numbers of a window are worked on step by step, so its arrays are not held several times over."""
    import tracemalloc
    draw, ids, lanes = np.random.default_rng(3), np.arange(200, dtype=np.int32), 256
    vocabulary = Vocabulary(ids // CLASS_WORDS, ids % CLASS_WORDS, ids, 4, 4, 201)
    one = Gru(vocabulary, new_weights(vocabulary, np.full(4, 1 / 4), np.full((4, CLASS_WORDS), 1 / CLASS_WORDS)))
    texts = [draw.integers(0, 200, 300).astype(np.int32) for _ in range(lanes)]
    tracemalloc.start()
    one.train(texts, lanes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 26 * lanes * gru.WINDOW * HIDDEN * 4
