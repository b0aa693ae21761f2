import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from covermap.llm import lexical_search as module
from covermap.llm.lexical_search import Block, search, sketch_of

from conftest import prose


def terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), term) for term in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(documents, queries, top=50):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    counted = [(doc_id, own, sum(own.values())) for doc_id, own in counted if own]
    size, words = len(counted), sum(n for *_, n in counted)
    frequency = Counter(term for _, own, _ in counted for term in own)
    result = []
    for item_id, text in queries:
        scores = []
        for doc_id, own, n in counted:
            m = 100 - 50 + (50 * n * size) // words
            score = sum(floor(1000 * log((2 * size + 2) / (2 * frequency[term] + 1))) * ((1_000_000_000 * own[term]) // (1000 * own[term] + 20 * m))
                        for term in set(terms(text)) if own[term])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        result += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return sorted(result, key=repr)


def texts():
    draw = random.Random(4)
    rows = [((n * 37) % 211, prose(n, draw.randrange(3, 90))) for n in range(200)]
    rows += [(400 + n, rows[5][1]) for n in range(70)]  # copies, more than there are places
    rows += [(None, rows[7][1]), (None, rows[7][1]), rows[9], (900, None), (901, ""), (902, " ,;"), (903, prose(3, 15_000)), (904, "ka" * 3000 + " kadan " * 400),
             (905, "Ä ä É é 🌕 nul\x00x"), (2**63 - 1, rows[11][1])]
    return rows


QUERIES = [(1, prose(5, 12)), (2, texts()[5][1]), (3, "KADAN kadan, lofel"), (4, None), (5, ""), (6, "nowhere at all"), (7, "ä é 🌕 x"), (1, prose(9, 30)), (None, prose(11, 20))]


@pytest.fixture(scope="module")
def frames(spark):
    documents = spark.createDataFrame([(*row, "q", 1, b"s") for row in texts()], "doc_id bigint, text string, term string, n int, sketch binary").repartition(3)
    return documents, spark.createDataFrame([(*row, 1, 2) for row in QUERIES], "item_id bigint, text string, query int, score int")


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"block_terms": 20}])
def test_equals_brute_force(frames, options):
    result = search(*frames, **options)
    assert result.columns == ["item_id", "rank", "doc_id", "score"] and result.schema["rank"].dataType.simpleString() == "int"
    assert sorted(map(tuple, result.collect()), key=repr) == brute(texts(), QUERIES, options.get("top", 50))


def test_many_ids_meet_in_a_join(frames, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, search(*frames).collect()), key=repr) == brute(texts(), QUERIES)


def test_bounds_are_never_below_scores():
    draw = np.random.default_rng(1)
    documents = [prose(seed, int(size)).encode() for seed, size in enumerate(draw.integers(1, 900, 60))] + [b"kadan " * 2000]
    counts = [Counter(module.alphanumeric_words(text)) for text in documents]
    frequency = Counter(term for own in counts for term in own)
    total = sum(sum(own.values()) for own in counts)
    block = Block([sorted(set(module.alphanumeric_words(prose(100 + n, 25).encode())) & set(frequency)) for n in range(20)], frequency, len(documents), total)
    sketches = [sketch_of(module._hashes(list(own)), np.array(list(own.values()))) for own in counts]
    raw = [module.compress(sketch.tobytes(), 1) for _, sketch in sketches]
    bounds = block.bounds([sum(own.values()) for own in counts], [bits for bits, _ in sketches], raw)
    scores = block.scores(documents)
    assert (bounds >= scores).all() and (bounds == scores).mean() > 0.5


def test_nothing(spark, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "kadan")], "item_id bigint, text string")
    documents = spark.createDataFrame([(1, "kadan lo")], "doc_id bigint, text string")
    assert search(nothing, some).collect() == search(documents, none).collect() == []
    assert search(documents, some).count() == 1
