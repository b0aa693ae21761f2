import re

import numpy as np
import pytest
import xxhash

from covermap.llm.simhash import allocate, extract, first_of_each, group_bits, links, near_duplicates, simhashes


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(one, 42) for one in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(values, radius=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints(fixture_texts):
    found = simhashes([(text or "").encode() for text in fixture_texts])
    assert [int(one) for one in found] == [plain_simhash(text) for text in fixture_texts]


def test_against_brute_force(documents, rows_of, collected):
    values = [plain_simhash(text) for _, text, _ in rows_of]
    roots = groups(values)
    least = {}
    for root, (doc_id, _, _) in zip(roots, rows_of):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    expected = sorted(((doc_id, f"{value:016x}", least.get(root)) for (doc_id, _, _), value, root in zip(rows_of, values, roots)), key=repr)
    assert collected(near_duplicates(documents)) == expected


@pytest.mark.parametrize("partitions", [2, 3])
def test_all_links_of_a_tight_cluster_are_found(spark, partitions):
    draw = np.random.default_rng(4)
    centre = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, 3).astype(np.uint64)) for _ in range(60)]
    values = np.unique(np.array([c ^ f for c in centre for f in flips], dtype=np.uint64)).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp bigint")
    found = {(row.a, row.b) for row in links(frame, 3, partitions).collect()}
    distance = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :])
    expected = {(int(min(values[i], values[j])), int(max(values[i], values[j]))) for i, j in zip(*np.nonzero(distance <= 3)) if i != j}
    assert found == expected and expected


def test_thresholds_are_the_cheapest_that_lose_nothing():
    draw = np.random.default_rng(1)
    costs = draw.random((200, 3, 5))
    found = allocate(costs, 3)
    assert (found.sum(axis=1) == 3 - 3 + 1).all() and found.min() >= -1
    every = [(a, b, c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == 1]
    least = np.min([costs[:, 0, a + 1] + costs[:, 1, b + 1] + costs[:, 2, c + 1] for a, b, c in every], axis=0)
    rows = np.arange(200)
    assert np.allclose(sum(costs[rows, p, found[:, p] + 1] for p in range(3)), least)


def test_correlated_bits_share_a_partition():
    correlations = np.eye(64)
    pairs = [(bit, bit + 32) for bit in range(32)]
    for a, b in pairs:
        correlations[a, b] = correlations[b, a] = 0.9
    found = group_bits(correlations, 2)
    assert sorted(found[0] + found[1]) == list(range(64)) and all((a in found[0]) == (b in found[0]) for a, b in pairs)
    assert extract(np.array([0b1011], dtype=np.uint64), [0, 1, 3]).tolist() == [0b111]


def test_one_of_each_group_stays_with_its_columns(documents, rows_of):
    kept = first_of_each(documents)
    assert kept.columns == documents.columns
    ids = {row.doc_id for row in near_duplicates(documents).select("component_id").distinct().withColumnRenamed("component_id", "doc_id").collect()}
    assert {row.doc_id for row in kept.collect()} == ids


def test_empty_table(nothing):
    assert near_duplicates(nothing).collect() == [] and first_of_each(nothing).collect() == []
