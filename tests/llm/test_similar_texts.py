import pytest

import corpus_pipeline
from covermap.llm.simhash import first_of_each, near_duplicates

from conftest import near, prose

SF_DIR = "/root/testdata/sf0.1"


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / (len(shingles(a) | shingles(b)) or 1)


def test_copies_beyond_three_bits_are_dropped_by_the_stage(spark):
    texts = {n: prose(1000 + n, 200) for n in range(30)}
    texts |= {100 + n: near(texts[n], n, 3) for n in range(30)}
    texts |= {200 + n: near(texts[n], n, 40) for n in range(30)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    close = {n for n in range(30) if similarity(texts[n], texts[100 + n]) >= 0.8}
    far = {row.doc_id for row in near_duplicates(frame).where("doc_id = component_id").collect()}
    assert len(close) > 20 and len(far & {100 + n for n in close}) > 10
    left = {row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, frame, SF_DIR).collect()}
    assert not left & {100 + n for n in close}
    assert left >= {n for n in texts if n < 30 or n >= 200}


def test_large_groups_with_several_clusters_are_settled(spark):
    head = prose(1, 400)
    rows = [(c * 100 + n, f"{head} {prose(10 + c, 150)} {prose(5000 + c * 100 + n, 2)}") for c in range(12) for n in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = [row.doc_id for row in first_of_each(frame, 0, similarity=0.9).collect()]
    assert sorted(left) == [c * 100 for c in range(12)]


@pytest.mark.parametrize("pair", [(1132, 7818), (5402, 6173)])
def test_known_pairs_do_not_both_stay(spark, pair):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(f"doc_id IN {pair}")
    texts = [row.text for row in documents.collect()]
    assert similarity(*texts) >= 0.8
    assert first_of_each(documents).count() == 2
    assert [row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, documents, SF_DIR).collect()] == [min(pair)]


def test_a_line_in_a_third_of_all_texts_costs_no_link_and_no_square(spark, monkeypatch):
    from covermap.llm import similar_texts
    line, made = prose(77, 60), []
    texts = {n: f"{line} {prose(3000 + n, 40)}" for n in range(400)}
    texts |= {1000 + n: near(texts[n], n, 1) for n in range(60)}
    texts |= {2000 + n: prose(9000 + n, 100) for n in range(500)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    real = similar_texts._verified
    monkeypatch.setattr(similar_texts, "_verified", lambda pairs, sets, least: made.append(pairs.count()) or real(pairs, sets, least))
    close = {(n, 1000 + n) for n in range(60) if similarity(texts[n], texts[1000 + n]) >= 0.8}
    left = {row.doc_id for row in first_of_each(frame, 0, similarity=0.8).collect()}
    lost = [pair for pair in close if set(pair) <= left]
    assert len(close) > 40 and len(lost) <= len(close) // 20
    assert sum(made) < 40 * len(texts) and len(made) < 8
    assert left >= {n for n in texts if 60 <= n < 400 or n >= 2000}


def test_recall_on_the_given_documents(spark):
    """All pairs of 0.8 or more that brute force finds end up in one group."""
    from collections import Counter, defaultdict
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id % 4 = 1 OR doc_id IN (1132, 7818, 5402, 6173)").select("doc_id", "text")
    sets = {row.doc_id: shingles(row.text or "") for row in documents.collect()}
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        for shingle in own:
            holders[shingle].append(doc_id)
    pairs = []
    for doc_id, own in sets.items():
        for other, count in Counter(o for shingle in own for o in holders[shingle] if o > doc_id).items():
            if count >= 0.8 * (len(own) + len(sets[other]) - count):
                pairs.append((doc_id, other))
    left = {row.doc_id for row in first_of_each(documents, similarity=0.8).collect()}
    lost = [pair for pair in pairs if set(pair) <= left]
    assert pairs and len(lost) <= 0.01 * len(pairs)


def test_a_family_of_texts_that_are_not_quite_near_costs_few_pairs(spark, monkeypatch):
    """Copies with other words changed are near their base and, for the most part, just not near each other."""
    from covermap.llm import similar_texts
    base, made = prose(4242, 120), []
    texts = {0: base} | {1 + n: near(base, n, 2) for n in range(500)} | {1000 + n: near(base, 7000 + n, 5) for n in range(100)}
    close = [n for n in texts if similarity(base, texts[n]) >= 0.8]
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    real = similar_texts._verified
    monkeypatch.setattr(similar_texts, "_verified", lambda pairs, sets, least: made.append(pairs.count()) or real(pairs, sets, least))
    left = {row.doc_id for row in first_of_each(frame, 0, similarity=0.8).collect()}
    assert len(close) > 450 and 0 in left and len(left & set(close)) <= len(close) // 20
    assert sum(made) < 150 * len(texts) and len(made) < 8
