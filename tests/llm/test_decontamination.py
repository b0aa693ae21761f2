import numpy as np
import pytest
from pyspark.sql import functions as F

from covermap.llm import decontamination
from covermap.llm.decontamination import benchmark_leaks, common_subsequence, plain_words, randomised_svd, without_leaks

from conftest import near, prose  # noqa: E402


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(item, prose(1000 + item, 15 + 7 * item)) for item in range(8)] + [(20, None), (21, ""), (22, "kafel ?"), (24, "Lofel kadan, mihin negor pukul!"), (23, prose(77, 200))]
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "0 AS cosine")


@pytest.fixture(scope="module")
def leaky(spark, benchmark):
    items = {row.item_id: row.text for row in benchmark.collect()}
    rows = [(100 + item, prose(item, 90) + "\n" + items[item].upper() + "! " + prose(item + 50, 70)) for item in range(8)]
    rows += [(200 + item, prose(item, 30) + " " + near(items[item], item, 1 + item // 2) + " " + prose(item + 5, 40)) for item in range(8)]
    rows += [(300, prose(6, 3000) + " " + items[3] + " " + prose(9, 3000)), (301, items[23]), (302, items[23] + " " + items[5])]
    rows += [(303, prose(4, 50) + " lofel kadan mihin negor pukul " + prose(5, 50)), (304, prose(4, 50) + " lofel kadan mihin x negor pukul " + prose(5, 50))]
    rows += [(400 + n, prose(3000 + n, 150)) for n in range(30)] + [(500, None), (501, ""), (None, items[2]), (502, items[4]), (502, items[4])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "2 AS item_id").repartition(3)


def test_passages_are_found_and_clean_documents_left_alone(leaky, benchmark):
    found = sorted(((row.doc_id, row.item_id) for row in benchmark_leaks(leaky, benchmark).collect()), key=repr)
    expected = [(100 + item, item) for item in range(8)] + [(200 + item, item) for item in range(8)]
    expected += [(300, 3), (301, 23), (302, 23), (302, 5), (303, 24), (None, 2), (502, 4), (502, 4)]
    assert found == sorted(expected, key=repr)


def test_blocks_of_items_give_the_same(leaky, benchmark, monkeypatch):
    whole = sorted((str((r.doc_id, r.item_id)) for r in benchmark_leaks(leaky, benchmark).collect()))
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 3)
    assert sorted((str((r.doc_id, r.item_id)) for r in benchmark_leaks(leaky, benchmark).collect())) == whole
    monkeypatch.setattr(decontamination, "BLOCKS_PER_PASS", 2)
    assert sorted((str((r.doc_id, r.item_id)) for r in benchmark_leaks(leaky, benchmark).collect())) == whole


def test_clean_rows_keep_their_columns(leaky, benchmark):
    clean = without_leaks(leaky, benchmark)
    assert clean.columns == leaky.columns
    assert sorted(row.doc_id for row in clean.collect()) == sorted([304] + [400 + n for n in range(30)] + [500, 501])


def test_recall_of_the_search_against_brute_force(spark, benchmark):
    """Every passage whose exact cosine reaches the bound is a candidate."""
    (pieces,) = decontamination._index(spark.createDataFrame([(prose(s, 200),) for s in range(20)], "text string"),
                                       [decontamination.pieces_of([(r.item_id, (r.text or "").encode()) for r in benchmark.collect()])])
    vocabulary, other = pieces.vocabulary, len(pieces.vocabulary)
    weights = np.zeros((len(pieces.words), other))
    for number, words in enumerate(pieces.words):
        for word in words:
            weights[number, vocabulary[word]] += pieces.idf[vocabulary[word]]
    weights /= np.linalg.norm(weights, axis=1)[:, None]
    words = plain_words((prose(2, 60) + " " + prose(1004, 43) + " " + prose(8, 100)).encode())
    exact = set()
    for start in range(0, len(words) - 32 + 16, 16):
        counts = np.zeros(other)
        outside = 0.0
        for word in words[start:start + 32]:
            if word in vocabulary:
                counts[vocabulary[word]] += pieces.idf[vocabulary[word]]
            else:
                outside += pieces.idf[-1] ** 2
        cosines = weights @ counts / np.sqrt((counts**2).sum() + outside)
        exact |= {(start, int(piece)) for piece in np.flatnonzero(cosines >= 0.36)}
    found = {(start, piece) for start, piece, _ in decontamination._candidates(words, pieces, 0.35)}
    assert exact and exact <= found


def test_svd_spans_the_rows(spark):
    draw = np.random.default_rng(0)
    dense = draw.normal(size=(40, 6)) @ draw.normal(size=(6, 30))
    frame = spark.createDataFrame([(list(range(30)), row.tolist()) for row in dense], "words array<int>, weights array<double>").repartition(3)
    vectors = randomised_svd(frame, 30, 6)
    assert np.allclose(dense @ vectors @ vectors.T, dense, atol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-8)


@pytest.mark.parametrize("a, b", [("a b c d", "x a y c d"), ("a a a", "a b a"), ("q", ""), ("a b a b", "b a b a"), (" ".join("abcdefgh" * 9), " ".join("hgfedcba" * 9))])
def test_common_subsequence(a, b):
    a, b = a.split(), b.split()
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_subsequence(a, b) == table[-1][-1]


def test_empty_tables(spark, leaky, benchmark, nothing):
    assert benchmark_leaks(nothing, benchmark).collect() == [] and without_leaks(nothing, benchmark).collect() == []
    none = benchmark.where(F.lit(False))
    assert benchmark_leaks(leaky, none).collect() == [] and without_leaks(leaky, none).count() == leaky.count()


def test_short_items_are_found_where_they_stand(spark):
    items = [(1, "Who wrote it?"), (2, "two words"), (3, "kadan lofel kadan mihin"), (4, "one"), (3, "an other of that id here")]
    rows = [(10, prose(1, 400) + " who, wrote it " + prose(2, 500)), (11, "who wrote it"), (12, "who wrote x it"), (13, "it who wrote"), (14, "xwho wrote it"),
            (15, "two words one"), (16, "kadan lofel kadan lofel kadan mihin"), (17, "Kadan-lofel kadan"), (18, "an other of that id here; kadan lofel kadan mihin"), (19, "wrote it")]
    found = benchmark_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in found) == [(10, 1, 400), (11, 1, 0), (16, 3, 2), (18, 3, 0)]
    assert {(r.cosine, r.common_share, r.answer_share) for r in found} == {(1.0, 1.0, 1.0)}


def test_scripts_without_spaces(spark):
    """Questions of ideographs and of Thai are found inside running text, as they are and with a changed character."""
    draw = np.random.default_rng(9)
    said = lambda low, high, n: "".join(chr(c) for c in draw.integers(low, high, n))
    chinese, thai, short = said(0x4E00, 0x5E00, 24) + "\uff1f", said(0x0E01, 0x0E2E, 40), said(0x4E00, 0x5E00, 5)
    changed = chinese[:10] + "\u9f8d" + chinese[11:]
    around = lambda text, low, high: said(low, high, 200) + text + said(low, high, 90)
    rows = [(1, around(chinese, 0x4E00, 0x5E00)), (2, around(changed, 0x4E00, 0x5E00)), (3, around(thai, 0x0E01, 0x0E2E)), (4, around(short, 0x4E00, 0x5E00)),
            (5, around("\u3002", 0x4E00, 0x5E00)), (6, around("", 0x0E01, 0x0E2E)), (7, prose(1, 200)), (8, "\u00e9t\u00e9 \ud55c\uad6d\uc5b4 " * 20)]
    benchmark = spark.createDataFrame([(1, chinese), (2, thai), (3, short)], "item_id bigint, text string")
    found = benchmark_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert plain_words("\u00c9t\u00e9,\ud55c\uad6d \u4f60\u597d\u3002ok".encode()) == ["\u00c9t\u00e9".encode(), "\ud55c\uad6d".encode(), "\u4f60".encode(), "\u597d".encode(), b"ok"]


def test_recall_over_more_pieces_than_dimensions(spark):
    """Each of 700 pieces, as it is and with changed words, is found in its documents, and only there."""
    draw = np.random.default_rng(3)
    said = lambda words: " ".join(f"w{n}" for n in draw.integers(0, 4000, words))
    items = [said(64 * (2 if n < 100 else 1) - 24) for n in range(600)]
    rows = [(n, said(50) + " " + text + " " + said(50)) for n, text in enumerate(items)]
    rows += [(1000 + n, said(50) + " " + " ".join("changed" if place % 8 == 3 else word for place, word in enumerate(text.split())) + " " + said(50))
             for n, text in enumerate(items)]
    found = {(row.doc_id, row.item_id) for row in benchmark_leaks(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    assert found == {(n, n) for n in range(600)} | {(1000 + n, n) for n in range(600)}
