import random

import numpy as np
import pytest

from covermap.llm.common import id_remainder
from covermap.llm.toxicity import FEATURES, LEXICON, features, toxic_scores, without_toxic

from conftest import prose

_FIXED = frozenset(word.encode() for word in LEXICON)


def described(text, learnt=()):
    return dict(zip(FEATURES, features(text.encode(), _FIXED, frozenset(word.encode() for word in learnt))))


def test_features():
    clean, toxic = described("The river runs slowly past you."), described("You IDIOT!! you are a M0r0n, truly st*upid.")
    assert clean["fixed_density"] == 0 and clean["near_second_person"] == 0 and clean["second_person_rate"] > 0
    assert toxic["fixed_density"] == 1 / 9 and toxic["near_second_person"] == 1 and toxic["disguised_hits"] > 0
    assert toxic["capital_rate"] > clean["capital_rate"] and toxic["exclamation_rate"] > 0
    assert described("a zork b", ["zork"])["learnt_density"] == 1 / 3
    assert set(described("").values()) == {0.0} and set(described("...").values()) == {0.0}
    assert all(np.isfinite(list(described(text).values())).all() for text in ("x", "idiot", "é" * 9, "!" * 5000, "\x00"))


@pytest.fixture(scope="module")
def labelled(spark):
    draw, rows, marks = random.Random(5), [], []
    for doc_id in range(1500):
        toxic = doc_id % 9 == 0
        words = prose(doc_id, 60).split()
        if toxic:
            for _ in range(draw.randint(2, 6)):
                words.insert(draw.randrange(len(words)), draw.choice(["idiot", "moron", "scum,", "zorkface", "glimwit"]))
        rows.append((doc_id, " ".join(words), "en", "s", 1))
        if doc_id % 10 < 7:
            marks.append((doc_id, 1, int(toxic) if draw.random() > 0.04 else 1 - int(toxic)))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (None, "you idiot, you scum", None, None, None), rows[9]]
    marks += [(7, 1, 1), (7, 1, 0), (8, 1, None), (9999, 1, 1)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr(
        "*", "1 AS label", "2 AS part", "3 AS raw", "4 AS features", "5 AS toxic")
    return documents.repartition(4), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def scored(labelled):
    return toxic_scores(*labelled).collect()


def test_held_out_documents_are_told_apart(scored):
    held = [row for row in scored if row.held_out and row.doc_id < 1500]
    assert len(held) > 300 and all(row.held_out == (id_remainder(row.doc_id, 3) == 1) for row in scored)
    right = np.mean([row.predicted == int(row.doc_id % 9 == 0) for row in held])
    assert right > 0.98
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7) for row in scored)


def test_scores_are_calibrated(scored):
    clean = [row.score for row in scored if row.doc_id is not None and row.doc_id < 1500 and row.doc_id % 9]
    assert np.mean(clean) < 0.12  # 4 % of the labels are wrong


def test_every_row_has_a_score(scored):
    ids = sorted(row.doc_id for row in scored if row.doc_id is not None)
    assert len(scored) == 1504 and ids.count(9) == 2
    assert {row.predicted for row in scored if row.doc_id in (2000, 2001)} == {0}


def test_labels_of_held_out_rows_are_not_learnt(spark, labelled, scored):
    documents, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    key = lambda rows: sorted((repr(row.doc_id), round(row.score, 9)) for row in rows)
    assert key(toxic_scores(documents, flipped).collect()) == key(scored)


def test_rejected_rows_go_and_columns_stay(labelled, scored):
    documents, labels = labelled
    clean = without_toxic(documents, labels)
    assert clean.columns == documents.columns
    assert sorted(repr(row.doc_id) for row in clean.collect()) == sorted(repr(row.doc_id) for row in scored if not row.predicted)


def test_without_labels_and_without_rows(spark, labelled, nothing):
    documents, labels = labelled
    none = labels.where("false")
    assert {(row.score, row.predicted) for row in toxic_scores(documents, none).collect()} == {(0.0, 0)}
    assert toxic_scores(nothing, labels).collect() == [] and without_toxic(nothing, none).collect() == []
