import re

import pytest

from covermap.llm.license_scan import BASE_PHRASES, LEAST_SHARE, TEMPLATES, common_words, license_spans, scan_licenses, words_of, window_hashes

from conftest import prose

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
MIT = next(text for label, text in TEMPLATES if label == "mit" and len(text) > 100)
APACHE = next(text for label, text in TEMPLATES if label == "apache-2.0" and len(text) > 100)


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))
    places = [(at, label) for label, phrase in BASE_PHRASES for at in range(len(words)) if words[at:at + len(phrase.split())] == phrase.split()]
    at = [place for place, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def without(text, *places):
    return " ".join(word for place, word in enumerate(text.split()) if place not in places)


CASES = {
    1: (f"{prose(1, 30)} {MIT} {prose(2, 30)}", "mit"),
    2: (f"{prose(3, 30)} {without(MIT, 5, 20, 41, 60)} {prose(4, 9)}", "mit"),
    3: (f"x {APACHE.upper()}", "apache,apache-2.0"),
    4: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    5: ("Licensed under CC-BY 4.0", "cc-by,cc-by-4.0"),
    6: ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    7: ("Released under the MIT License. " * 3000, "mit"),
    8: ("the mit licensed; gnu general public; apache\nlicense cc_by", "apache,cc-by"),
    9: (" ".join(MIT.split()[:30]), ""),
    10: (prose(5, 20_000), ""),
    11: ("", ""),
    12: (None, ""),
    13: (" ".join(reversed(MIT.split())), ""),
    14: (f"{MIT} {APACHE}", "apache,apache-2.0,mit"),
    15: ("MIT\x00License é Apache🌕License", "mit"),
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(doc_id, text, "a", 1, 2.0, "x") for doc_id, (text, _) in CASES.items()]
    rows += [rows[3], (None, CASES[6][0], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, labels string, row int, score double, hash string").repartition(3)


@pytest.fixture(scope="module")
def found(frame):
    result = scan_licenses(frame)
    assert result.columns == NAMES
    return result.collect()


def test_base_places(found):
    assert len(found) == len(CASES) + 2
    for row in found:
        text = CASES[row.doc_id if row.doc_id is not None else 6][0]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text), row.doc_id


@pytest.mark.parametrize("doc_id", sorted(CASES))
def test_labels(found, doc_id):
    for row in found:
        if row.doc_id == doc_id:
            assert row.labels == CASES[doc_id][1] and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
            assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)


def test_spans_lie_where_the_templates_do(frame):
    spans = {(row.doc_id, row.label): row for row in license_spans(frame).where("doc_id IN (1, 2, 14)").collect()}
    one = spans[1, "mit"]
    assert one.share == 1 and one.start == len(words_of(prose(1, 30).encode())) and one.end == one.start + len(words_of(MIT.encode()))
    assert LEAST_SHARE <= spans[2, "mit"].share < 1
    assert spans[14, "mit"].end <= spans[14, "apache-2.0"].start


def test_every_repeat_is_a_span(frame):
    assert license_spans(frame).where("doc_id = 7").count() == 3000


def test_common_words_by_the_usual_table():
    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y and x > 0 else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    import random
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(25))] for _ in range(2))
        b = [word + 1 for word in b]
        assert common_words(a, b) == plain(a, b)


def test_windows_of_template_words_only():
    import numpy as np
    at, hashes = window_hashes(np.array([1, 2, 3, 0, 1, 2, 3, 4], dtype=np.int32), 3)
    assert at.tolist() == [0, 4, 5] and hashes[0] == hashes[1] != hashes[2]
    assert window_hashes(np.array([1], dtype=np.int32), 3)[0].tolist() == []


def test_own_templates_and_nothing(spark, nothing):
    assert scan_licenses(nothing).collect() == [] and license_spans(nothing).collect() == []
    frame = spark.createDataFrame([(1, "All of this is ours alone, you see")], "doc_id bigint, text string")
    assert [row.labels for row in scan_licenses(frame, [("ours", "this is ours alone"), ("short", "you see")]).collect()] == ["ours"]
    assert [row.labels for row in scan_licenses(frame, []).collect()] == [""]
