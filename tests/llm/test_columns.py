"""Stages that return rows of documents keep all columns, whatever they are called."""

import pytest

from covermap.llm.decontamination import without_leaks
from covermap.llm.mixing import mix
from covermap.llm.simhash import first_of_each
from covermap.llm.toxicity import without_toxic

from conftest import prose


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(n, prose(n, 40), "en", "ab"[n % 2], n, f"x{n}", n * 2, n * 3, n * 5, n * 7) for n in range(24)]
    names = ["doc_id", "text", "lang", "source", "a.b", "tick`ed", "same", "same", "_column_4", "fp"]
    return spark.createDataFrame(rows, [f"c{place}" for place in range(len(names))]).toDF(*names)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, 0) for n in range(24)], "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(77, 30)), (2, prose(3, 40))], "item_id bigint, text string")


@pytest.mark.parametrize("stage", ["toxic", "near", "similar", "leaks", "mix"])
def test_columns_of_any_name_stay(odd, labels, benchmark, stage):
    result = {"toxic": lambda: without_toxic(odd, labels), "near": lambda: first_of_each(odd), "similar": lambda: first_of_each(odd, similarity=0.8),
              "leaks": lambda: without_leaks(odd, benchmark), "mix": lambda: mix(odd)}[stage]()
    assert result.columns == odd.columns
    given = {tuple(row) for row in odd.collect()}
    got = [tuple(row) for row in result.collect()]
    assert got and set(got) <= given
    if stage == "leaks":
        assert {row[0] for row in got} == set(range(24)) - {3}
    elif stage != "mix":
        assert len(got) == len(set(got)) == 24
