import hashlib
import re

import pytest
from pyspark.sql import functions as F

from covermap.llm import exact_dedup
from covermap.llm.exact_dedup import BASES, PRIMES, ChunkHasher, combined, exact_groups, fingerprints, normalised


def normal(text):
    return re.sub(rb"[\x20\x09-\x0d]+", b" ", (text or "").encode())


def expected(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    result = []
    for doc_id, text, _ in rows:
        ids = groups[normal(text)]
        keep = min((one for one in ids if one is not None), default=None)
        result.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(normal(text)).hexdigest()))
    return sorted(result, key=repr)


@pytest.mark.parametrize("text", [b"", b" ", b"\t\n", b"a", b" a", b"a\x0b\x0cb ", b"  a  b", "é ü ".encode(), b"a\x1cb"])
def test_normalised(text):
    assert normalised(text) == normal(text.decode())


def test_values_combine_to_the_whole_polynomial(spark):
    text = bytes(range(256)) * 5
    rows = spark.createDataFrame([([ChunkHasher(100).value(part) for part in ChunkHasher(100).chunks(text)],)], "v array<struct<h1:bigint,h2:bigint,shift1:bigint,shift2:bigint,n:bigint>>")
    found = rows.select(combined(F.col("v")).alias("f")).first().f
    whole = []
    for base, prime in zip(BASES, PRIMES):
        value = 0
        for byte in text:
            value = (value * base + byte) % prime
        whole.append(value)
    assert (found.h1, found.h2, found.n) == (*whole, len(text))


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 18])
def test_against_brute_force(documents, rows_of, collected, chunk_bytes):
    assert collected(exact_groups(documents, chunk_bytes)) == expected(rows_of)


def test_fingerprints_do_not_depend_on_the_chunks(documents, collected):
    assert collected(fingerprints(documents, 33)) == collected(fingerprints(documents, 4096))


def test_equal_fingerprints_of_unequal_texts_are_told_apart(documents, rows_of, collected, monkeypatch):
    monkeypatch.setattr(exact_dedup, "combined", lambda values: F.struct(
        F.lit(1).cast("bigint").alias("h1"), F.lit(1).cast("bigint").alias("h2"), F.when(F.size(values) > 0, 1).otherwise(0).cast("bigint").alias("n")))
    assert collected(exact_groups(documents, 64)) == expected(rows_of)


def test_empty_table(nothing):
    assert exact_groups(nothing).collect() == []
