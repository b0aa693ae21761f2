"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts chunk by chunk.

A chunk of n bytes b has the value sum(b[i] * r**(n - 1 - i)) modulo a prime, so a whole text's value
follows from those of its chunks: value(ab) = value(a) * r**len(b) + value(b). Chunks are hashed
independently of each other, however long the text, and folded by that rule. Two primes give 62 bits,
to which the length is added. Texts whose fingerprints agree meet again as chunks and are compared byte
by byte with those of the group's first text; should one differ, its group is split by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from covermap.llm.common import kept, text_bytes

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 654435769)
#: So short that a sum of byte times power below 2**31 stays under 2**64.
CHUNK_BYTES = 1 << 18
#: Ways into which the rows of one fingerprint are split, so that a very large group is not one task's.
SALTS = 16

_SPACES = b" \t\n\r\x0b\x0c"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _SPACES else b"") + b" ".join(words) + (b" " if text[-1] in _SPACES else b"")


def _powers(length: int) -> list[np.ndarray]:
    """base**0 .. base**length modulo each prime, by doubling."""
    tables = []
    for base, prime in zip(BASES, PRIMES):
        powers = np.ones(1, dtype=np.uint64)
        while len(powers) <= length:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)])
        tables.append(powers[: length + 1])
    return tables


class ChunkHasher:
    """The values of chunks of at most ``chunk_bytes`` bytes."""

    def __init__(self, chunk_bytes: int = CHUNK_BYTES):
        self.chunk_bytes = chunk_bytes
        self.powers = _powers(chunk_bytes)

    def chunks(self, text: bytes) -> Iterator[bytes]:
        for start in range(0, len(text), self.chunk_bytes):
            yield text[start : start + self.chunk_bytes]

    def value(self, chunk: bytes) -> dict:
        data = np.frombuffer(chunk, dtype=np.uint8)[::-1].astype(np.uint64)
        hashes = [int(np.dot(data, powers[: len(data)]) % np.uint64(prime)) for powers, prime in zip(self.powers, PRIMES)]
        return {"h1": hashes[0], "h2": hashes[1], "shift1": int(self.powers[0][len(data)]),
                "shift2": int(self.powers[1][len(data)]), "n": len(data)}


_VALUE = "struct<h1: bigint, h2: bigint, shift1: bigint, shift2: bigint, n: bigint>"
_VALUES = pa.list_(pa.struct([(name, pa.int64()) for name in ("h1", "h2", "shift1", "shift2", "n")]))


def combined(values: Column) -> Column:
    """The fingerprint (h1, h2, n) of a text from the values of its chunks in order."""

    def step(total: Column, chunk: Column) -> Column:
        parts = [((total[f"h{i}"] * chunk[f"shift{i}"] + chunk[f"h{i}"]) % F.lit(PRIMES[i - 1])).alias(f"h{i}") for i in (1, 2)]
        return F.struct(*parts, (total["n"] + chunk["n"]).alias("n"))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(values, F.struct(zero.alias("h1"), zero.alias("h2"), zero.alias("n")), step)


def fingerprints(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = False) -> DataFrame:
    """(doc_id, text_sha256, fingerprint[, chunks]) of each row's normalised text; a null text is empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ChunkHasher(chunk_bytes)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [normalised(text) for text in text_bytes(part.column(1))]
                columns = [
                    part.column(0),
                    pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string()),
                    pa.array([[hasher.value(chunk) for chunk in hasher.chunks(text)] for text in texts], _VALUES),
                ]
                if with_chunks:
                    columns.append(pa.array([list(hasher.chunks(text)) for text in texts], pa.list_(pa.binary())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "text_sha256", "values"] + ["chunks"] * with_chunks
    schema = f"doc_id bigint, text_sha256 string, values array<{_VALUE}>" + ", chunks array<binary>" * with_chunks
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(hashed, schema)
    return rows.withColumn("fingerprint", combined("values")).drop("values")


def confirmed(documents: DataFrame, repeated: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(fingerprint, text_sha256, same): whether the texts equal the first one with that fingerprint.

    ``repeated`` holds the fingerprints that occur more than once. Their texts are joined chunk by chunk
    with the first text's chunks; no task ever holds a group, and a large group is split by the join.
    """
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = (fingerprints(documents, chunk_bytes, with_chunks=True)
             .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["fingerprint", "salt"], "left_semi"))
    chunks = kept(texts.select("fingerprint", "text_sha256", "doc_id", F.posexplode("chunks").alias("number", "chunk")))
    first = chunks.groupBy("fingerprint", "number").agg(
        F.min_by("chunk", F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")).alias("first_chunk"))
    return (chunks.join(first, ["fingerprint", "number"])
            .groupBy("fingerprint", "text_sha256").agg(F.bool_and(F.col("chunk") == F.col("first_chunk")).alias("same")))


def exact_groups(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``documents``.

    A null text is empty, and empty texts are equal to each other. A null doc_id is never the one that
    stays beside a row with an id; of rows that share the smallest doc_id, all count as staying. Other
    columns are not read. An empty table gives no rows.
    """
    rows = kept(fingerprints(documents, chunk_bytes))
    by_text = rows.groupBy("fingerprint", "text_sha256").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("copies"))
    repeated = (by_text.groupBy("fingerprint").agg(F.sum("copies").alias("copies"))
                .where((F.col("copies") > 1) & (F.col("fingerprint.n") > 0)).select("fingerprint"))
    checked = by_text.join(confirmed(documents, repeated, chunk_bytes), ["fingerprint", "text_sha256"], "left")
    # Unequal texts under one fingerprint would fall apart by digest here.
    split = checked.withColumn("class", F.when(F.coalesce("same", F.lit(True)), F.lit("")).otherwise(F.col("text_sha256")))
    classes = split.groupBy("fingerprint", "class").agg(F.min("lowest").alias("keep_id"), F.sum("copies").alias("group_size"))
    named = split.select("fingerprint", "text_sha256", "class").join(classes, ["fingerprint", "class"]).drop("class")
    return rows.join(named, ["fingerprint", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
