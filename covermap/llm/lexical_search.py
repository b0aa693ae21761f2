"""Ranked lexical search by hashed max-sketches.

1. One reading of the documents counts terms and folds each document into a sketch: two rows of coordinates, by hashes of the
   terms, each with the largest count of its terms. A term's impact grows with its count, so the impact of a coordinate's count is the
   maximum of its terms' impacts. A sketch has sixteen to 32 coordinates a row for each different term, most of
   them 0, and travels compressed.
2. A block of queries looks up its terms in every sketch. The sum of the lower of both impacts, weighted, bounds the score from above.
3. The documents with the highest bounds are scored exactly from their texts; the last place of each query is its threshold.
   No document with a bound below it can have a place, so all documents from there up are scored exactly, and the first are the result.

Sketches do not depend on the queries, and each further block of queries reads sketches and few texts only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from covermap.llm.common import alphanumeric_words, kept, slices

TOP = 50
#: Query terms, with repeats, of about one block: a block is broadcast.
BLOCK_TERMS = 50_000
#: Coordinates of a row for each different term, at least.
COORDINATES = 16
LEAST_BITS = 6
#: A sketch's largest count; it stands for all counts from there on.
MOST = 255
#: Above every impact: (10**9 * tf) div (1000 * tf + 20 * m) for any tf and any m over 0.
IMPACT_BOUND = 1_000_000
#: Documents looked up together.
LOOKED_UP = 512
#: Ids up to this number are broadcast to pick the documents to be scored; more meet them in a shuffle.
BROADCAST_IDS = 1 << 20

_INDEX = "doc_id bigint, n bigint, bits int, sketch binary, term binary, documents bigint"
_FOUND = "query int, doc_id bigint, score bigint"


def _coordinates(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & ((1 << bits) - 1), (hashes * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


def sketch_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, coordinates) of a document's different terms: two rows of 2 ** bits counts."""
    bits = max(LEAST_BITS, (COORDINATES * len(hashes) - 1).bit_length())
    sketch = np.zeros((2, 1 << bits), dtype=np.uint8)
    order = np.argsort(counts, kind="stable")  # of terms that share a coordinate, the most frequent one is written last
    for row, at in zip(sketch, _coordinates(hashes[order], bits)):
        row[at] = np.minimum(counts[order], MOST)
    return bits, sketch


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, terms), dtype=np.int64, count=len(terms))


def _indexed(documents: DataFrame) -> DataFrame:
    """A row (doc_id, n, bits, sketch) for each document with terms, and rows (term, documents) of partial counts."""
    names = [part.split()[0] for part in _INDEX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def batch_of(size: int, columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(size, kind) for name, kind in zip(names, kinds)], names=names)

    def flush(frequency: Counter) -> Iterator[pa.RecordBatch]:
        terms = list(frequency)
        for start in range(0, len(terms), 50_000):
            part = terms[start : start + 50_000]
            yield batch_of(len(part), {"term": part, "documents": [frequency[term] for term in part]})

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency: Counter = Counter()
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts)).to_pylist()
                rows: dict[str, list] = {"doc_id": [], "n": [], "bits": [], "sketch": []}
                for doc_id, text in zip(ids, texts):
                    words = alphanumeric_words(text)
                    if words:
                        counts = Counter(words)
                        frequency.update(counts.keys())
                        bits, sketch = sketch_of(_hashes(list(counts)), np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
                        for name, value in zip(rows, (doc_id, len(words), bits, compress(sketch.tobytes(), 1))):
                            rows[name].append(value)
                yield batch_of(len(rows["n"]), rows)
                if len(frequency) > 400_000:
                    yield from flush(frequency)
                    frequency.clear()
        yield from flush(frequency)

    return kept(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(indexed, _INDEX))


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, term): the different terms of each row of ``queries``."""
    kind = queries.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                part = batch.slice(start, len(texts))
                terms = pa.array([sorted(set(alphanumeric_words(text))) for text in texts], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), terms], names=["query", "item_id", "terms"])

    rows = queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("string"))
    return kept(rows.mapInArrow(split, f"query bigint, item_id {kind}, terms array<binary>").select("query", "item_id", F.explode("terms").alias("term")))


class Block:
    """A block of queries: their terms with weights, and whose they are. ``queries`` has a list of terms for each."""

    def __init__(self, queries: list[list[bytes]], frequency: dict[bytes, int], documents: int, words: int):
        self.documents, self.words = documents, words
        terms = sorted({term for own in queries for term in own})
        self.place = {term: number for number, term in enumerate(terms)}
        self.hashes = _hashes(terms)
        self.weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * frequency[term] + 1))) for term in terms], dtype=np.int64)
        self.every = np.array([self.place[term] for own in queries for term in own], dtype=np.int64)
        self.starts = np.cumsum([0] + [len(own) for own in queries[:-1]])
        self.size = len(queries)
        self._at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def length_part(self, n: int) -> int:
        return 100 - 50 + (50 * n * self.documents) // self.words

    def _sums(self, impacts: np.ndarray) -> np.ndarray:
        """[document, query] from [document, term]."""
        return np.add.reduceat((impacts * self.weights)[:, self.every], self.starts, axis=1)

    def bounds(self, ns: list[int], bits: list[int], sketches: list[bytes]) -> np.ndarray:
        impacts = np.empty((len(ns), len(self.weights)), dtype=np.int64)
        counts = np.arange(MOST + 1)
        for row, (n, b, raw) in enumerate(zip(ns, bits, sketches)):
            if b not in self._at:
                self._at[b] = _coordinates(self.hashes, b)
            by_count = (1_000_000_000 * counts) // (1000 * counts + 20 * self.length_part(n))
            by_count[MOST] = IMPACT_BOUND
            sketch = np.frombuffer(decompress(raw), dtype=np.uint8).reshape(2, -1)
            first, second = self._at[b]
            impacts[row] = by_count[np.minimum(sketch[0][first], sketch[1][second])]
        return self._sums(impacts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        impacts = np.zeros((len(texts), len(self.weights)), dtype=np.int64)
        for row, text in enumerate(texts):
            words = alphanumeric_words(text)
            found = Counter(filter(self.place.__contains__, words))
            if found:
                at = np.fromiter(map(self.place.__getitem__, found), dtype=np.int64, count=len(found))
                counts = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                impacts[row, at] = (1_000_000_000 * counts) // (1000 * counts + 20 * self.length_part(len(words)))
        return self._sums(impacts)


class Best:
    """The ``top`` rows of each query by score and then id; a null id comes last. Scores of 0 have no place."""

    def __init__(self, queries: int, top: int):
        self.top, none = top, np.empty(0, dtype=np.int64)
        self.rows = [(none, none.astype(bool), none)] * queries
        self.last = np.ones(queries, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        missing, numbers = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        good = scores >= self.last
        for query in np.flatnonzero(good.any(axis=0)):
            new = np.flatnonzero(good[:, query])
            rows = [np.concatenate(pair) for pair in zip(self.rows[query], (scores[new, query], missing[new], numbers[new]))]
            order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.top]
            self.rows[query] = tuple(part[order] for part in rows)
            if len(order) == self.top:
                self.last[query] = self.rows[query][0][-1]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for query, (scores, missing, numbers) in enumerate(self.rows):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), query, dtype=np.int32)), pa.array(numbers, mask=missing), pa.array(scores)],
                                                 names=["query", "doc_id", "score"])


def _first(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each query, with their rank."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def _highest_bounds(index: DataFrame, shared, top: int) -> DataFrame:
    """(query, doc_id, score): of each task, the documents with the highest bounds."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value.size, top)
        for batch in batches:
            for start in range(0, batch.num_rows, LOOKED_UP):
                part = batch.slice(start, LOOKED_UP)
                best.add(shared.value.bounds(*(part.column(place).to_pylist() for place in (1, 2, 3))), part.column(0))
        yield from best.batches()

    return index.mapInArrow(looked_up, _FOUND)


def _not_excluded(index: DataFrame, shared, thresholds) -> DataFrame:
    """(doc_id): the documents that the bound of some query lets in. A bound equal to the last score needs an id that is not larger."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = thresholds.value
        for batch in batches:
            for start in range(0, batch.num_rows, LOOKED_UP):
                part = batch.slice(start, LOOKED_UP)
                bounds = shared.value.bounds(*(part.column(place).to_pylist() for place in (1, 2, 3)))
                own = part.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                keep = ((bounds > last) | ((bounds == last) & (own[:, None] <= ids))).any(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep))], names=["doc_id"])

    return index.mapInArrow(looked_up, "doc_id bigint").distinct()


def _scored(texts: DataFrame, ids: DataFrame, shared, top: int) -> DataFrame:
    """(query, doc_id, score) of each task's best among the documents with these ids."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value.size, top)
        for batch in batches:
            for start, part in slices(batch.column(1)):
                for at in range(0, len(part), LOOKED_UP):
                    few = part[at : at + LOOKED_UP]
                    best.add(shared.value.scores(few), batch.column(0).slice(start + at, len(few)))
        yield from best.batches()

    ids = ids.select(F.col("doc_id").alias("id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(scored, _FOUND)


def search(documents: DataFrame, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with score above 0 of each row (item_id, text) of ``queries``.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased; null and empty texts have none. A term's
    weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact in a document (10**9 * tf) div (1000 * tf + 20 * m) with
    m = 50 + (50 * n * N) div L; N, L and df come from all documents. Equal scores stand by ascending doc_id, null last. Repeated
    rows of ``documents`` have places each, repeated rows of ``queries`` are searched each. Other columns are not read.
    """
    spark, kind = documents.sparkSession, queries.schema["item_id"].dataType.simpleString()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = _indexed(texts)
    sketches = index.where("n IS NOT NULL").select("doc_id", "n", "bits", "sketch")
    count, words = sketches.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = index.where("term IS NOT NULL").select("term", "documents")
    wanted = _query_terms(queries)
    met = frequency.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("documents").alias("df"))
    wanted = kept(wanted.join(met, "term"))
    blocks = -(-wanted.count() // block_terms)
    found = []
    for number in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "item_id", "term", "df").toArrow().to_pylist()
        if not own:
            continue
        items: dict[int, tuple] = {}
        for row in own:
            items.setdefault(row["query"], (row["item_id"], []))[1].append(row["term"])
        block = Block([terms for _, terms in items.values()], {row["term"]: row["df"] for row in own}, count, words)
        shared = spark.sparkContext.broadcast(block)
        likely = _first(_highest_bounds(sketches, shared, top), top).select("doc_id").distinct()
        last = np.ones(block.size, dtype=np.int64)
        ids = np.full(block.size, np.iinfo(np.int64).max)
        for row in _first(_scored(texts, kept(likely), shared, top), top).where(F.col("rank") == top).collect():
            last[row["query"]] = row["score"]
            ids[row["query"]] = row["doc_id"] if row["doc_id"] is not None else np.iinfo(np.int64).max
        rest = kept(_not_excluded(sketches, shared, spark.sparkContext.broadcast((last, ids))))
        ranked = _first(_scored(texts, rest, shared, top), top)
        names = spark.createDataFrame([(place, item) for place, (item, _) in enumerate(items.values())], f"query int, item_id {kind}")
        found.append(kept(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")))
        shared.destroy()
    none = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found) if found else none
