"""Texts that share most of their shingles: pairs of at least a given Jaccard similarity of SHINGLE_WORDS-word shingles.

Texts are candidates where all ROWS min-hashes of one of BANDS bands are equal; a pair of similarity s is one with
probability 1 - (1 - s ** ROWS) ** BANDS, 0.9998 for 0.8. Candidates are verified on their whole sets of shingles. Groups of up to
LEADERS texts of a band are compared entirely. In larger ones every text meets a leader, another one in each band; texts that are
not near it are dealt to finer groups by FINER further bands, again until no large group is left. Before that the links found so far are
followed: a finer group whose texts they have joined already can add nothing and is dropped. Texts that have no more in common than
a frequent line part at once, and very many copies are joined by a few bands, so rows stay in proportion to the texts either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from covermap.llm.common import kept, release, slices
from covermap.llm.components import components
from covermap.llm.simhash import shingle_hashes

SHINGLE_WORDS = 5
BANDS = 16
ROWS = 4
LEADERS = 8
#: The leader of a larger group, and the further bands that its other texts are dealt by. Of the pairs at 0.8
#: a step keeps 0.86 together; one at 0.7 meets in 0.4 bands on average. With 4 bands of 4 it would be 0.88, and 0.96 bands, so texts
#: that are not quite near would part slowly.
LARGE_LEADERS = 1
FINER = 28
FINER_ROWS = 12


def _factors(seed: int, bands: int, rows: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = _factors(29, BANDS, ROWS)
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def content_keys(texts: list[bytes]) -> np.ndarray:
    """A number for each text's words in lower case; texts of equal words share it."""
    return np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().split())) for text in texts], dtype=np.uint64).view(np.int64)


def _bands(sets: list[bytes], factors: np.ndarray, kind: str) -> np.ndarray:
    """[text, band]: the min-hashes of each band in one number, from the texts' shingles. Texts without words get that of no shingle."""
    result = np.zeros((len(sets), len(factors)), dtype=np.uint64)
    filled = [row for row, own in enumerate(sets) if own]
    if filled:
        values = np.frombuffer(b"".join(sets[row] for row in filled), dtype=kind).astype(np.uint64)
        sizes = np.array([len(sets[row]) // 8 for row in filled])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for band, rows in enumerate(factors):
            key = np.full(len(filled), band + 1, dtype=np.uint64)
            for factor in rows:
                key = (key ^ np.minimum.reduceat(values * factor, starts)) * _MIXER
                key ^= key >> np.uint64(32)
            result[filled, band] = key
    return result.view(np.int64)


def band_keys(texts: list[bytes]) -> np.ndarray:
    return _bands([shingle_hashes(text, SHINGLE_WORDS)[0] for text in texts], _FACTORS, ">u8")


def _with_keys(documents: DataFrame) -> DataFrame:
    """(node, text): each text and the key of its content."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(content_keys(texts)), batch.column(0).slice(start, len(texts))], names=["node", "text"])

    return documents.select(F.col("text").cast("string")).mapInArrow(keyed, "node bigint, text string")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): the sorted different shingles of each (node, text), eight bytes each."""

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(1)):
                sets = [np.unique(np.frombuffer(shingle_hashes(text, SHINGLE_WORDS)[0], dtype=">u8").astype("<u8")).tobytes() for text in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(collected, "node bigint, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    """The similarity of two sorted sets of eight-byte numbers; that of two empty ones is 1."""
    first, second = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    common = len(np.intersect1d(first, second, assume_unique=True))
    every = len(first) + len(second) - common
    return common / every if every else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) whose sets of shingles are similar enough."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(a.as_py(), b.as_py()) >= least for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
              .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(compared, "a bigint, b bigint")


def _met(members: DataFrame) -> DataFrame:
    """The members (key, node, joined, ...) of keys that two joined groups share, and how many they are (n)."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("joined").alias("low"), F.max("joined").alias("high"))
    return members.join(sizes.where("low < high").select("key", "n"), "key")


def _finer(rest: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
    """(key, node, grp, joined, size): the members of large groups by finer keys."""
    factors = _factors(seed, FINER, FINER_ROWS)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.array(list(_bands(part, factors, "<u8")), pa.list_(pa.int64()))], names=["node", "more"])

    own = rest.select("node").distinct().join(sets, "node").select("node", "shingles").mapInArrow(banded, "node bigint, more array<bigint>")
    # By node alone, a text of many groups would have all its rows made in one task.
    return rest.select("key", "node", "grp", "joined", "size").join(own, "node").repartition("key", "node").select(
        F.col("key").alias("old"), "node", "grp", "joined", "size", F.posexplode("more").alias("band", "value")).select(
        F.xxhash64("old", "band", "value").alias("key"), "node", "grp", "joined", "size")


def _rejoined(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The members, with the smallest joined group that the links (a, b) lead to."""
    found = components(linked, "a", "b").select(F.col("node").alias("joined"), "component")
    return members.join(found, "joined", "left").withColumn("joined", F.coalesce("component", "joined")).drop("component")


def similar_groups(documents: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: groups that hold two texts of at least the ``least`` similarity.

    ``nodes`` are (node, bands, grp), one row for each different content of ``documents``; texts of one group need no comparison.
    """
    rest = kept(_met(nodes.select("node", "grp", F.col("grp").alias("joined"), F.explode("bands").alias("key"))))
    texts = _with_keys(documents).join(rest.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = kept(_shingle_sets(texts))
    rest = kept(rest.join(sets.select("node", F.length("shingles").alias("size")), "node"))
    # Sets are no more similar than their sizes, so of the rest the sets need not travel.
    near_sizes = F.least("size", "size_a") >= F.greatest("size", "size_a") * F.lit(least - 1e-9)
    found, seed = [], 31
    while not rest.isEmpty():
        # Leaders by a hash of key and text: the same text leads in few of its groups.
        ordered = rest.withColumn("place", F.xxhash64("node", "key"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy("place", "node"))
        first = (ordered.withColumn("rank", rank).where(F.col("rank") <= LEADERS)
                 .where((F.col("rank") <= LARGE_LEADERS) | (F.col("n") <= LEADERS))
                 .select("key", F.col("node").alias("a"), F.col("grp").alias("grp_a"), F.col("joined").alias("joined_a"),
                         F.col("place").alias("place_a"), F.col("size").alias("size_a")))
        pairs = ordered.join(first, "key").where("place_a < place OR (place_a = place AND a < node)").where((F.col("grp_a") == F.col("grp")) | near_sizes)
        met = kept(pairs.select("key", "a", "grp_a", "joined_a", F.col("node").alias("b"), F.col("grp").alias("grp_b"), F.col("joined").alias("joined_b"), "n"))
        good = kept(_verified(met.where("grp_a != grp_b").select("a", "b").distinct(), sets, least))
        linked = met.join(good, ["a", "b"], "left_semi")
        new = kept(linked.where("joined_a != joined_b").select(
            F.least("joined_a", "joined_b").alias("a"), F.greatest("joined_a", "joined_b").alias("b")).distinct())
        found.append(new)
        large = F.col("n") > LEADERS
        if rest.where(large).isEmpty():
            break
        # Of large groups, those go on that are neither leaders nor near one. Finer keys whose members the links have joined are done.
        settled = linked.where(large).select("key", F.col("b").alias("node")).union(met.where(large & (F.col("grp_a") == F.col("grp_b"))).select("key", "b"))
        settled = settled.union(first.select("key", "a")).distinct()
        going_on = _rejoined(rest.where(large).join(settled, ["key", "node"], "left_anti"), new)
        rest = kept(_met(_finer(going_on, sets, seed)))
        seed += 1
        release(documents.sparkSession)
    none = documents.sparkSession.createDataFrame([], "a bigint, b bigint")
    return kept(reduce(DataFrame.union, found, none).distinct())
