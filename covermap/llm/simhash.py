"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other are linked. Their 64 bits are dealt to partitions so that bits
that occur together share one. If two fingerprints differ by at most ``radius`` bits and thresholds t sum to
radius - partitions + 1, then in some partition they differ by at most t bits; -1 leaves a partition
out. Each fingerprint gets its own thresholds, by dynamic programming over the partitions on what each would
cost: the values to be probed, and the candidates that a histogram of the partition's values lets expect. So
a fingerprint with a very common half is searched by its other half. Probes meet the indexed values in an
equality join, which verifies the whole distance. Equal fingerprints are one before all this, so copies make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from covermap.llm.common import keeps_columns, kept, slices
from covermap.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3
#: Two halves of 32 bits keep candidates few for billions of fingerprints, for some 70 probes each.
PARTITIONS = 2
#: Bins of the histogram of each partition's values: of fixed size, however many fingerprints there are.
BINS = 1 << 16
#: What verifying a candidate costs beside a probe.
CANDIDATE_COST = 0.5

_SEED = 42


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> tuple[bytes, int]:
    """The XXH64 of each shingle, eight bytes each in big-endian order, and how many there are."""
    parts = text.lower().split()
    if not parts:
        return b"", 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_digest(joined, _SEED), 1
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist() if words > 1 else (ends - lengths).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], _SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]), len(starts)


def simhashes(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if it is set in over half of the shingles' hashes."""
    result = np.zeros(len(texts), dtype=np.uint64)
    hashes = [shingle_hashes(text) for text in texts]
    filled = [row for row, (_, count) in enumerate(hashes) if count]
    if filled:
        counts = np.array([hashes[row][1] for row in filled], dtype=np.int64)
        digests = np.frombuffer(b"".join(hashes[row][0] for row in filled), dtype=np.uint8).reshape(-1, 8)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        ones = np.empty((len(filled), 64), dtype=np.int64)
        for byte in range(8):  # one byte of the hashes at a time keeps the unpacked bits few
            bits = np.unpackbits(np.ascontiguousarray(digests[:, byte]).reshape(-1, 1), axis=1)
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(ones * 2 > counts[:, None], axis=1)
        result[filled] = packed.view(">u8").ravel()
    return result


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit integer; 0 for texts without words and null."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(simhashes(texts).view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id bigint, fp bigint")


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    """[row, 64] of 0/1, bit 0 first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(distinct: DataFrame) -> np.ndarray:
    """The absolute correlation of each two bits over all fingerprints, from 64 x 64 sums of each task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            if batch.num_rows:
                bits = _bit_matrix(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
                bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(65 * 65), pa.int32()), pa.array(total.ravel())], names=["cell", "total"])

    total = np.zeros(65 * 65)
    for row in distinct.select("fp").mapInArrow(summed, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        total[row.cell] = row.total
    total = total.reshape(65, 65)
    count = max(total[64, 64], 1.0)
    mean = total[:64, 64] / count
    covariance = total[:64, :64] / count - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    return np.abs(covariance / np.outer(deviation, deviation))


def group_bits(correlations: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits dealt to partitions of equal size: each starts with the bit most correlated with the free ones and grows by the closest."""
    free, groups = set(range(64)), []
    for number in range(partitions):
        size = 64 * (number + 1) // partitions - 64 * number // partitions
        rest = sorted(free)
        group = [max(rest, key=lambda bit: (correlations[bit, rest].sum(), -bit))]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda bit: (correlations[bit, group].sum(), -bit)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def extract(values: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a partition as a number."""
    result = np.zeros(len(values), dtype=np.uint64)
    for place, bit in enumerate(group):
        result |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return result


def _bins(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _masks(width: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << bit for bit in bits) for bits in combinations(range(width), distance)], dtype=np.uint64)


def allocate(costs: np.ndarray, radius: int) -> np.ndarray:
    """[row, partition] thresholds of least cost with sum radius - partitions + 1.

    ``costs[row, partition, t + 1]`` is the cost of threshold t, from -1 on. The program's state is how much of the
    sum of all t + 1, which is radius + 1, the partitions so far have used.
    """
    rows, partitions, _ = costs.shape
    best = np.full((rows, radius + 2), np.inf)
    best[:, 0] = 0
    choices = []
    for number in range(partitions):
        new = np.full_like(best, np.inf)
        choice = np.zeros(best.shape, dtype=np.int64)
        for used in range(radius + 2):
            for step in range(used + 1):
                cost = best[:, used - step] + costs[:, number, step]
                better = cost < new[:, used]
                new[better, used] = cost[better]
                choice[better, used] = step
        best = new
        choices.append(choice)
    left = np.full(rows, radius + 1)
    thresholds = np.zeros((rows, partitions), dtype=np.int64)
    for number in reversed(range(partitions)):
        step = choices[number][np.arange(rows), left]
        thresholds[:, number] = step - 1
        left -= step
    return thresholds


def threshold_costs(values: np.ndarray, groups: list[list[int]], histograms: np.ndarray, radius: int) -> np.ndarray:
    """What each threshold costs for each fingerprint and partition: probes, and expected candidates.

    Candidates within one bit are looked up in the histogram, those farther away are taken as the average.
    """
    costs = np.zeros((len(values), len(groups), radius + 2))
    for number, group in enumerate(groups):
        own = extract(values, group)
        total = histograms[number].sum()
        expected = histograms[number][_bins(own)].astype(float)
        probes = 1
        costs[:, number, 1] = probes + CANDIDATE_COST * expected
        for distance in range(1, radius + 1):
            probes += comb(len(group), distance)
            if distance == 1:
                for mask in _masks(len(group), 1):
                    expected += np.maximum(histograms[number][_bins(own ^ mask)] - total / BINS, 0)
            else:
                expected += comb(len(group), distance) * total / 2.0 ** len(group)
            costs[:, number, distance + 1] = probes + CANDIDATE_COST * expected
    return costs


def _histograms(distinct: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """[partition, bin] counts of all fingerprints; a fixed number of cells reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups) * BINS, dtype=np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for number, group in enumerate(groups):
                total += np.bincount(number * BINS + _bins(extract(values, group)), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    result = np.zeros(len(groups) * BINS, dtype=np.int64)
    cells = distinct.select("fp").mapInArrow(counted, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    result[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
    return result.reshape(len(groups), BINS)


def links(distinct: DataFrame, radius: int = RADIUS, partitions: int = PARTITIONS) -> DataFrame:
    """(a, b), a < b: the fingerprints of ``distinct`` (fp, without repeats) that differ by at most ``radius`` bits."""
    spark = distinct.sparkSession
    groups = group_bits(bit_correlations(distinct), partitions)
    histograms = spark.sparkContext.broadcast(_histograms(distinct, groups))

    def keyed(number: int, values: np.ndarray) -> np.ndarray:
        """Partition and value in one number; values of at most 61 bits."""
        return (values * np.uint64(partitions) + np.uint64(number)).view(np.int64)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for number, group in enumerate(groups):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keyed(number, extract(values, group))), batch.column(0)], names=["key", "a"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.column(0).slice(start, 1024).to_numpy()
                values = part.view(np.uint64)
                thresholds = allocate(threshold_costs(values, groups, histograms.value, radius), radius)
                for number, group in enumerate(groups):
                    own = extract(values, group)
                    for distance in range(int(thresholds[:, number].max(initial=-1)) + 1):
                        chosen = thresholds[:, number] >= distance
                        masks = _masks(len(group), distance)
                        keys = keyed(number, (own[chosen, None] ^ masks[None, :]).ravel())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), pa.array(np.repeat(part[chosen], len(masks)))], names=["key", "b"])

    index = distinct.select("fp").mapInArrow(indexed, "key bigint, a bigint")
    probes = distinct.select("fp").mapInArrow(probing, "key bigint, b bigint")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = probes.join(index, (probes["key"] == index["key"]) & (F.col("a") != F.col("b")) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(rows: DataFrame, radius: int, partitions: int) -> DataFrame:
    """(fp, lowest, component) for the fingerprints of (doc_id, fp) rows; component names the group by its smallest fingerprint."""
    distinct = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    found = components(links(distinct, radius, partitions), "a", "b")
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "lowest", F.coalesce("component", "fp").alias("component"))


def _identified(grouped: DataFrame) -> DataFrame:
    return grouped.join(grouped.groupBy("component").agg(F.min("lowest").alias("component_id")), "component")


def _components(rows: DataFrame, radius: int, partitions: int) -> DataFrame:
    """(fp, component_id, component) for the fingerprints of (doc_id, fp) rows."""
    return _identified(_grouped(rows, radius, partitions))


def _wider_components(documents: DataFrame, radius: int, partitions: int, similarity: float) -> DataFrame:
    """As _components, with groups joined that hold texts of at least ``similarity`` in their five-word shingles."""
    from covermap.llm import similar_texts

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                bands = pa.array(list(similar_texts.band_keys(texts)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(simhashes(texts).view(np.int64)), pa.array(similar_texts.content_keys(texts)), bands],
                    names=["doc_id", "fp", "node", "bands"])

    rows = kept(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        signed, "doc_id bigint, fp bigint, node bigint, bands array<bigint>"))
    grouped = kept(_grouped(rows.select("doc_id", "fp"), radius, partitions))
    nodes = rows.dropDuplicates(["node"]).join(grouped, "fp").select("node", "bands", F.col("component").alias("grp"))
    joined = components(similar_texts.similar_groups(documents, kept(nodes), similarity), "a", "b").withColumnRenamed("component", "joined")
    wider = grouped.join(joined, grouped["component"] == joined["node"], "left")
    return _identified(kept(wider.select("fp", "lowest", F.coalesce("joined", "component").alias("component"))))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, partitions: int = PARTITIONS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``documents``.

    fingerprint has 16 hex digits; component_id is the smallest doc_id among the documents reachable over
    links. Null texts and texts without words have fingerprint 0, which is linked like any other. A null doc_id
    is never a component's id unless the component has no other. Repeated rows stay repeated, an empty table gives
    no rows, and other columns are not read.
    """
    rows = kept(fingerprints(documents))
    named = _components(rows, radius, partitions).select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@keeps_columns
def first_of_each(documents: DataFrame, radius: int = RADIUS, partitions: int = PARTITIONS, similarity: float | None = None) -> DataFrame:
    """The rows of ``documents``, all columns, that stay: of each group of near duplicates the smallest doc_id.

    With ``similarity``, texts whose five-word shingles have at least that Jaccard similarity are near duplicates too.

    A row without an id stays only where its group has none with one. Rows that repeat the id and fingerprint of
    the one that stays are the same document and stay with it.
    """
    if similarity is None:
        named = _components(kept(fingerprints(documents)), radius, partitions)
    else:
        named = _wider_components(documents, radius, partitions, similarity)
    stay = (named.where(F.col("lowest").eqNullSafe(F.col("component_id"))).groupBy("component")
            .agg(F.min("fp").alias("stay_fp"), F.first("component_id").alias("stay_id")).drop("component"))
    place, schema = documents.columns.index("text"), documents.schema
    row_schema = T.StructType([T.StructField("row", schema), T.StructField("fp", T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(place)):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.StructArray.from_arrays(part.columns, fields=list(part.schema)), pa.array(simhashes(texts).view(np.int64))], names=["row", "fp"])

    rows = documents.mapInArrow(marked, row_schema)
    same = (F.col("fp") == F.col("stay_fp")) & F.col("row.doc_id").eqNullSafe(F.col("stay_id"))
    return rows.join(stay, same, "left_semi").select("row.*")
