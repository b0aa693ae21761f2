"""Mixing sources to target weights, with block quotas split over output shards by a hypergeometric tree.

1. Sizes are counted over all documents, and targets follow from the sizes of the sources: sources are numbered in Spark, and
   only sums over all sources reach the driver.
2. The documents of a source fall into blocks by a seeded hash; the blocks' order is a permutation of the
   source. A target of f + r times the source takes every block f times and, once more, the blocks
   of the permutation up to r; the block on the boundary is taken cell by cell, a finer part of the hash's range, and
   the cell on the boundary document by document.
3. The taken blocks of a source are its exact quota. A binary tree over the output shards splits the quotas of
   all sources from node to node by a multivariate hypergeometric draw, so each shard gets an equal
   number of blocks, as if they had been dealt out without replacement. Shards then own disjoint runs
   of each source's permuted blocks. Sources beyond QUOTA_GROUPS share the tree in groups of neighbours; each group's
   blocks are then drawn for its sources, shard by shard, in a task of its own.
4. Within a shard, documents are put in the order of a seeded hash.

There may be any number of sources. The driver sees sums, counts of partitions and at most QUOTA_GROUPS quotas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from covermap.llm.common import WORD, keeps_columns, kept

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCKS = 2048
SHARDS = 16
SEED = 17
#: Pieces of a shard that different tasks may shuffle.
PIECES = 1 << 14
#: The tree splits the quotas of at most so many groups of sources.
QUOTA_GROUPS = 4_096
#: Untaken documents of each source and size class that may close the gap to its target.
CANDIDATES = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """[shard, source]: how many of each source's blocks a shard gets; the columns sum to the quotas.

    Each node of the tree holds as many blocks of each source as its shards get together, and draws its left
    half's from them. Shard totals differ by one at most.
    """
    result = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(sum(quotas))
    edges = [total * shard // shards for shard in range(shards + 1)]

    def descend(low: int, high: int, left_over: np.ndarray) -> None:
        if high - low == 1:
            result[low] = left_over
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        take = draw.multivariate_hypergeometric(left_over, edges[middle] - edges[low], method="marginals")
        descend(low, middle, take)
        descend(middle, high, left_over - take)

    descend(0, shards, np.asarray(quotas, dtype=np.int64))
    return result


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, number) from (source, size): all words by repeating weights, at most ``most`` times a source's own.

    Sources are numbered from 0 by code point, null last. What a source cannot give is shared among those below
    their bound, by weight, until none is above.
    """
    # Spark sorts texts by their UTF-8 bytes, as code points sort.
    sorted_by = [F.col("source").isNull(), F.col("source")]
    ranged = kept(totals.select("source", F.col("size").alias("source_size")).repartitionByRange(*sorted_by).withColumn("part", F.spark_partition_id()))
    counts = {row.part: row["count"] for row in ranged.groupBy("part").count().collect()}
    parts = sorted(counts)
    before = totals.sparkSession.createDataFrame(pa.table({
        "part": pa.array(parts, pa.int32()), "before": pa.array(np.cumsum([0, *(counts[part] for part in parts)])[:-1].tolist(), pa.int64())}))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*sorted_by)) - 1
    share = F.element_at(F.array(*[F.lit(weight) for weight in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = kept(ranged.join(F.broadcast(before), "part").withColumn("number", number).withColumn("share", share.cast("bigint")).drop("part", "before"))
    bound = F.col("source_size") * F.lit(most)
    # What a free source gets for each unit of weight. It rises from turn to turn, since bounded sources leave some.
    rest, free, above = None, None, F.lit(False)
    while True:
        sums = sources.agg(F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(above, bound)), F.lit(0)).alias("bounded"),
                           F.coalesce(F.sum(F.when(~above, F.col("share"))), F.lit(0)).alias("free")).first()
        if not sums.free or ((sums.total or 0) - sums.bounded, sums.free) == (rest, free):
            break
        rest, free = sums.total - sums.bounded, sums.free
        given = F.lit(rest).cast("double") * F.col("share") / F.lit(free)
        above = given > bound
    target = F.lit(0.0) if free is None else F.when(above, bound.cast("double")).otherwise(given)
    return kept(sources.select("source", "source_size", target.alias("target"), "number"))


def _ends(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(of, blocks, ends) for each source of (source, number, blocks, quota): where each shard's run of its taken blocks ends."""
    spark = quotas.sparkSession
    sources = quotas.count()
    groups = max(1, min(sources, QUOTA_GROUPS))
    quotas = quotas.withColumn("group", F.floor(F.col("number") * F.lit(groups) / F.lit(max(sources, 1))).cast("int"))
    rows = quotas.groupBy("group").agg(F.sum("quota").alias("quota")).orderBy("group").collect()
    dealt = split_quotas([row.quota for row in rows], shards, seed) if rows else np.zeros((shards, 0), dtype=np.int64)
    dealt = spark.createDataFrame(pa.table({
        "group": pa.array([row.group for row in rows], pa.int32()),
        "dealt": pa.array([dealt[:, i].tolist() for i in range(len(rows))], pa.list_(pa.int64()))}))

    def drawn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        left = group["quota"].to_numpy(dtype=np.int64)
        draw = np.random.default_rng([seed, int(group["group"].iloc[0]), shards])
        taken = np.empty((shards, len(left)), dtype=np.int64)
        for shard, count in enumerate(group["dealt"].iloc[0]):
            taken[shard] = draw.multivariate_hypergeometric(left, count, method="marginals") if len(left) > 1 else count
            left = left - taken[shard]
        return pd.DataFrame({"of": group["source"], "of_blocks": group["blocks"], "ends": list(np.cumsum(taken, axis=0).T)})

    return quotas.join(F.broadcast(dealt), "group").groupBy("group").applyInPandas(drawn, "of string, of_blocks bigint, ends array<bigint>")


def plan_mix(documents: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``documents``: (doc_id, source, place, size, source_size, target, times, shards).

    ``times`` says how often the mix takes the document, ``shards`` to which output shard each time,
    ``place`` is its position in the permutation. Null and empty texts have size 0, and a null source is a source.
    Rows that are equal in id and text share a place; an empty table gives no rows; other columns are not read.
    A source of size 0 has target 0 and is not taken. A text of size 0 is taken MOST_REPEATS times at most, as any other.
    """
    spark = documents.sparkSession
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")))
    sized = kept(documents.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"), place.alias("place"), word_count(F.col("text")).alias("size")))
    # The permutation is the order of the hash; a block is an equal part of the hash's range.
    sized = sized.withColumn("block", F.shiftrightunsigned("place", 40) * F.lit(blocks) / F.lit(1 << 24)) \
                 .withColumn("block", F.floor("block").cast("int"))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("size")))
    by_block = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.min("place").alias("first_place"))
    in_order = Window.partitionBy("source").orderBy("block")
    by_block = (by_block.join(sources, by_block["source"].eqNullSafe(sources["source"])).drop(sources["source"])
                .withColumn("upto", F.sum("block_size").over(in_order)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    by_block = kept(by_block.withColumn("full", full)
                    .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
                    .withColumn("extra", F.when(F.col("upto") <= F.col("rest"), "whole")
                                .when(F.col("upto") - F.col("block_size") < F.col("rest"), "part").otherwise("none"))
                    .withColumn("place_in_source", F.row_number().over(in_order) - 1))
    part = sized.join(by_block.where("extra = 'part'").select(F.col("source").alias("of"), "block", "upto", "block_size", "rest"),
                      sized["source"].eqNullSafe(F.col("of")) & (sized["block"] == by_block["block"])).drop(by_block["block"])
    # Blocks and cells are ranges of the same bits, so a cell lies in one block.
    part = part.select("of", "block", F.shiftrightunsigned("place", 40).alias("cell"), "place", "size", "doc_id",
                       (F.col("rest") - F.col("upto") + F.col("block_size")).alias("left"))
    cells = part.groupBy("of", "block", "cell").agg(F.sum("size").alias("cell_size"), F.first("left").alias("left"))
    cells = cells.withColumn("upto", F.sum("cell_size").over(Window.partitionBy("of", "block").orderBy("cell")))
    # The cell in which the sum passes what is left; there is one, since the block does not fit.
    last = cells.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("cell_size") <= F.col("left"))).select(
        F.col("of").alias("of_last"), F.col("cell").alias("last_cell"), (F.col("left") - F.col("upto") + F.col("cell_size")).alias("left_in_cell"))
    within = part.join(last, part["of"].eqNullSafe(F.col("of_last")) & (F.col("cell") == F.col("last_cell")))
    same_cell = Window.partitionBy("of", "block").orderBy("place", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = within.select("of", "block", "place", F.col("left_in_cell").alias("left"), F.sum("size").over(same_cell).alias("sum"))
    # Up to the last document with which the sum stays below what is left; equal places stand or fall together.
    first_out = within.where(F.col("sum") > F.col("left")).groupBy("of", "block").agg(F.min("place").alias("end_place"))

    by_block = kept(by_block.join(first_out.select(F.col("of"), F.col("block").alias("of_block"), "end_place"),
                                  by_block["source"].eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")), "left").drop("of", "of_block"))
    # A block on the boundary of which no document fits is not taken.
    once_more = (F.col("extra") == "whole") | ((F.col("extra") == "part") & (F.col("end_place") > F.col("first_place")))
    quotas = by_block.groupBy("source", "number").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(F.col("full") + F.when(once_more, 1).otherwise(0)).alias("quota"))
    ends = kept(_ends(kept(quotas), shards, seed))

    info = by_block.join(ends, by_block["source"].eqNullSafe(ends["of"])).select(
        "of", F.col("block").alias("of_block"), "source_size", "target", "full", "extra", "end_place", "place_in_source", F.col("of_blocks").alias("blocks"), "ends")
    taken = sized.join(info, sized["source"].eqNullSafe(F.col("of")) & (sized["block"] == F.col("of_block")))
    more = (F.col("extra") == "whole") | ((F.col("extra") == "part") & (F.col("place") < F.col("end_place")))
    times = (F.col("full") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("int")
    # The block's rank among the source's taken ones decides its shard, pass after pass.
    shard = lambda turn: F.size(F.filter("ends", lambda end: end <= turn.cast("bigint") * F.col("blocks") + F.col("place_in_source")))
    # Texts without words fill no target, so a block of them may be whole at the bound too.
    taken = taken.withColumn("times", F.when(F.col("source_size") > 0, F.least(times, F.lit(MOST_REPEATS))).otherwise(0))
    taken = kept(taken.select(
        "doc_id", "source", "place", "size", "source_size", "target", "full", "times",
        F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), shard)).otherwise(F.array().cast("array<int>")).alias("shards")))

    fill = kept(_fillers(taken))
    filled = taken.join(fill, taken["source"].eqNullSafe(fill["of"]) & (taken["place"] == fill["filler"]), "left")
    once_more = F.col("filler").isNotNull()
    return filled.select(
        "doc_id", "source", "place", "size", "source_size", "target", (F.col("times") + once_more.cast("int")).alias("times"),
        F.when(once_more, F.concat("shards", F.array(F.pmod("place", F.lit(shards)).cast("int")))).otherwise(F.col("shards")).alias("shards"))


def _fillers(taken: DataFrame) -> DataFrame:
    """(of, filler): source and place of the documents that are taken once more to come near the targets.

    From each source and power of two of sizes come at most CANDIDATES untaken documents; the largest that still
    fits is added again and again. So a source has a bounded list of them.
    """
    same = ["source", "place"]
    units = (taken.where((F.col("times") == F.col("full")) & (F.col("size") > 0))
             .groupBy(*same).agg(F.sum("size").alias("size"), F.first("target").alias("target")))
    first = Window.partitionBy("source", "class").orderBy("place")
    candidates = (units.withColumn("class", F.floor(F.log2("size"))).withColumn("row", F.row_number().over(first))
                  .where(F.col("row") <= CANDIDATES).groupBy("source").agg(F.collect_list(F.struct("size", "place")).alias("from")))
    gaps = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("times") * F.col("size"))).alias("gap"))
    rows = gaps.join(candidates, gaps["source"].eqNullSafe(candidates["source"])).select(gaps["source"].alias("of"), "gap", "from")
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("found"))
    fitting = lambda state, one: F.when(
        one["size"] <= state["gap"], F.struct((state["gap"] - one["size"]).alias("gap"), F.concat(state["found"], F.array(one["place"])).alias("found"))).otherwise(state)
    return rows.select("of", F.explode(F.aggregate(F.sort_array("from", asc=False), start, fitting, lambda state: state["found"])).alias("filler"))


@keeps_columns
def mix(documents: DataFrame, plan: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns: each as often as it is taken, dealt to shards and shuffled there.

    A shard that is too large for a task is shuffled in pieces, to which its rows are dealt by hash.
    """
    plan = plan_mix(documents, seed=seed) if plan is None else plan
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")))
    # Rows that share id and place are equal, and are taken alike but for the place of the cut.
    turns = plan.where("times > 0").groupBy("place").agg(F.max("shards").alias("shards"))
    names = documents.columns
    numbered = documents.select(place.alias("_mix_place"), F.struct(*[documents[name] for name in names]).alias("_mix_row"))
    drawn = (numbered.join(turns.select(F.col("place").alias("_mix_place"), "shards"), "_mix_place")
             .select("_mix_row", "_mix_place", F.posexplode("shards").alias("_mix_turn", "_mix_shard")))
    shuffled = (drawn.repartition("_mix_shard", F.pmod("_mix_place", F.lit(PIECES)))
                .sortWithinPartitions("_mix_shard", F.xxhash64(F.lit(seed + 1), "_mix_place", "_mix_turn")))
    return shuffled.select(*[F.col("_mix_row").getField(name).alias(name) for name in names])


def taken_words(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, shards): what the mix takes of each document."""
    return plan_mix(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", "shards")
