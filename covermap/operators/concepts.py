"""Columns to business concepts: ordered keyword rules first, suggestions for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from covermap.plans.checkpointing import keep

RULE, SUGGESTED, UNMATCHED = "rule", "suggested", "unmatched"
#: Portions in which names are asked about where answers outlive a run.
PORTIONS = 32


def match_rules(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """(column, concept): the first rule, in rule order, with a keyword inside the column's name.

    "Contains" becomes an equality: a name contains a keyword exactly when one of its substrings
    is the keyword. So the rules meet the names in an ordinary hash join, whichever side is
    large, and no name is compared with every rule. Each distinct name is matched once.
    """
    keywords = rules.where(F.col("keyword").isNotNull()).groupBy(F.lower("keyword").alias("keyword")).agg(
        F.min_by("concept", "rule_order").alias("concept"), F.min("rule_order").alias("rule_order"))
    longest = keywords.agg(F.max(F.length("keyword"))).scalar()
    names = columns.select("column").distinct().select(
        "column", F.lower("column").alias("name"), longest.alias("longest"))
    substrings = F.expr("""
        array_distinct(flatten(transform(sequence(1, length(name) + 1), start ->
            transform(sequence(0, least(length(name) + 1 - start, longest)), size ->
                substring(name, start, size)))))""")
    pieces = names.select("column", F.explode(substrings).alias("keyword"))
    return pieces.join(keywords, "keyword").groupBy("column").agg(
        F.min_by("concept", "rule_order").alias("concept"))


def _label(text: str) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def suggest(unmatched: DataFrame, guess: Callable[[str, list[str]], str | None],
            parallelism: int | None = None, kept: bool = True, answers: str | None = None, portions: int = PORTIONS) -> DataFrame:
    """(column, concept) from a user function of (name, sample values), asked once per name.

    ``guess`` may call a slow service, so the names are spread over ``parallelism`` tasks (the session's shuffle
    partitions if not given), and the answers are kept in the shared folder, so that no later step asks again.
    ``kept=False`` leaves the answers lazy. ``answers`` is a folder that holds answers from run to run: only names without an
    answer there (no concept is one too) are asked, in ``portions`` by a hash of the name, each written when it is complete. So a
    run that fails half-way, or a later one with more tables, does not ask again what was paid for; the portion under way is.
    """
    tasks = parallelism or int(unmatched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = unmatched.groupBy("column").agg(F.min("sample_values").alias("sample_values"))
    # By a hash of the name: by the name itself the grouping's own partitions would do, and be coalesced to few.
    names = names.repartition(tasks, F.xxhash64("column"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [guess(name, list(values)) for name, values in zip(batch["column"], batch["sample_values"])]
            yield pd.DataFrame({"column": batch["column"], "concept": pd.Series(answers, dtype="object")})

    asked = "column string, concept string"
    if answers is None:
        answered = names.mapInPandas(ask, asked)
        return keep(answered) if kept else answered
    spark = unmatched.sparkSession
    names = keep(names)
    known = spark.read.schema(asked).parquet(answers).select("column") if _is_folder(spark, answers) else spark.createDataFrame([], "column string")
    # Kept, since the folder that they are read from is written to.
    missing = keep(names.join(known, "column", "left_anti").withColumn("portion", F.pmod(F.xxhash64("column"), F.lit(portions))))
    for row in missing.select("portion").distinct().sort("portion").collect():
        own = missing.where(F.col("portion") == row.portion).drop("portion").repartition(tasks, F.xxhash64("column"))
        own.mapInPandas(ask, asked).write.mode("append").parquet(answers)
    if not _is_folder(spark, answers):
        return spark.createDataFrame([], asked)
    return spark.read.schema(asked).parquet(answers).join(names.select("column"), "column", "left_semi")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def map_concepts(profile: DataFrame, rules: DataFrame, suggestions: DataFrame | None = None,
                 restrict_to_vocabulary: bool = False) -> DataFrame:
    """Append ``business_concept`` and ``matched_by`` to a profile or column listing.

    ``suggestions`` (column, concept) fill only columns without a rule, one per column name: the
    alphabetically first where several are given. ``restrict_to_vocabulary`` drops suggestions
    that are no concept of the rules.
    """
    by_rule = match_rules(profile, rules).withColumnRenamed("concept", "rule_concept")
    mapped = profile.join(by_rule, "column", "left")
    suggestion = F.lit(None).cast("string")
    if suggestions is not None:
        offered = suggestions.groupBy("column").agg(F.min(_label("concept")).alias("suggestion"))
        if restrict_to_vocabulary:
            vocabulary = rules.select(F.col("concept").alias("suggestion")).distinct()
            offered = offered.join(vocabulary, "suggestion", "left_semi")
        mapped = mapped.join(offered, "column", "left")
        suggestion = F.col("suggestion")
    return mapped.select(
        *[F.col(f"`{name}`") for name in profile.columns],
        F.coalesce("rule_concept", suggestion).alias("business_concept"),
        F.when(F.col("rule_concept").isNotNull(), RULE)
        .when(suggestion.isNotNull(), SUGGESTED).otherwise(UNMATCHED).alias("matched_by"),
    )


def unmatched_columns(concept_map: DataFrame) -> DataFrame:
    """The columns still without a concept: what ``suggest`` should be asked about."""
    return concept_map.where(F.col("matched_by") == UNMATCHED)


def available_concepts(concept_map: DataFrame, scope: str | None = None) -> DataFrame:
    """The concepts at hand, one row each, overall or per value of the ``scope`` column.

    For a profiled map each carries its evidence: how many columns supply it, and the lowest
    null ratio among them.
    """
    concept = F.col("business_concept").alias("concept")
    keys = [concept] if scope is None else [F.col(scope), concept]
    evidence = [F.count(F.lit(1)).alias("columns")]
    if "null_ratio" in concept_map.columns:
        evidence.append(F.min("null_ratio").alias("null_ratio"))
    return concept_map.where(F.col("business_concept").isNotNull()).groupBy(*keys).agg(*evidence)
