"""URL filters: the longest fitting rule decides, and gradient-boosted trees decide the rest.

The trees see lexical features only: lengths, depth, shares of digits and signs, entropies, numbers of
parameters, and statistics of the host's suffix. They are trained from labelled URLs; where none are given, those
that a rule decides are the labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from covermap.llm.common import kept

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: About so many labelled URLs, chosen by hash, train the trees; fewer are all used.
TRAINING_ROWS = 20_000
TREES = 12
DEPTH = 4

_SIGNS = r"[^A-Za-z0-9]"


def url_parts(url: Column) -> dict[str, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "host": F.translate(host, capitals, small),
        "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1),
    }


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule's host covers its subdomains."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda rule: (len(rule[0] + rule[1]), rule)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character by the frequencies within the text; 0 for an empty one."""
    characters = F.split(text, "")
    counts = F.transform(F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)).cast("double"))
    weighted = F.aggregate(counts, F.lit(0.0), lambda total, n: total + n * F.log2(n))
    return F.when(F.length(text) > 0, F.log2(F.length(text).cast("double")) - weighted / F.length(text)).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical_features(url: Column, host: Column, path: Column, query: Column, fragment: Column) -> dict[str, Column]:
    shape = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "query_length": F.length(query), "fragment_length": F.length(fragment),
        "depth": F.regexp_count(path, F.lit("/+[^/]")), "host_labels": F.regexp_count(host, F.lit(r"[^.]+")),
        "parameters": F.regexp_count(query, F.lit(r"[^&;]+")), "escapes": F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}")),
        "secure": url.startswith("https://").cast("int"), "slash_end": path.endswith("/").cast("int"),
        "dotted_end": F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), 1).otherwise(0),
        "first_part": F.length(F.regexp_extract(path, "^/([^/]*)", 1)),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit(r"\d+"), F.lit(0)), F.length)), F.lit(0)),
        "hyphens": F.regexp_count(host, F.lit("-")),
    }
    rates = {
        "digit_ratio": _share(url, "[0-9]"), "host_digit_ratio": _share(host, "[0-9]"), "path_digit_ratio": _share(path, "[0-9]"),
        "sign_ratio": _share(url, _SIGNS), "vowel_ratio": _share(host, "[aeiou]"), "capital_ratio": _share(path, "[A-Z]"),
        "url_entropy": entropy(url), "host_entropy": entropy(host), "path_entropy": entropy(path),
    }
    return {name: F.coalesce(column.cast("double"), F.lit(0.0)) for name, column in (shape | rates).items()}


def _with_features(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """The URLs with their parts, suffixes and features; and the features' names."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = url_parts(F.col("url"))
    frame = urls.withColumns({name: F.coalesce(column, F.lit("")) for name, column in parts.items()})
    features = lexical_features(url, *[F.col(name) for name in parts])
    suffix = {"suffix1": F.element_at(F.split("host", r"\."), -1),
              "suffix2": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0), "first_segment": F.regexp_extract("path", "^/[^/]*", 0)}
    return frame.withColumns(features).withColumns(suffix), list(features)


def _suffix_statistics(frame: DataFrame, key: str) -> DataFrame:
    """For each suffix, how often it occurs and how its labelled URLs were judged (smoothed); over all rows."""
    labelled, allowed = F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))
    return frame.groupBy(key).agg(F.log1p(F.count(F.lit(1))).alias(f"{key}_rows"), ((allowed + 5) / (labelled + 10)).alias(f"{key}_allowed"))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
               training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages``.

    ``labels`` are (url, allowed 0/1); without them, the rules' verdicts are the labels. score is the trees'
    probability of allow. A null or malformed URL has empty parts, fits no rule and is judged by the trees.
    Where the labels hold fewer than two classes, the trees are replaced by the only class, or allow.
    Repeated rows are judged alike; other columns are not read.
    """
    urls = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"))
    if labels is not None:
        marked = labels.groupBy(F.col("url").alias("labelled_url")).agg(F.max(F.col("allowed").cast("double")).alias("label"))
        urls = urls.join(marked, F.col("url") == F.col("labelled_url"), "left").drop("labelled_url")
    frame, names = _with_features(urls)
    frame = frame.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        frame = frame.withColumn("label", (F.col("found.verdict") == "allow").cast("double"))
    frame = kept(frame)
    for key in ("suffix1", "suffix2", "first_segment"):
        frame = frame.join(_suffix_statistics(frame, key), key)
        names += [f"{key}_rows", f"{key}_allowed"]
    features = VectorAssembler(inputCols=names, outputCol="features").transform(frame)

    counts = {row.label: row["count"] for row in frame.where("label is not null").groupBy("label").count().collect()}
    if len(counts) < 2:
        scored = features.withColumn("score", F.lit(next(iter(counts), 1.0)))
    else:
        share = min(1.0, training_rows / sum(counts.values()))
        chosen = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
        training = kept(features.where(F.col("label").isNotNull() & chosen).select("features", "label").repartition(4))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(training)
        scored = model.transform(features).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
