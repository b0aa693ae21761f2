"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

The labelled rows that may be learnt from are split by hash into three: the first give the learnt part of the lexicon
(words far commoner in toxic documents), the second train the trees, the third calibrate the scores. Features are
densities of both lexicons, also after undoing disguises, how near they stand to second-person words,
capitals, punctuation and rates of disguised words. The text alone is read for a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from covermap.llm.common import keeps_columns, kept, remainder, slices

#: Plain insults, in alphabetical order; what else marks toxic documents is learnt.
LEXICON = (
    "bastard", "bitch", "clown", "crap", "damn", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "idiots", "imbecile",
    "jerk", "kill", "liar", "loser", "losers", "moron", "morons", "pathetic", "pig", "rubbish", "scum", "shit", "stupid", "trash",
    "ugly", "useless", "vermin", "worthless",
)
SECOND_PERSON = (
    "dein", "dich", "dir", "du", "euch", "ihr", "te", "ti", "toi", "ton", "tu", "tú", "u", "ur", "usted", "ustedes", "vos", "votre",
    "vous", "you", "your", "you're", "youre", "yours", "yourself",
)
#: At most about so many labelled rows, chosen by hash, are learnt from; fewer are all used.
TRAINING_ROWS = 30_000
LEARNT_WORDS = 200
NEAR_WORDS = 6
THRESHOLD = 0.7
TREES = 10
DEPTH = 3
#: No leaf may follow fewer rows than this, so that single wrong labels are not learnt.
LEAST_ROWS = 6

_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_JOINERS = b"*._-'~"
_DISGUISES = bytes.maketrans(b"013457@$!|" + _CAPITALS, b"oieastasii" + _SMALL)
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
_PLAIN = bytes.maketrans(_CAPITALS + _PUNCTUATION, _SMALL + b" " * len(_PUNCTUATION))
# Kinds of bytes: 0 other, 1 capital, 2 small, 3 digit, 4 ! or ?, 5 other punctuation, 6 space, 7 line end, 8 beyond ASCII.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[list(_CAPITALS)], _KINDS[list(_SMALL)], _KINDS[48:58] = 1, 2, 3
_KINDS[list(_PUNCTUATION) + [39]] = 5
_KINDS[list(b"!?")], _KINDS[32], _KINDS[list(b"\n\r")], _KINDS[128:] = 4, 6, 7, 8
FEATURES = (
    "fixed_density", "learnt_density", "log_fixed", "log_learnt", "distinct_hits", "densest_run", "disguised_hits",
    "log_disguised", "near_second_person", "near_density", "second_person_rate", "capital_rate", "capital_pairs", "exclamation_rate",
    "punctuation_rate", "digit_rate", "symbol_runs", "disguise_rate",
)


def plain_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased and punctuation taken for space."""
    return text.translate(_PLAIN).split()


def features(text: bytes, fixed: frozenset[bytes], learnt: frozenset[bytes]) -> list[float]:
    """The FEATURES of one whole text; all zero for an empty one."""
    words = plain_words(text)
    if not words:
        return [0.0] * len(FEATURES)
    second = _SECOND
    marked = [(place, word) for place, word in enumerate(words) if word in fixed or word in learnt or word in second]
    hits = [place for place, word in marked if word in fixed or word in learnt]
    n_fixed = sum(word in fixed for _, word in marked)
    n_learnt = sum(word in learnt for _, word in marked)
    pronouns = [place for place, word in marked if word in second]
    near = 0
    if hits and pronouns:
        at = np.searchsorted(pronouns, hits)
        padded = np.concatenate([[-1e9], pronouns, [1e9]])
        near = int((np.minimum(np.array(hits) - padded[at], padded[at + 1] - np.array(hits)) <= NEAR_WORDS).sum())
    densest = int((np.searchsorted(hits, np.array(hits) + 50) - np.arange(len(hits))).max()) if hits else 0
    folded = text.translate(_DISGUISES, _JOINERS).translate(_PLAIN).split()
    disguised = max(0, sum(word in fixed for word in folded) - n_fixed)
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = _KINDS[data]
    counts = np.bincount(kinds, minlength=9)
    letter, odd = (kinds == 1) | (kinds == 2), (kinds >= 3) & (kinds <= 5)
    inner = int((letter[:-2] & odd[1:-1] & letter[2:]).sum()) if len(data) > 2 else 0
    n, size = len(words), len(data)
    return [
        n_fixed / n, n_learnt / n, np.log1p(n_fixed), np.log1p(n_learnt), float(len({words[place] for place in hits})),
        float(densest), disguised / n, np.log1p(disguised), float(near), near / n, len(pronouns) / n, counts[1] / size,
        float(((kinds[:-1] == 1) & (kinds[1:] == 1)).sum()) / size, counts[4] / size, counts[5] / size, counts[3] / size,
        float((odd[:-1] & odd[1:]).sum()) / size, inner / n,
    ]


_SECOND = frozenset(word.encode() for word in SECOND_PERSON)


def _learn_words(sample: DataFrame, words: int = LEARNT_WORDS) -> list[str]:
    """Words of toxic documents, the most telling first: by smoothed log odds of the shares of documents they occur in."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for start, texts in slices(batch.column(0)):
                for label, text in zip(labels[start:], texts):
                    counts[label].update(set(plain_words(text)))
                    counts[label][b""] += 1
        names = list(counts[0].keys() | counts[1].keys())
        for start in range(0, len(names), 50_000):
            part = names[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), *[pa.array([counts[i][name] for name in part], pa.int64()) for i in (0, 1)]], names=["word", "clean", "toxic"])

    found = kept(sample.select(F.col("text").cast("string"), "label").mapInArrow(counted, "word binary, clean bigint, toxic bigint")
                 .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    totals = found.where(F.length("word") == 0).first()
    if totals is None or not totals.clean or not totals.toxic:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (totals.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (totals.clean + 1.0))
    deviation = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = found.where((F.length("word") > 1) & (F.col("toxic") >= 3) & (odds / deviation > 3.5) & (odds > 2))
    return [bytes(row.word) for row in telling.orderBy((odds / deviation).desc(), "word").limit(words).collect()]


def _with_features(documents: DataFrame, learnt: list[bytes], columns: list[Column]) -> DataFrame:
    """The given columns and ``features`` of each document."""
    fixed, more = frozenset(word.encode() for word in LEXICON), frozenset(learnt)
    rows = documents.select(F.col("text").cast("string").alias("text"), *columns)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(0)):
                values = pa.array([features(text, fixed, more) for text in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns[1:], values], schema=out)

    schema = rows.drop("text").schema.add("features", T.ArrayType(T.DoubleType()))
    out = to_arrow_schema(schema)
    return rows.mapInArrow(described, schema)


def score_documents(documents: DataFrame, labels: DataFrame, learn_from: Column, columns: list[Column],
                    training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The given columns of each document, with ``score``: the calibrated probability that its label is 1.

    ``labels`` are (doc_id, toxic); rows where toxic is null or not 0 or 1, and documents with several labels that
    differ, are not learnt from. ``learn_from`` says by doc_id which rows may be. Null and empty texts get the score of
    all-zero features. Without both classes every score is the share of label 1 (0 without labels). Repeated rows
    are scored alike; an empty table gives no rows.
    """
    marked = (labels.where(F.col("toxic").isin(0, 1) & learn_from).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
              .agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").cast("int").alias("most"))
              .where(F.col("label") == F.col("most")).drop("most"))
    marked = kept(marked)
    share = min(1.0, training_rows / max(1, marked.count()))
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20))
    # The bound of the sample also bounds what is broadcast.
    chosen = marked.where(part < (int(share * (1 << 20)) if share < 1 else 1 << 20)).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(8)))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    learnt = _learn_words(texts.where("part < 2"))
    all_rows = _with_features(documents, learnt, columns)
    training = _with_features(texts.where("part >= 2"), learnt, [F.col("part"), F.col("label").cast("double").alias("label")])
    training = kept(training.repartition(6)).withColumn("features", array_to_vector("features"))
    trees, held = training.where("part < 6"), training.where("part >= 6")
    counts = {row.label: row["count"] for row in trees.groupBy("label").count().collect()}
    if len(counts) < 2:
        return all_rows.drop("features").withColumn("score", F.lit(float(next(iter(counts), 0.0))))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, seed=5).fit(trees)
    raw = vector_to_array("probability")[1].alias("raw")
    held_rows = model.transform(held).select("label", raw)
    scored = model.transform(all_rows.withColumn("features", array_to_vector("features"))).withColumn("raw", raw).drop(
        "features", "rawPrediction", "probability", "prediction")
    if not held.limit(1).count():
        return scored.withColumnRenamed("raw", "score")
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held_rows)
    return curve.transform(scored).drop("raw").withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")))


def toxic_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row; learnt only from ids whose crc32 modulo 3 is not 1."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    scored = score_documents(documents, labels, ~held_out, [F.col("doc_id").cast("bigint").alias("doc_id")])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@keeps_columns
def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below the threshold."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    row = F.struct(*[documents[name] for name in documents.columns]).alias("row")
    scored = score_documents(documents, labels, ~held_out, [row])
    return scored.where(F.col("score") < THRESHOLD).select("row.*")
