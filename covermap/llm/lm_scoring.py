"""Scores of documents by a gated recurrent language model over words.

1. All words of the documents that may be learnt from are counted. The commonest make a dictionary of bounded size.
2. The commonest of these have classes of their own with a softmax over the class's words. Every other word belongs to
   a class by its ending; within it, it has the add-one share of its count, and one unseen word is allowed for.
3. The recurrent weights are trained by truncated backpropagation over all documents that may be learnt from, each once.
   A round takes a part of them, chosen by hash: each task trains on its shard, and the weights are averaged.
4. Every document is read whole, its state carried from window to window. Words outside the dictionary meet their
   counts in a join, and their shares are added to the document's score.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from covermap.llm.common import kept, remainder, slices
from covermap.llm.gru import CLASS_WORDS, Gru, Vocabulary, new_weights

#: The dictionary holds at most so many words, none longer than LONGEST bytes.
DICTIONARY = 1 << 18
LONGEST = 64
HEAD_CLASSES = 32
TAIL_CLASSES = 32
#: Documents that one task trains on in a round, about.
SHARD_DOCUMENTS = 2_000
#: Each round trains on one part in ROUNDS of the documents.
ROUNDS = 4
#: So many tasks' weights are averaged by one task, again and again until as few are left for the driver.
AVERAGED = 32
#: Texts laid side by side in lanes, in bytes.
LANE_BYTES = 12 << 20

_FINE = 64  # steps of the counts' logarithm in the search for the dictionary's least count


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL_CLASSES


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n, ending): how often each word occurs in all the texts, and its tail class."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for text in texts:
                    counts.update(words_of(text))
                if len(counts) > 400_000:
                    yield from flush(counts)
                    counts = Counter()
        yield from flush(counts)

    def flush(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([counts[word] for word in part], pa.int64()),
                 pa.array([tail_class(word) for word in part], pa.int32())], names=["word", "n", "ending"])

    rows = documents.select(F.col("text").cast("string")).mapInArrow(counted, "word binary, n bigint, ending int")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = DICTIONARY) -> list[tuple[bytes, int]]:
    """The commonest words with their counts, commonest first: all above a count that at most ``most`` words reach."""
    short = counts.where(F.length("word") <= LONGEST)
    level = F.floor(F.log2("n") * _FINE).cast("int")
    levels = sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True)
    least, reached = None, 0
    for row in levels:
        reached += row["count"]
        if reached > most:
            break
        least = row.level
    if least is None:
        return []
    rows = short.where(level >= least).select("word", "n").toPandas()
    return sorted(zip(map(bytes, rows["word"]), rows["n"].tolist()), key=lambda pair: (-pair[1], pair[0]))


class Lexicon:
    """Token ids: 0 the end of a document, then the dictionary's words, then one for the other words of each tail class."""

    def __init__(self, words: list[tuple[bytes, int]], trained: int, tail_counts: np.ndarray, tail_words: np.ndarray):
        self.ids = {word: number + 1 for number, (word, _) in enumerate(words)}
        self.others = len(words) + 1
        size = self.others + TAIL_CLASSES
        head = min(self.others, HEAD_CLASSES * CLASS_WORDS) if trained else 0
        self.counts = np.zeros(size, dtype=np.int64)
        self.counts[0] = trained
        self.counts[1 : self.others] = [n for _, n in words]
        endings = np.array([tail_class(word) for word, _ in words], dtype=np.int32)
        classes = np.empty(size, dtype=np.int32)
        classes[: self.others] = HEAD_CLASSES + np.concatenate([[0], endings])
        classes[self.others :] = HEAD_CLASSES + np.arange(TAIL_CLASSES)
        classes[:head] = np.arange(head) // CLASS_WORDS
        places = np.full(size, -1, dtype=np.int32)
        places[:head] = np.arange(head) % CLASS_WORDS
        inputs = np.where(places >= 0, np.arange(size), HEAD_CLASSES * CLASS_WORDS + classes - HEAD_CLASSES).astype(np.int32)
        self.vocabulary = Vocabulary(classes, places, inputs, HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES,
                                     HEAD_CLASSES * CLASS_WORDS + TAIL_CLASSES + 1)
        self.head = head
        # What is left to the tail classes: all words but the head's.
        in_head = np.bincount(endings[: max(0, head - 1)], weights=self.counts[1:head], minlength=TAIL_CLASSES)
        self.tail_counts = tail_counts - in_head
        self.tail_words = tail_words - np.bincount(endings[: max(0, head - 1)], minlength=TAIL_CLASSES)
        shared = -np.log10(self.tail_counts + self.tail_words + 1)
        # Of a tail token's share, the part that is known without a join.
        self.fixed = np.zeros(size)
        tail = places < 0
        self.fixed[tail] = shared[classes[tail] - HEAD_CLASSES]
        self.logs = np.log10(self.counts + 1.0)
        self.fixed[: self.others][tail[: self.others]] += self.logs[: self.others][tail[: self.others]]

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the classes among all tokens, and of the words in each head class."""
        by_class = np.zeros(HEAD_CLASSES + TAIL_CLASSES)
        words = np.zeros((HEAD_CLASSES, CLASS_WORDS))
        words.ravel()[: self.head] = self.counts[: self.head]
        by_class[:HEAD_CLASSES] = words.sum(axis=1)
        by_class[HEAD_CLASSES:] = self.tail_counts
        return by_class / max(by_class.sum(), 1), words / np.maximum(words.sum(axis=1, keepdims=True), 1)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The token ids of a text, with the end; and its words that the dictionary lacks."""
        found = list(map(self.ids.get, words))
        missing: list[bytes] = []
        if None in found:
            for place, number in enumerate(found):
                if number is None:
                    missing.append(words[place])
                    found[place] = self.others + tail_class(words[place])
        found.append(0)
        return np.array(found, dtype=np.int32), missing


def _trained(documents: DataFrame, lexicon: Lexicon, trained: int) -> dict[str, np.ndarray]:
    """Weights averaged over the tasks after each round. Only weights, of fixed size, pass through the driver."""
    spark = documents.sparkSession
    weights = new_weights(lexicon.vocabulary, *lexicon.shares())
    if not trained:
        return weights
    part = F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(ROUNDS))
    shards = max(1, round(trained / ROUNDS / SHARD_DOCUMENTS))
    shared = spark.sparkContext.broadcast(lexicon)
    names, shapes = list(weights), {name: w.shape for name, w in weights.items()}

    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast({name: w.astype(np.float32) for name, w in weights.items()})

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            documents = [shared.value.tokens(words_of(text))[0] for batch in batches for _, texts in slices(batch.column(0)) for text in texts]
            if documents:
                model = Gru(shared.value.vocabulary, {name: w.copy() for name, w in start.value.items()})
                model.train(documents)
                flat = np.concatenate([model.weights[name].ravel() for name in names])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(sum(map(len, documents)))]), pa.array([flat.astype("<f4").tobytes()], pa.binary())], names=["tokens", "weights"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = None, 0.0
            for batch in batches:
                for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = n * np.frombuffer(raw, dtype="<f4").astype(np.float64)
                    total, tokens = part if total is None else total + part, tokens + n
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens]), pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary())], names=["tokens", "weights"])

        rows = documents.where(part == turn).select(F.col("text").cast("string")).repartition(shards).mapInArrow(train, "tokens double, weights binary")
        left = shards
        while left > AVERAGED:
            left = -(-left // AVERAGED)
            rows = rows.repartition(left).mapInArrow(average, "tokens double, weights binary")
        rows = rows.collect()
        if not rows:
            continue
        total = sum(row.tokens for row in rows)
        flat = sum((row.tokens / total) * np.frombuffer(bytes(row.weights), dtype="<f4").astype(np.float64) for row in rows)
        edges = np.cumsum([0] + [int(np.prod(shapes[name])) for name in names])
        weights = {name: flat[a:b].reshape(shapes[name]).astype(np.float32) for name, a, b in zip(names, edges, edges[1:])}
    return weights


def score_texts(documents: DataFrame, learn_from: Column) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``documents``.

    ``learn_from`` says which rows are learnt from. Scores are log10 probabilities of all tokens of the text and of
    its end; a null or empty text is its end alone. Without rows to learn from, counts are 0 and the classes' odds are
    even. Rows that share id and text get the same scores; other columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), learn_from.alias("learnt"))
    training = rows.where("learnt")
    trained = training.count()
    counts = kept(count_words(training))
    by_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    tail_counts, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for row in by_ending:
        tail_counts[row.ending], tail_words[row.ending] = row.n, row.words
    train_tokens = int(tail_counts.sum()) + trained
    lexicon = Lexicon(common_words(counts), trained, tail_counts, tail_words)
    unseen = float(np.log10(train_tokens + tail_words.sum() + (trained > 0) + 1))
    weights = _trained(training, lexicon, trained)
    shared, model_weights = spark.sparkContext.broadcast(lexicon), spark.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        model = Gru(lexicon.vocabulary, model_weights.value)
        for batch in batches:
            for start, texts in slices(batch.column(1), LANE_BYTES):
                tokens, others, digests = [], [], []
                for text in texts:
                    ids, missing = lexicon.tokens(words_of(text))
                    tokens.append(ids)
                    others.append(list(Counter(missing).items()))
                    digests.append(hashlib.md5(text).digest())
                lengths = np.array([len(ids) for ids in tokens], dtype=np.int64)
                flat, edges = np.concatenate(tokens), np.concatenate([[0], np.cumsum(lengths)[:-1]])
                known = np.add.reduceat((lexicon.counts[flat] > 0).astype(np.int64), edges)
                base = np.add.reduceat(lexicon.logs[flat], edges) - lengths * unseen
                own = model.log_probabilities(tokens) / log(10) + np.add.reduceat(lexicon.fixed[flat], edges)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), part.column(2), pa.array(lengths), pa.array(known), pa.array(base), pa.array(own),
                     pa.array(others, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))], names=names)

    names = ["doc_id", "digest", "learnt", "n_tokens", "n_known", "base_score", "score", "others"]
    first = kept(rows.mapInArrow(scored, "doc_id bigint, digest binary, learnt boolean, n_tokens bigint, n_known bigint, "
                                         "base_score double, score double, others array<struct<word: binary, times: bigint>>"))
    # Equal texts have equal words, so the sums of a digest are those of one text times its copies.
    words = first.select("digest", F.explode("others").alias("other")).select("digest", "other.word", "other.times")
    met = words.join(counts.select("word", "n"), "word").select("digest", "times", F.log10(F.col("n") + F.lit(1.0)).alias("log"))
    sums = met.groupBy("digest").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.col("log")).alias("more"))
    copies = first.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    sums = sums.join(copies, "digest").select(
        "digest", (F.col("more_known") / F.col("copies")).cast("bigint").alias("more_known"), (F.col("more") / F.col("copies")).alias("more"))
    return first.drop("others").join(sums, "digest", "left").na.fill({"more_known": 0, "more": 0.0}).select(
        "doc_id", "learnt", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.col("more")).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"))


def scored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held out are ids with crc32 modulo 7 equal to 2."""
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = score_texts(documents, ~held_out)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
