"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into pieces of at most PIECE_WORDS words; in scripts without spaces a character is a word. The
   words' document frequencies are counted over all documents.
2. A randomised singular value decomposition of the pieces' TF-IDF matrix, computed by distributed passes over its rows,
   gives each word a place in a latent space of a dimension for each piece, at most RANK in a block of items.
3. Every document is read whole, as passages of PASSAGE_WORDS words that start every STRIDE words. A passage's latent vector
   is compared with those of all pieces of a block of items by cosine (a stated query set against all rows, in
   blocks). Passages too poor in benchmark words to reach the cosine are passed over, which loses none.
4. Candidates are checked word by word: by the longest common subsequence of the piece and the passage's
   surroundings, and by the piece's answer, its most telling late words. So passages with changed, added or
   left out words are found, and passages on the same subject are not.
5. Items of fewer than SHORT_PIECE words are looked for as they are, word after word.

Blocks are indexed and searched BLOCKS_PER_PASS at a time, so that the documents are read twice for all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from covermap.llm.common import keeps_columns, slices

PIECE_WORDS = 64
PASSAGE_WORDS = 32
STRIDE = 16
#: Pieces in a block of items, each with a dimension of its own: with fewer dimensions than pieces, whole passages would be missed.
RANK = 256
OVERSAMPLING = 8
#: Items in a block, and blocks in one pass over the documents; they bound what is broadcast.
ITEMS_PER_BLOCK = 500
BLOCKS_PER_PASS = 8
LEAST_COSINE = 0.35
#: The share of a piece's words that must stand in the document in order: alone, or where the answer is there too.
LEAST_COMMON = 0.75
LEAST_COMMON_WITH_ANSWER = 0.6
LEAST_ANSWER = 0.75
ANSWER_WORDS = 4
#: Items of fewer words must be there entirely, one word after the other; one or two words say too little to be told from clean text.
SHORT_PIECE = 8
LEAST_WORDS = 3

_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
_PLAIN = bytes.maketrans(_CAPITALS + _PUNCTUATION, _SMALL + b" " * len(_PUNCTUATION))
#: UTF-8 of the punctuation of scripts without spaces, and of their characters: ideographs, kana, Thai, Lao, Myanmar, Khmer.
_MARKS = re.compile(rb"\xe3\x80[\x80-\x84\x87-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
_UNSPACED = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")


def plain_words(text: bytes) -> list[bytes]:
    """Runs between white space and ASCII punctuation, A-Z lower-cased; each character of a script without spaces is a word."""
    text = text.translate(_PLAIN)
    if not text.isascii():
        text = _UNSPACED.sub(rb" \g<0> ", _MARKS.sub(b" ", text))
    return text.split()


@dataclass
class Pieces:
    """A block of benchmark items: their pieces, vocabulary and latent vectors."""

    item_ids: list
    words: list[list[bytes]]
    vocabulary: dict[bytes, int]
    short: list[tuple[object, list[bytes]]]  # (item, words) of items below SHORT_PIECE words, which have no place in the space
    short_by_word: dict[bytes, list[tuple[object, list[bytes], int]]] | None = None  # by their rarest word: (item, words, its place)
    idf: np.ndarray | None = None  # of the vocabulary's words, and last of all others
    vectors: np.ndarray | None = None  # [word, dimension], with the idf in them
    latent: np.ndarray | None = None  # [piece, dimension], of length 1 in the full space
    most: np.ndarray | None = None  # the most that a word can add to the product with any piece

    def answer(self, piece: int) -> list[bytes]:
        """The rarest different words of the piece's later half, at most ANSWER_WORDS."""
        words = self.words[piece]
        late = sorted(set(words[len(words) // 2 :]), key=lambda word: (-self.idf[self.vocabulary[word]], word))
        return late[:ANSWER_WORDS]


def pieces_of(items: list[tuple[object, bytes]]) -> Pieces:
    ids, pieces, short = [], [], []
    for item_id, text in items:
        words = plain_words(text)
        if len(words) < SHORT_PIECE:
            if len(words) >= LEAST_WORDS:
                short.append((item_id, words))
            continue
        count = max(1, -(-len(words) // PIECE_WORDS))
        for number in range(count):
            ids.append(item_id)
            pieces.append(words[len(words) * number // count : len(words) * (number + 1) // count])
    every = {word for piece in pieces for word in piece} | {word for _, words in short for word in words}
    return Pieces(ids, pieces, {word: number for number, word in enumerate(sorted(every))}, short)


def _document_frequencies(documents: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and how many documents there are."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, rows = shared.value.keys(), Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for _, texts in slices(batch.column(0)):
                for text in texts:
                    found.update(known & set(plain_words(text)))
        numbers = [shared.value[word] for word in found] + [-1]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([*found.values(), rows], pa.int64())], names=["word", "n"])

    frequencies, total = np.zeros(len(vocabulary)), 0
    rows = documents.select(F.col("text").cast("string")).mapInArrow(counted, "word int, n bigint")
    for row in rows.groupBy("word").agg(F.sum("n").alias("n")).collect():
        if row.word < 0:
            total = row.n
        else:
            frequencies[row.word] = row.n
    return frequencies, total


def _row_products(matrix: DataFrame, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A'(AR) and (AR)'(AR) for the sparse rows of ``matrix`` (words, weights), summed over its partitions."""
    shared = matrix.sparkSession.sparkContext.broadcast(right.astype(np.float32))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        back, inner = np.zeros(right.shape), np.zeros((right.shape[1], right.shape[1]))
        for batch in batches:
            for words, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = np.array(weights)
                row = weights @ right[words]
                back[words] += np.outer(weights, row)
                inner += np.outer(row, row)
        yield pa.RecordBatch.from_arrays([pa.array([back.astype("<f8").tobytes()], pa.binary()), pa.array([inner.astype("<f8").tobytes()], pa.binary())],
                                         names=["back", "inner"])

    back, inner = np.zeros(right.shape), np.zeros((right.shape[1], right.shape[1]))
    for row in matrix.mapInArrow(multiplied, "back binary, inner binary").toLocalIterator():
        back += np.frombuffer(bytes(row.back)).reshape(back.shape)
        inner += np.frombuffer(bytes(row.inner)).reshape(inner.shape)
    return back, inner


def randomised_svd(matrix: DataFrame, columns: int, rank: int, seed: int = 23) -> np.ndarray:
    """[column, rank]: the leading right singular vectors of sparse rows, by a Gaussian start and two power steps."""
    width = min(columns, rank + OVERSAMPLING)
    basis = np.random.default_rng(seed).normal(size=(columns, width))
    for _ in range(2):
        basis, _ = np.linalg.qr(_row_products(matrix, basis)[0])
    _, inner = _row_products(matrix, basis)
    values, rotation = np.linalg.eigh(inner)
    order = np.argsort(-values)[:rank]
    return basis @ rotation[:, order]


def _index(documents: DataFrame, blocks: list[Pieces]) -> list[Pieces]:
    """The blocks with frequencies, counted in one pass for all of them, and latent vectors of a dimension for each piece."""
    every = {word: number for number, word in enumerate(sorted({word for pieces in blocks for word in pieces.vocabulary}))}
    frequencies, total = _document_frequencies(documents, every)
    for pieces in blocks:
        own = frequencies[[every[word] for word in pieces.vocabulary]]
        pieces.idf = np.log((total + 1) / (own + 1)) + 1
        pieces.idf = np.append(pieces.idf, pieces.idf.mean())
        pieces.short_by_word = {}
        for item, words in pieces.short:
            place = max(range(len(words)), key=lambda place: pieces.idf[pieces.vocabulary[words[place]]])
            pieces.short_by_word.setdefault(words[place], []).append((item, words, place))
        if pieces.words:
            _place(documents.sparkSession, pieces)
    return blocks


def _place(spark, pieces: Pieces) -> None:
    rows = []
    for words in pieces.words:
        counts = sorted(Counter(pieces.vocabulary[word] for word in words).items())
        weights = np.array([n for _, n in counts]) * pieces.idf[[word for word, _ in counts]]
        rows.append(([word for word, _ in counts], (weights / np.linalg.norm(weights)).tolist()))
    matrix = spark.createDataFrame(pa.table({
        "words": pa.array([words for words, _ in rows], pa.list_(pa.int32())), "weights": pa.array([w for _, w in rows], pa.list_(pa.float64()))})).repartition(4)
    vectors = randomised_svd(matrix, len(pieces.vocabulary), len(rows))
    pieces.latent = np.array([np.array(weights) @ vectors[words] for words, weights in rows], dtype=np.float32)
    # One row of zeros stands for all words outside the vocabulary.
    pieces.vectors = np.vstack([vectors * pieces.idf[:-1, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    pieces.most = np.concatenate([(part @ pieces.latent.T).max(axis=1, initial=0) for part in np.array_split(pieces.vectors, len(pieces.vectors) // 1024 + 1)])


def common_subsequence(piece: list[bytes], words: list[bytes]) -> int:
    """The length of the longest common subsequence, a bit for each of the piece's words."""
    masks: dict[bytes, int] = {}
    for place, word in enumerate(piece):
        masks[word] = masks.get(word, 0) | (1 << place)
    full = (1 << len(piece)) - 1
    row = full
    for word in words:
        matches = row & masks.get(word, 0)
        row = ((row + matches) | (row - matches)) & full
    return len(piece) - row.bit_count()


def _candidates(words: list[bytes], pieces: Pieces, least_cosine: float) -> Iterator[tuple[int, int, float]]:
    """(passage's first word, piece, cosine) of a document's passages, by latent cosine."""
    other = len(pieces.vocabulary)
    ids = np.fromiter(map(pieces.vocabulary.get, words, repeat(other)), dtype=np.int32, count=len(words))
    count = max(1, -(-(len(words) - PASSAGE_WORDS) // STRIDE) + 1)
    padded = np.append(ids, np.full(count * STRIDE + PASSAGE_WORDS - len(ids), other + 1, dtype=np.int32))
    windows = np.lib.stride_tricks.sliding_window_view(padded, PASSAGE_WORDS)[::STRIDE][:count]
    squares, most = np.append(pieces.idf**2, 0.0), np.append(pieces.most, 0.0)
    for first in range(0, count, 512):
        window = windows[first : first + 512]
        inside = window < other
        mass = squares[window]
        # A word that stands there n times counts n squared; those outside the vocabulary are taken for different ones.
        times = np.where(inside, (window[:, :, None] == window[:, None, :]).sum(axis=2, dtype=np.uint8), 1)
        lengths = np.sqrt((times * mass).sum(axis=1))
        # No piece can be closer than what the passage's words add at most.
        bound = most[window].sum(axis=1)
        rich = np.flatnonzero((bound >= least_cosine * lengths * (1 - 1e-5)) & (bound > 0))
        if not len(rich):
            continue
        latent = pieces.vectors[np.minimum(window[rich], other)].sum(axis=1)
        cosines = latent @ pieces.latent.T / lengths[rich, None]
        for row, piece in zip(*np.nonzero(cosines >= least_cosine)):
            yield int(first + rich[row]) * STRIDE, int(piece), float(cosines[row, piece])


def _short_items(words: list[bytes], pieces: Pieces) -> Iterator[tuple[object, int]]:
    """(item, first word) of each place where a short item stands."""
    if not pieces.short_by_word:
        return
    for at, word in enumerate(words):
        for item, own, place in pieces.short_by_word.get(word, ()):
            if at >= place and words[at - place : at - place + len(own)] == own:
                yield item, at - place


def leaked_items(text: bytes, blocks: list[Pieces], least_cosine: float = LEAST_COSINE) -> list[tuple]:
    """(item_id, first_word, cosine, common_share, answer_share) of each item found in a whole text, best place first."""
    words = plain_words(text)
    found: dict = {}
    for pieces in blocks if words else ():
        for item, start in _short_items(words, pieces):
            found.setdefault(item, (item, start, 1.0, 1.0, 1.0))
        if not pieces.words:
            continue
        for start, piece, cosine in sorted(_candidates(words, pieces, least_cosine), key=lambda c: (-c[2], c[0], c[1])):
            item = pieces.item_ids[piece]
            if item in found:
                continue
            own = pieces.words[piece]
            around = words[max(0, start - len(own)) : start + PASSAGE_WORDS + len(own)]
            share = common_subsequence(own, around) / len(own)
            answer = pieces.answer(piece)
            told = sum(word in around for word in answer) / len(answer)
            if share >= LEAST_COMMON or (share >= LEAST_COMMON_WITH_ANSWER and told >= LEAST_ANSWER):
                found[item] = (item, start, cosine, share, told)
    return list(found.values())


def _blocks(benchmark: DataFrame, rank: int) -> Iterator[Pieces]:
    """The benchmark, which is a query set, in blocks in the order of the items' ids.

    A block has at most ITEMS_PER_BLOCK items and ``rank`` pieces, so that its latent space has a dimension for each piece and
    loses none; an item of more pieces is a block of its own, with as many dimensions. Items that share an id stay together.
    """
    block: list[tuple[object, bytes]] = []
    count = 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        item = (row.item_id, (row.text or "").encode())
        own = len(pieces_of([item]).words)
        if block and item[0] != block[-1][0] and (len(block) >= ITEMS_PER_BLOCK or count + own > rank):
            yield pieces_of(block)
            block, count = [], 0
        block.append(item)
        count += own
    yield pieces_of(block)


def _passes(documents: DataFrame, benchmark: DataFrame, rank: int) -> Iterator[list[Pieces]]:
    """The indexed blocks that are looked for in one pass over the documents."""
    blocks = (pieces for pieces in _blocks(benchmark, rank) if pieces.vocabulary)
    while together := list(islice(blocks, BLOCKS_PER_PASS)):
        yield _index(documents, together)


def benchmark_leaks(documents: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, first_word, cosine, common_share, answer_share): each document and benchmark item found in it.

    first_word is the place of the passage, in words; an item of several pieces is found if one of them is.
    Null and empty texts and items contain and match nothing; an item without words is never found. Repeated
    documents are reported each, items that share an id count as one. Items of fewer than LEAST_WORDS words are too
    common to be told from clean text, and are not looked for; those of fewer than SHORT_PIECE words are found where they stand
    whole, with cosine and shares 1. An empty benchmark gives no rows. Other columns are not read.
    """
    schema = "doc_id bigint, item_id bigint, first_word bigint, cosine double, common_share double, answer_share double"
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = documents.sparkSession.createDataFrame([], schema)
    for blocks in _passes(rows, benchmark, rank):
        shared = documents.sparkSession.sparkContext.broadcast(blocks)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[start + place], *leak) for start, texts in slices(batch.column(1))
                         for place, text in enumerate(texts) for leak in leaked_items(text, shared.value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one[i] for one in found], pa.int64()) for i in range(3)]
                    + [pa.array([one[i] for one in found], pa.float64()) for i in range(3, 6)],
                    names=["doc_id", "item_id", "first_word", "cosine", "common_share", "answer_share"])

        result = result.union(rows.mapInArrow(searched, schema))
    return result


@keeps_columns
def without_leaks(documents: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The rows of ``documents``, all columns, in whose text no benchmark item is found."""
    place = documents.columns.index("text")
    schema = to_arrow_schema(documents.schema)
    clean = documents
    for blocks in _passes(documents, benchmark, rank):
        shared = documents.sparkSession.sparkContext.broadcast(blocks)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in slices(batch.column(place)):
                    keep = pa.array([not leaked_items(text, shared.value) for text in texts], pa.bool_())
                    part = batch.slice(start, len(texts)).filter(keep)
                    yield pa.RecordBatch.from_arrays(part.columns, schema=schema)

        clean = clean.mapInArrow(searched, documents.schema)
    return clean
