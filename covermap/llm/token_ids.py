"""Token ids in binary files: static range coding of independent blocks, in ascending order of documents.

1. Texts are tokenised. Tokens never cross ASCII white space, so words are tokenised one by one and remembered.
2. Ids are counted over all documents into one frequency table of the vocabulary's size.
3. Documents are dealt to tasks by ranges of doc_id and sorted there; each task packs whole documents into
   blocks of about BLOCK_TOKENS ids and encodes each block on its own.
4. Files are Parquet rows, one per block: who is in it, lengths, checkpoints, checksums and the stream. So they
   can lie in any store Spark writes to, appear only when a task has succeeded, and blocks are read in parallel.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from covermap.llm.common import kept, shared_folder, slices
from covermap.llm.rans import Block, Coder, scaled_frequencies

END_ID = 1
BLOCK_TOKENS = 1 << 20
#: Words remembered by a Python worker.
REMEMBERED = 800_000
#: New words that are encoded together.
TOGETHER = 500
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
_STOPS = (b",", b".")


_BLOCK_SCHEMA = ("range_no int, block_no int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, lanes int, words binary, "
                 "states array<binary>, offsets array<bigint>, checksums array<bigint>")
_BLOCK_ARROW = pa.schema([
    ("range_no", pa.int32()), ("block_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("words", pa.binary()), ("states", pa.list_(pa.binary())),
    ("offsets", pa.list_(pa.int64())), ("checksums", pa.list_(pa.int64()))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts, word by word; equal to those of the whole text for tokenizers whose tokens never cross white space."""

    def __init__(self, definition: str, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = {2: "H", 4: "I"}[width]
        # Where the tokenizer lower-cases, and parts a comma or full stop from letters, words share their known forms.
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.parts = splitter is not None and all(len(splitter.pre_tokenize_str(one)) == 2 for one in ("a,", "a."))
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _form(self, word: bytes) -> bytes:
        """The word, or a form that more words share: small letters, without a comma or full stop at the end."""
        plain = word[:-1] if self.parts and word.endswith(_STOPS) and word[-2:-1].isalpha() else word
        return word if plain.translate(None, _LETTERS) else plain.lower() if self.lowers else plain

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word: all are encoded as one text, and cut where a token begins past a word's end."""
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = [first for first, _ in encoding.offsets]
        ends = list(accumulate(len(word) + 1 for word in words))
        cuts = np.searchsorted(begins, ends).tolist()
        ids = array(self.kind, encoding.ids).tobytes()
        width = array(self.kind).itemsize
        return [ids[width * a : width * b] for a, b in zip([0, *cuts], cuts)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """As little-endian numbers."""
        split = [text.split() for text in texts]
        if len(self.known) > REMEMBERED:  # words seen lately stay known through the dictionary before
            self.before, self.known = self.known, {}
        found = [list(map(self.known.get, words)) for words in split]
        holes = [row for row, own in enumerate(found) if None in own]
        self._learn({word for row in holes for word, own in zip(split[row], found[row]) if own is None})
        known = self.known
        for row in holes:
            found[row] = [own or known[word] for word, own in zip(split[row], found[row])]
        return list(map(b"".join, found))

    def _learn(self, fresh: set[bytes]) -> None:
        known, before = self.known, self.before
        known.update((word, before[word]) for word in fresh if word in before)
        lacking = [word for word in fresh if word not in known]
        forms = list(map(self._form, lacking))
        wanted = set(forms).difference(known)
        known.update((word, before[word]) for word in wanted if word in before)
        new = [word for word in wanted if word not in known]
        new += [stop for stop in _STOPS if stop not in known]
        for start in range(0, len(new), TOGETHER):
            part = new[start : start + TOGETHER]
            known.update(zip(part, self._encoded([word.decode("utf-8", "replace") for word in part])))
        for word, form in zip(lacking, forms):
            if word is not form:
                known[word] = known[form] + known[word[-1:]] if len(word) > len(form) else known[form]


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(definition: str, width: int) -> WordTokenizer:
    """One for each definition, kept by a Python worker between tasks."""
    if (definition, width) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition, width] = WordTokenizer(definition, width)
    return _tokenizers[definition, width]


def tokenised(documents: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, width: int = 4) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text and the end id, as little-endian numbers of ``width`` bytes; null is empty."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())  # of the tokenizer's size
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(definition.value, width)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                ids = [one + end for one in words.ids(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        encoded, "doc_id bigint, n_tokens bigint, ids binary")


def vocabulary_size(tokenizer: str | None = None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab_size(with_added_tokens=True)


def id_counts(ids: DataFrame, size: int, width: int = 4) -> np.ndarray:
    """How often each id occurs, over all rows; as many numbers as the vocabulary has ids reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), dtype=f"<u{width}"), minlength=size)
        present = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(total[present])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(counted, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    result = np.zeros(size, dtype=np.int64)
    result[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return result


def write_token_files(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                      block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``folder``/table (the frequencies) and ``folder``/blocks, in ascending order of doc_id (nulls first).

    Rows that share a doc_id stand next to each other, in an order fixed by their ids. Null and empty texts are
    written as the end id alone. An empty table gives a table of zeros and no blocks. Other columns are not read.
    """
    spark = documents.sparkSession
    size = max(vocabulary_size(tokenizer), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    rows = kept(tokenised(documents, tokenizer, end_id, width))
    frequencies = scaled_frequencies(id_counts(rows, size, width))
    spark.createDataFrame(pa.table({"frequencies": pa.array([frequencies.astype("<u4").tobytes()], pa.binary())})) \
        .coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(frequencies)

    def block(number: int, doc_ids: list, ids: list[bytes], coder: Coder) -> pa.RecordBatch:
        made = coder.encode(np.frombuffer(b"".join(ids), dtype=f"<u{width}"))
        row = {"range_no": TaskContext.get().partitionId(), "block_no": number, "doc_ids": doc_ids, "lengths": [len(x) // width for x in ids],
               "n_tokens": made.n_tokens, "lanes": made.lanes, "words": made.words, "states": made.states,
               "offsets": made.offsets, "checksums": made.checksums}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, doc_ids, ids, tokens = Coder(shared.value), 0, [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(value.as_py())
                tokens += len(ids[-1]) // width
                if tokens >= block_tokens:
                    yield block(number, doc_ids, ids, coder)
                    number, doc_ids, ids, tokens = number + 1, [], [], 0
        if ids:
            yield block(number, doc_ids, ids, coder)

    # The digest only orders rows that share a doc_id, and lets a very frequent one spread over tasks.
    digest = F.xxhash64("ids")
    in_order = rows.select("doc_id", "ids").repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest, "ids")
    in_order.mapInArrow(packed, _BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files: each block is decoded by itself, in any task.

    start counts the ids of all documents before. It follows from the blocks' lengths: totals of the ranges, of
    which there are as many as files, are summed up first, then the blocks within each range.
    """
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    row = spark.read.schema("frequencies binary").parquet(f"{folder}/table").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(row.frequencies), dtype="<u4").astype(np.int64))
    sizes = blocks.select("range_no", "block_no", "n_tokens")
    ranges = sizes.groupBy("range_no").agg(F.sum("n_tokens").alias("tokens"))
    before = ranges.select("range_no", (F.sum("tokens").over(Window.orderBy("range_no")) - F.col("tokens")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range_no").orderBy("block_no")) - F.col("n_tokens")
    starts = sizes.withColumn("inside", inside).join(before, "range_no").select("range_no", "block_no", (F.col("before") + F.col("inside")).alias("start"))
    columns = [field.name for field in _BLOCK_ARROW][2:]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for index in range(batch.num_rows):
                part = batch.slice(index, 1).to_pylist()[0]
                ids = coder.decode(Block(part["n_tokens"], part["lanes"], part["words"], part["states"], part["offsets"], part["checksums"]))
                ends = np.cumsum(part["lengths"])
                first = ends - part["lengths"]
                raw = memoryview(ids.astype("<u4").tobytes())
                texts = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist())]
                result = [pa.array(part["doc_ids"], pa.int64()), pa.array(first + part["start"]), pa.array(part["lengths"], pa.int64()),
                          pa.array([zlib.crc32(text) for text in texts], pa.int64())]
                if with_ids:
                    result.append(pa.array([bytes(text) for text in texts], pa.binary()))
                yield pa.RecordBatch.from_arrays(result, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return blocks.join(starts, ["range_no", "block_no"]).select(*columns, "start").mapInArrow(decoded, schema)


def written_ids(documents: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the token files of ``documents`` to the shared folder and read them back."""
    folder = f"{shared_folder(documents.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(documents, folder, tokenizer)
    return read_token_files(documents.sparkSession, folder, with_ids)
