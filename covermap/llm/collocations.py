"""Phrase collocations: frequent phrases of two to five words, scored by how much oftener they occur than by chance.

1. Words are counted by language. Phrases can only be frequent if all their parts are, so the text is written once more as
   numbers of the frequent words, with 0 for all other words and for the ends of pieces.
2. Level by level, tasks count the phrases of their text whose parts without the first and without the last word may both be
   frequent by a bitmap of hashes, and send each once, dealt to parts by its hash. In a part, candidates are the phrases whose
   bucket of hashes is met often enough. So candidates are few, and no frequent phrase is lost.
3. Candidates of a part go to double-array tries of bounded size. Numpy moves the states of all that was sent to the part through
   the levels, and sums the counts of accepting states.
4. Each cut of a frequent phrase meets the counts of its two parts in a join. All counts are exact, products are decimals.

Each level reads the numbers once, whatever the number of candidates, and nothing of theirs but bitmaps of bounded size is broadcast.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from covermap.llm.common import kept, release, slices
from covermap.llm.double_array import DoubleArray

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANGUAGE = "und"
#: The broadcast dictionary holds at most so many words; the numbers of rarer ones come from a join.
DICTIONARY = 1 << 20
#: A trie holds at most so many phrases; more candidates of a part make more tries.
TRIE_PHRASES = 1 << 18
#: Numbers whose phrases are counted together.
WALK_WORDS = 1 << 21
#: The hashes' buckets of all parts are 2 ** bits, about one for four words of the text within these bounds. When they are too
#: few, more candidates pass, never fewer.
LEAST_BITS = 12
MOST_BITS = 40
#: Parts that phrases are dealt to: at least so many, and two for each shuffle partition.
PARTS = 64
MOST_PARTS = 1 << 14
#: The bitmap of frequent phrases has about sixteen bits for each, and 2 ** BITMAP_BITS at most.
BITMAP_BITS = 29
SALTS = 16
#: Numbers of the words beyond the dictionary are dealt within so many groups.
_GROUPS = 256

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_END = b"."
_BYTES = bytearray(range(256))
for _byte in range(ord("A"), ord("Z") + 1):
    _BYTES[_byte] += 32
for _byte in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_byte] = _END[0]
_BYTES = bytes(_BYTES)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with b"." between pieces: it parts pieces itself, so it is in no word."""
    return text.translate(_BYTES).replace(_END, b" . ").split()


def _prepared(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(_END, None)
            words = list(own)
            for start in range(0, len(words), 50_000):
                part = words[start : start + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()),
                                                  pa.array([own[word] for word in part], pa.int64())], names=["lang", "word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                for lang, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts):
                    counts[lang].update(words_of(text))
                if sum(map(len, counts.values())) > 400_000:
                    yield from flush(counts)
                    counts.clear()
        yield from flush(counts)

    return rows.mapInArrow(counted, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list]:
    """(id, lang, word, n) of frequent words; those of them that the dictionary lacks, or None; and the dictionary's (id, lang, word)."""
    count = words.count()
    if count <= most:
        common = words.select("lang", "word", "n").toPandas()
        rest = None
    else:
        level = F.floor(F.log2("n") * 64).cast("int")
        reached, least = 0, None
        for row in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
            reached += row["count"]
            if reached > most:
                break
            least = row.level
        known = level >= least if least is not None else F.lit(False)
        common = words.where(known).select("lang", "word", "n").toPandas()
        group = F.pmod(F.xxhash64("lang", "word"), F.lit(_GROUPS))
        place = F.row_number().over(Window.partitionBy("group").orderBy("lang", "word"))
        rest = kept(words.where(~known).withColumn("group", group).withColumn(
            "id", (F.lit(len(common) + 1) + (place - 1) * _GROUPS + F.col("group")).cast("int")).select("id", "lang", "word", "n"))
    listed = sorted(zip((-common["n"]).tolist(), common["lang"].tolist(), map(bytes, common["word"])))
    dictionary = [(number + 1, lang, word) for number, (_, lang, word) in enumerate(listed)]
    table = pa.table({"id": pa.array([x[0] for x in dictionary], pa.int32()), "lang": pa.array([x[1] for x in dictionary], pa.string()),
                      "word": pa.array([x[2] for x in dictionary], pa.binary()), "n": pa.array([-x[0] for x in listed], pa.int64())})
    numbered = words.sparkSession.createDataFrame(table)
    return (numbered if rest is None else numbered.unionByName(rest)), rest, dictionary


def _as_numbers(rows: DataFrame, dictionary: list, rest: DataFrame | None) -> DataFrame:
    """(ids): the numbers of each text's words as little-endian 32-bit integers, with a 0 at the end."""
    ids: dict[str, dict[bytes, int]] = defaultdict(dict)
    for number, lang, word in dictionary:
        ids[lang][word] = number
    shared, others = rows.sparkSession.sparkContext.broadcast(dict(ids)), rest is not None

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: dict[bytes, int] = {}
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                langs = batch.column(0).slice(start, len(texts)).to_pylist()
                numbers, missing = [], []
                for lang, text in zip(langs, texts):
                    words = words_of(text)
                    words.append(_END)
                    known = shared.value.get(lang, none)
                    if others:
                        missing.append([{"place": place, "word": word} for place, word in enumerate(words) if word != _END and word not in known])
                    numbers.append(np.fromiter(map(known.get, words, (0,) * len(words)), dtype="<i4", count=len(words)).tobytes())
                columns = [pa.array(langs, pa.string()), pa.array(numbers, pa.binary())]
                if others:
                    columns.append(pa.array(missing, kind))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = pa.list_(pa.struct([("place", pa.int32()), ("word", pa.binary())]))
    names = ["lang", "ids", "others"][: 2 + others]
    schema = "lang string, ids binary" + ", others array<struct<place: int, word: binary>>" * others
    numbers = rows.mapInArrow(written, schema)
    if rest is None:
        return kept(numbers.select("ids"))
    # Written with the row's number, so that every later reading and every replaced task sees the same one.
    numbers = kept(numbers.withColumn("row", F.monotonically_increasing_id()))
    found = numbers.select("row", "lang", F.explode("others").alias("other")).select("row", "lang", "other.place", "other.word").join(rest, ["lang", "word"])
    found = found.groupBy("row").agg(F.collect_list(F.struct("place", "id")).alias("found"))

    def patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = []
            for own, more in zip(batch.column(0), batch.column(1)):
                own = np.frombuffer(own.as_py(), dtype="<i4").copy()
                for one in more.as_py() or ():
                    own[one["place"]] = one["id"]
                result.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(result, pa.binary())], names=["ids"])

    return kept(numbers.select("row", "ids").join(found, "row", "left").select("ids", "found").mapInArrow(patched, "ids binary"))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of consecutive texts, about WALK_WORDS together. Every text ends with 0, so phrases stay within one."""
    part, size = [], 0
    for value in column:
        part.append(value.as_py())
        size += len(part[-1])
        if size >= 4 * WALK_WORDS:
            yield np.frombuffer(b"".join(part), dtype="<i4")
            part, size = [], 0
    if part:
        yield np.frombuffer(b"".join(part), dtype="<i4")


def _names(size: int) -> list[str]:
    return [f"p{place}" for place in range(1, size + 1)]


def _schema(size: int, *more: str) -> str:
    return ", ".join([f"{name} int" for name in _names(size)] + list(more))


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    hashes = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        hashes ^= column.view(np.uint32)
        hashes *= _FACTOR
    return hashes


def _parts(numbers: DataFrame) -> int:
    wanted = 2 * int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PARTS, 1 << (max(PARTS, wanted) - 1).bit_length())


_DEALT = "part int, n int, phrases binary"


def _packed(part: int, phrases: np.ndarray) -> tuple[int, int, bytes]:
    """The numbers' first bytes together, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(phrases, dtype="<i4").view(np.uint8).reshape(len(phrases), -1).T
    return part, len(phrases), pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(rows: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for part, n, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2)):
        if raw.is_valid:
            planes = np.frombuffer(pa.decompress(raw.as_buffer(), decompressed_size=4 * n * width, codec="zstd"), dtype=np.uint8)
            yield part, np.ascontiguousarray(planes.reshape(4 * width, n).T).view("<i4")


def _dealt_batch(dealt: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*dealt)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
                                      names=["part", "n", "phrases"])


def _extensions(ids: np.ndarray, size: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(phrase and count, hash) of the phrases of ``size`` words that a text has whose two parts of one word less are in the bitmap, in the order of hashes.

    Equal phrases stand in one row, or in more if hashes of different ones are equal.
    """
    count = len(ids) - size + 1
    if count < 1:
        return np.empty((0, size + 1), dtype=np.int32), np.empty(0, dtype=np.uint64)
    known = ids > 0
    if size == 2:
        at = np.flatnonzero(known[:-1] & known[1:])
    else:
        inside = known[: count + 1].copy()
        for place in range(1, size - 1):
            inside &= known[place : place + count + 1]
        parts = np.flatnonzero(inside)
        bit = (_hashes([ids[parts + place] for place in range(size - 1)]) >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)).astype(np.int64)
        inside[parts] = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        at = np.flatnonzero(inside[:-1] & inside[1:])
    hashes = _hashes([ids[at + place] for place in range(size)])
    order = np.argsort(hashes)
    at, hashes = at[order], hashes[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    phrases = np.empty((len(at), size + 1), dtype=np.int32)
    for place in range(size):
        phrases[:, place] = ids[at + place]
    new[1:] |= (phrases[1:, :size] != phrases[:-1, :size]).any(axis=1)
    first = np.flatnonzero(new)
    phrases = phrases[first]
    phrases[:, size] = np.diff(np.append(first, len(at)))
    return phrases, hashes[first]


def _open_phrases(numbers: DataFrame, size: int, least: int, bits: int, parts: int, bitmap: np.ndarray | None) -> DataFrame:
    """(part, n, phrases): the phrases that tasks have counted, and their counts, in buckets of hashes that the texts meet ``least`` times or more.

    No phrase of another bucket can be frequent.
    """
    part_bits = parts.bit_length() - 1
    own_bits = max(bits - part_bits, 1)
    shared = numbers.sparkSession.sparkContext.broadcast(bitmap)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in _texts(batch.column(0)):
                phrases, hashes = _extensions(ids, size, shared.value)
                edges = [*np.searchsorted(hashes, np.arange(parts, dtype=np.uint64) << np.uint64(64 - part_bits)).tolist(), len(hashes)]
                yield _dealt_batch([_packed(part, phrases[a:b]) for part, (a, b) in enumerate(zip(edges, edges[1:])) if a < b])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part."""
        part, waiting = None, []

        def result() -> pa.RecordBatch:
            phrases = np.concatenate(waiting)
            hashes = _hashes([np.ascontiguousarray(phrases[:, place]) for place in range(size)])
            bucket = ((hashes << np.uint64(part_bits)) >> np.uint64(64 - own_bits)).astype(np.int64)
            there = np.bincount(bucket, weights=phrases[:, size], minlength=1 << own_bits)[bucket] >= least
            return _dealt_batch([_packed(part, phrases[there])] if there.any() else [])

        for batch in batches:
            for own, phrases in _unpacked(batch, size + 1):
                if part is not None and own != part:
                    yield result()
                    waiting = []
                part = own
                waiting.append(phrases)
        if waiting:
            yield result()

    dealt = numbers.mapInArrow(sent, _DEALT).repartition("part").sortWithinPartitions("part")
    result = kept(dealt.mapInArrow(opened, _DEALT))
    shared.destroy()
    return result


def _candidates(open_phrases: DataFrame, size: int) -> DataFrame:
    """(p1, ..., part): each of the phrases once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, phrases in _unpacked(batch, size + 1):
                phrases = phrases[:, :size]
                phrases = phrases[np.lexsort(phrases.T[::-1])]
                phrases = phrases[np.concatenate([[True], (phrases[1:] != phrases[:-1]).any(axis=1)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(column)) for column in phrases.T] + [pa.array(np.full(len(phrases), part, dtype=np.int32))],
                                                 names=_names(size) + ["part"])

    return open_phrases.mapInArrow(once, _schema(size, "part int"))


def _tries(phrases: DataFrame, size: int, most: int) -> DataFrame:
    """(part, trie): tries of at most ``most`` of a part's phrases each, made by the tasks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, []

        def result() -> pa.RecordBatch:
            own = np.concatenate(waiting)
            tries = [pickle.dumps(DoubleArray(own[start : start + most])) for start in range(0, len(own), most)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(tries), pa.int32()), pa.array(tries, pa.binary())], names=["part", "trie"])

        for batch in batches:
            numbers = batch.column(size).to_numpy()
            own = np.column_stack([batch.column(place).to_numpy() for place in range(size)])
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if part is not None and numbers[a] != part:
                        yield result()
                        waiting = []
                    part = numbers[a]
                    waiting.append(own[a:b])
        if waiting:
            yield result()

    return phrases.repartition("part").sortWithinPartitions("part").mapInArrow(made, "part int, trie binary")


def _counts(open_phrases: DataFrame, tries: DataFrame, size: int, least: int) -> DataFrame:
    """(p1, ..., a, part): the phrases of the tries that occur ``least`` times or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, the tries first."""
        part, own, totals = None, [], []

        def result() -> Iterator[pa.RecordBatch]:
            for trie, total in zip(own, totals):
                rows = np.flatnonzero(total >= least)
                columns = [pa.array(np.ascontiguousarray(column)) for column in trie.phrases[rows].T]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total[rows]), pa.array(np.full(len(rows), part, dtype=np.int32))], names=_names(size) + ["a", "part"])

        for batch in batches:
            for row, number in enumerate(batch.column(0).to_pylist()):
                if number != part:
                    yield from result()
                    part, own, totals = number, [], []
                if batch.column(3)[row].is_valid:
                    own.append(pickle.loads(batch.column(3)[row].as_buffer()))
                    totals.append(np.zeros(len(own[-1].phrases), dtype=np.int64))
                for _, phrases in _unpacked(batch.slice(row, 1), size + 1):
                    words = phrases.copy()
                    words[:, size] = 0  # so that none reaches into the next
                    for trie, total in zip(own, totals):
                        at, found = trie.walk(words.ravel())
                        np.add.at(total, found, phrases[at // (size + 1), size].astype(np.int64))
        yield from result()

    both = open_phrases.withColumn("trie", F.lit(None).cast("binary")).unionByName(tries, allowMissingColumns=True)
    both = both.withColumn("later", F.col("trie").isNull()).repartition("part").sortWithinPartitions("part", "later").drop("later")
    return kept(both.mapInArrow(counted, _schema(size, "a bigint", "part int")))


def _bitmap(frequent: DataFrame, size: int, parts: int) -> np.ndarray | None:
    """A bit for the first bits of each phrase's hash, packed in bytes; None without phrases."""
    count = frequent.count()
    bits = min(BITMAP_BITS, max(parts.bit_length() + 2, count.bit_length() + 4))
    own = (1 << bits) // parts

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            place = (_hashes([column.to_numpy() for column in batch.columns[:size]]) >> np.uint64(64 - bits)).astype(np.int64)
            for part in np.unique(place // own).tolist():
                found.setdefault(part, np.zeros(own, dtype=np.uint8))[place[place // own == part] - part * own] = 1
        for part, places in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(places, bitorder="little").tobytes()], pa.binary())], names=["part", "places"])

    if not count:
        return None
    result = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in frequent.select(*_names(size)).mapInArrow(marked, "part int, places binary").collect():  # together the bitmap, of bounded size
        result[row.part * own // 8 : (row.part + 1) * own // 8] |= np.frombuffer(bytes(row.places), dtype=np.uint8)
    return result


def _salted_join(rows: DataFrame, small: DataFrame, key: str, *, salts: int = SALTS) -> DataFrame:
    """An inner join on ``key``, which is unique in ``small`` and may be very common in ``rows``."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("p", "k"), F.lit(salts)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.array([F.lit(salt) for salt in range(salts)])))
    return dealt.join(copies, [key, "salt"]).drop("salt")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, least_share: int = 100,
                 dictionary: int = DICTIONARY, trie_phrases: int = TRIE_PHRASES, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), at most ``top`` rows a language.

    Pieces end at ``.,;:!?`` and line ends, words at spaces and tabs; A-Z are lower-cased. a counts the phrase, l and r the parts
    of its lowest-scoring cut (the first of equal ones), n all words of the language; score is 1000 * a * n / (l * r) rounded
    down. Phrases whose words stand together in a longer frequent phrase with at least ``least_share`` per cent of their count
    are dropped. Null texts have no words, a null language is ``und``. Repeated rows count again; ids and other columns are
    not read. Without frequent phrases there are no rows.
    """
    rows, spark = _prepared(documents), documents.sparkSession
    words = kept(_word_counts(rows))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent_words = kept(words.where(F.col("n") >= least))
    numbered, rest, listed = _numbered(frequent_words, dictionary)
    numbers = _as_numbers(rows, listed, rest)
    singles = numbered.select(F.col("id").alias("p1"), F.col("n").alias("a"))
    levels = [singles]
    total = frequent_words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(max(int(total).bit_length() - 2, LEAST_BITS), most_bits)
    parts, bitmap = _parts(numbers), None
    for size in range(2, longest + 1):
        open_phrases = _open_phrases(numbers, size, least, bits, parts, bitmap)
        frequent = _counts(open_phrases, _tries(_candidates(open_phrases, size), size, trie_phrases), size, least)
        levels.append(frequent.drop("part"))
        if size < longest:
            bitmap = _bitmap(frequent, size, parts)
            if bitmap is None:
                break
        release(spark)
    phrases = kept(reduce(DataFrame.unionByName, [level.select(F.array(*_names(size)).alias("p"), "a") for size, level in enumerate(levels, 1)]))
    several = phrases.where(F.size("p") > 1)

    inner = several.where(F.size("p") > 2).select("a", F.expr(
        "explode(flatten(transform(sequence(2, size(p) - 1), s -> transform(sequence(1, size(p) - s + 1), i -> slice(p, i, s))))) AS p"))
    covered = inner.groupBy("p").agg(F.max("a").alias("longer")).withColumnRenamed("p", "of")
    left = several.join(covered, F.col("p") == F.col("of"), "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * least_share)).select("p", "a")

    language = numbered.select(F.array("id").alias("first"), "lang").join(totals, "lang").select("first", "lang", F.col("total").alias("n"))
    cuts = left.select("p", "a", F.slice("p", 1, 1).alias("first"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = _salted_join(cuts, language, "first").withColumns({"head": F.expr("slice(p, 1, k)"), "tail": F.expr("slice(p, k + 1, size(p))")})
    cuts = _salted_join(cuts, phrases.select(F.col("p").alias("head"), F.col("a").alias("l")), "head")
    cuts = _salted_join(cuts, phrases.select(F.col("p").alias("tail"), F.col("a").alias("r")), "tail")
    wide = lambda name: f"CAST({name} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 * {wide('a')} AS DECIMAL(22, 0)) * CAST(n AS DECIMAL(15, 0))) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    pieces = best.select("*", F.posexplode("p").alias("k", "id"))
    spelt = _salted_join(pieces, numbered.select("id", F.col("word").cast("string").alias("word")), "id")
    spelt = spelt.groupBy("p", "a", "lang", "n", "cut").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("words"))
    scored = kept(spelt.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"))
    return _ranked(scored, top)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language. Parts of a language are cut first, so that no task sorts a whole one."""
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return first.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
