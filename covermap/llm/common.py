"""What the operators share: tables, results kept in the shared folder, words and id remainders.

Words are the runs of bytes that are none of the six ASCII white-space characters, which is
exactly how Python splits bytes; A-Z are lower-cased byte by byte, so other letters stay.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
WORD = r"[^\x20\x09-\x0D]+"
#: The columns that operators read.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source")
#: Texts are worked on in slices of about so many bytes, so that a task's memory does not follow its input.
SLICE_BYTES = 4 << 20

_ALPHANUMERIC = bytearray(b" " * 128 + bytes(range(128, 256)))
for _byte in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _ALPHANUMERIC[_byte] = _byte
for _byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ALPHANUMERIC[_byte] = _byte + 32
_ALPHANUMERIC = bytes(_ALPHANUMERIC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, one in the warehouse, which executors share too."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/kept").rstrip("/")


def kept(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows, written to the shared folder and read from there: later steps and replaced tasks read files."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keeps_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that returns rows of its first argument, whatever its other columns are called: with dots, quotes or twice the same.

    The stage sees DOCUMENT_COLUMNS (the first of each name) as they are, and all others under names by position.
    """

    @wraps(stage)
    def run(documents: DataFrame, *args, **named) -> DataFrame:
        names = documents.columns
        plain = [name if name in DOCUMENT_COLUMNS and names.index(name) == place else f"_column_{place}" for place, name in enumerate(names)]
        return stage(documents.toDF(*plain), *args, **named).select(*plain).toDF(*names)

    return run


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo the divisor; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def id_remainder(doc_id: int | None, divisor: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor


def alphanumeric_words(text: bytes) -> list[bytes]:
    """Runs of a-z (A-Z lower-cased), digits and all characters beyond ASCII."""
    return text.translate(_ALPHANUMERIC).split()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows with about ``limit`` bytes together."""
    texts, start, size = [], 0, 0
    for row, value in enumerate(column.cast(pa.binary())):
        text = value.as_py() or b""
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield start, texts
            texts, start, size = [], row + 1, 0
    if texts:
        yield start, texts
