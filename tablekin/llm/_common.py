"""What the operators of this subpackage share: places for written tables, word rules and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..store import few_files, forget, new_path, written  # noqa: F401  for the operators

#: A word is a maximal run of anything but the six ASCII white space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> F.Column:
    """The number of words of a text column; 0 for null. JVM only."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes). It empties itself at a fixed size, so memory stays bounded."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (murmur's finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Base of the polynomial hashes over word hashes, odd and so invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The scrambled polynomial hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, width, power, done, part = None, 1, BASE, 0, h
    while True:  # by doubling: part covers width words
        if k & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out + piece * np.uint64(pow(BASE, done, 1 << 64))
            done += width
        if 2 * width > k:
            return mix(out)
        part = part[:-width] + part[width:] * np.uint64(power)
        width, power = 2 * width, power * power % (1 << 64)


#: Bytes of an Arrow batch, unless the session's own setting was changed: two tasks and their workers hold a few of each.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Prepare for Python workers: batches of bounded bytes, and, for those of a local Spark, this package's place to
    import it from. On a cluster, --py-files does that."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(size) is None and spark.conf.get(size).rstrip("bB") == str(64 << 20):
        spark.conf.set(size, str(BATCH_BYTES))
    if spark.sparkContext.master.startswith("local["):
        path = spark.sparkContext.environment.get("PYTHONPATH", "")
        root = str(Path(__file__).resolve().parents[2])
        if root not in path.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{path}".rstrip(":")


def release() -> None:
    """Give memory that is free back to the system. Python workers outlive their tasks, and an executor's tasks share it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], schema: str | StructType) -> DataFrame:
    """mapInArrow where make() builds the per-task function; that takes a batch and yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    kind = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = batch = cols = None
        for batch in batches:
            one = one or make()
            for cols in one(batch):
                yield pa.RecordBatch.from_arrays([_as_array(cols[f.name], f.type) for f in kind], schema=kind)
        del one, batch, cols
        release()

    return df.mapInArrow(run, schema)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_add(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], new: str) -> DataFrame:
    """df with further columns, new, that a per-task function gets from each batch; the others pass through as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    fields = _parse_datatype_string(new).fields
    more = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = batch = cols = None
        for batch in batches:
            one = one or make()
            cols = one(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[_as_array(cols[f.name], f.type) for f in more]], names=[*batch.schema.names, *more.names])
        del one, batch, cols
        release()

    return df.mapInArrow(run, StructType([*df.schema.fields, *fields]))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the strings of a column come to about limit bytes at most, or one row."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64))
    begin = 0
    while begin < len(batch):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
