"""Helpers shared by the operators: shared folders and byte-level views of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import fresh_path, materialize  # noqa: F401  for the operators

#: Text is worked on in pieces of about this many bytes, so that memory does not follow the batch.
CHUNK_BYTES = 1 << 20
#: Rows and bytes of a batch that goes to Python: what either side of the pipe holds, unless a single row is longer.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of a word that white space (space, tab to carriage return) ends.
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where it is installed at the driver's path; else it is shipped by --py-files.

    Batches that go to Python hold BATCH_ROWS rows or BATCH_BYTES, where the session does not say otherwise.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with: names after them are free."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def column(name: str):
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing needs any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, False)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their stage, and each keeps what it once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def byte_view(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and the 64-bit offsets of the rows in them; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, ends, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_pieces(array: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, offsets) for runs of whole rows of about limit bytes; a longer row is one run.

    Only one run at a time is copied.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row, rows = 0, len(array)
    while row < rows:
        before = int(ends[row - 1]) if row else 0
        to = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        data, offsets = byte_view(array.slice(row, to - row))
        yield row, to, data, offsets
        row = to
    give_back()


def runs(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of word bytes; a run never crosses the end of a row."""
    inside = is_word[data]
    filled = offsets[:-1] < offsets[1:]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first], stops[last] = inside[first], inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[start:end] as one Arrow array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))])


#: Masks for the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread, one to one."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], the same for the same bytes wherever they stand."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    out = mixed(size.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
    some = np.flatnonzero(size <= _LONG_WORD)
    for at in range(0, _LONG_WORD, 8):
        some = some[size[some] > at]
        if not len(some):
            break
        out[some] = mixed(out[some] ^ (eight[starts[some] + at] & _FIRST_BYTES[np.minimum(size[some] - at, 8)]))
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def crc_of_id(column: str = "doc_id"):
    """crc32 of an identifier's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
