"""Token-id files: sorted-string tables of documents by identifier.

A shard file holds, in ascending key order, blocks of entries, then a sparse block index, a Bloom filter over the keys
and a footer of fixed size:

  block   entries (shared prefix, rest of the key, bytes of the value, the key's rest, the value) with 32-bit lengths as
          LEB128; the first key of a block is whole; the value is the ids as 16-bit, or 32-bit where an id needs it
  index   for each block: its last key, offset, bytes, entries
  filter  bits, of which each key sets HASHES
  footer  offsets and sizes of index and filter, number of entries and of ids, width of an id, crc32 of the index, magic

A key is a byte that is 0 for a null identifier and else 1, the identifier as 8 big-endian bytes with its sign bit
flipped, so that byte order is numeric order with null first, and a running number of 4 bytes for repeated identifiers.
The manifest holds each file's first and last identifier as key bytes. Lookup takes the files whose range holds a wanted
identifier, and of each reads footer, filter and index, then the blocks that the index names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, text_pieces
from .tokens import crc_of, encoder, with_end

#: Bytes of a block and of a shard file before the next is begun, bits of the filter a key, bits a key sets.
BLOCK_BYTES, SHARD_BYTES, FILTER_BITS, HASHES = 64 << 10, 16 << 20, 10, 7
#: Text bytes that one task's range of identifiers holds, on average.
RANGE_BYTES = 16 << 20
MAGIC = b"IDTABLE2"
#: Table beside the shard files: their names, entries and ids.
MANIFEST = "manifest.parquet"
_MANIFEST_ROW = "file string, part long, number long, entries long, ids long, first_key binary, last_key binary"
_FOOTER = struct.Struct("<QQQQQQII8s")
#: Neighbouring ranges of identifiers whose files are counted together: the driver holds a number for each group.
GROUP_PARTS = 1024


#: Bytes of a key that hold the identifier.
ID_BYTES = 9


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    known = doc_id is not None
    return struct.pack(">BQI", known, (doc_id + (1 << 63)) & ((1 << 64) - 1) if known else 0, number)


def id_of(key: bytes) -> int | None:
    known, doc_id = struct.unpack_from(">BQ", key)
    return doc_id - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while (b := data[at]) > 127:
        n |= (b & 127) << shift
        shift += 7
        at += 1
    return n | b << shift, at + 1


def _bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key[:ID_BYTES])
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % size for i in range(HASHES)]


class ShardBuilder:
    """Entries in key order to the bytes of one shard file."""

    def __init__(self, block_bytes: int = BLOCK_BYTES):
        self.block_bytes = block_bytes
        self.done: list[bytes] = []
        self.size = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.width = 2
        self._open: list[tuple[bytes, np.ndarray]] = []
        self._held = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self._open.append((key, ids))
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)
        self._held += 2 * len(ids) + 16
        if self._held >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if not self._open:
            return
        out, last = bytearray(), b""
        for key, ids in self._open:
            same = next((i for i, (a, b) in enumerate(zip(key, last, strict=False)) if a != b), min(len(key), len(last)))
            wide = len(ids) and int(ids.max()) > 0xFFFF
            value = ids.astype("<u4" if wide else "<u2").tobytes()
            out += _varint(same) + _varint(len(key) - same) + _varint(len(value) << 1 | bool(wide)) + key[same:] + value
            last = key
        self.index.append((last, self.size, len(out), len(self._open)))
        self.done.append(bytes(out))
        self.size += len(out)
        self._open, self._held = [], 0

    def finish(self) -> bytes:
        self._close()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) + _varint(e) for k, o, n, e in self.index)
        bits = max(64, FILTER_BITS * self.entries)
        marks = np.zeros(-(-bits // 8) * 8, np.uint8)
        marks[[b for k in self.keys for b in _bits(k, bits)]] = 1
        bloom = np.packbits(marks, bitorder="little").tobytes()
        foot = _FOOTER.pack(self.size, len(index), self.size + len(index), bits, self.entries, self.ids, len(self.index), zlib.crc32(index), MAGIC)
        return b"".join([*self.done, index, bloom, foot])


class Shard:
    """A shard file of some size, by read(offset, bytes): its footer, index and filter at once, blocks when asked for."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.read = read
        at, length, bloom, self.bits, self.entries, self.ids, blocks, crc, magic = _FOOTER.unpack(read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a whole shard file")
        tail = memoryview(read(at, size - _FOOTER.size - at))
        index, self.bloom = tail[:length], tail[bloom - at :]
        if zlib.crc32(index) != crc:
            raise ValueError("not a whole shard file")
        self.index, at = [], 0
        for _ in range(blocks):
            n, at = _read_varint(index, at)
            key, at = bytes(index[at : at + n]), at + n
            offset, at = _read_varint(index, at)
            size, at = _read_varint(index, at)
            entries, at = _read_varint(index, at)
            self.index.append((key, offset, size, entries))

    @classmethod
    def of(cls, data: bytes) -> Shard:
        view = memoryview(data)
        return cls(len(view), lambda at, n: view[at : at + n])

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, begin, size, entries = self.index[k]
        data, at, key = memoryview(self.read(begin, size)), 0, b""
        for _ in range(entries):
            same, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:same] + bytes(data[at : at + rest])
            at += rest
            yield key, np.frombuffer(data[at : at + (n >> 1)], "<u4" if n & 1 else "<u2").astype(np.uint32)
            at += n >> 1
        if at != size:
            raise ValueError("a block ends in the wrong place")

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of an identifier."""
        start = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(start, self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < start else (low, mid)
        out = []
        for k in range(low, len(self.index)):
            for key, ids in self.block(k):
                if key[:ID_BYTES] > start[:ID_BYTES]:
                    return out
                if key[:ID_BYTES] == start[:ID_BYTES]:
                    out.append(ids)
        return out


def _put(folder: str, name: str, data: bytes) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(data)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None) -> str:
    """Encode documents (doc_id, text) and write shard files into a folder; returns the folder.

    Shards are ranges of identifiers in ascending order. A null or empty text is the end id alone; a repeated
    identifier gives an entry for each row, ordered by the 64-bit hash of its text, so that a range can end within it;
    null is an identifier like others and comes first.
    No rows give no files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    ranges = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES + 1
    ranges = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        shard, number, last, files = ShardBuilder(), 0, (), 0

        def close() -> pa.RecordBatch:
            nonlocal shard, files
            # A name of this attempt's own: the manifest lists the files of attempts that ended, and only those are read.
            name = f"shard-{part:08d}-{files:05d}-{uuid.uuid4().hex}.ids"
            _put(folder, name, shard.finish())
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "number": [files], "entries": [shard.entries], "ids": [shard.ids], "first_key": [shard.keys[0][:ID_BYTES]], "last_key": [shard.keys[-1][:ID_BYTES]]})
            shard, files = ShardBuilder(), files + 1
            return row

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for row, to, data, offsets in text_pieces(batch.column("text")):
                ids, ends = with_end(*encode(data, offsets))
                for k in range(row, to):
                    number = number + 1 if ids_of[k] == last else 0
                    last = ids_of[k]
                    shard.add(key_of(last, number), ids[ends[k - row] : ends[k - row + 1]])
                    if shard.size >= SHARD_BYTES:
                        yield close()
        if shard.entries:
            yield close()

    written = keyed.repartitionByRange(ranges, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text").mapInArrow(work, _MANIFEST_ROW)
    written.write.parquet(f"{folder}/{MANIFEST}")
    return folder


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry in shard files, with start the ids of all entries before it."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                keys, sizes_, crcs = [], [], []
                for key, ids in Shard.of(data.as_buffer().to_pybytes()):
                    keys.append(id_of(key))
                    sizes_.append(len(ids))
                    crcs.append(crc_of(ids))
                n = np.array(sizes_, np.int64)
                yield pa.RecordBatch.from_pydict({"file": [path.rpartition("/")[2]] * len(n), "doc_id": pa.array(keys, pa.int64()), "inside": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": pa.array(crcs, pa.int64())})

    before = _before(_manifest(spark, folder))
    found = _files(spark, folder).select("path", "content").mapInArrow(entries, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _manifest(spark, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST_ROW).parquet(f"{folder}/{MANIFEST}")


def _before(manifest: DataFrame) -> DataFrame:
    """file, before: the ids of all files before it. Ranges ascend with their numbers, and files within a range with theirs."""
    group = F.floor(F.col("part") / GROUP_PARTS)
    totals = dict(manifest.groupBy(group.alias("g")).agg(F.sum("ids").alias("ids")).collect())
    sums, total = [], 0
    for g in sorted(totals):
        sums.append((g, total))
        total += totals[g]
    starts = manifest.sparkSession.createDataFrame(sums, "g long, first long")
    inside = F.sum("ids").over(W.partitionBy("g").orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("g", group).withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "g").select("file", (F.col("first") + F.col("inside")).alias("before"))


def lookup(spark, folder: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of every entry of the wanted identifiers; what is not there gives no row, nor do no identifiers.

    The manifest picks the files whose range of identifiers holds a wanted one. Of those only footer, index, filter and
    the blocks of identifiers that the filter lets through are read.
    """
    wanted = {key_of(doc_id)[:ID_BYTES]: doc_id for doc_id in doc_ids}
    keys = sorted(wanted)
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first, last in zip(*(batch.column(c).to_pylist() for c in ("file", "first_key", "last_key")), strict=True):
                some = keys[bisect_left(keys, first) : bisect_right(keys, last)]
                if not some:
                    continue
                with fs.open_input_file(f"{root}/{name}") as file:
                    shard = Shard(file.size(), lambda at, n, file=file: file.read_at(n, at))
                    for key in some:
                        if found := shard.get(wanted[key]):
                            yield pa.RecordBatch.from_pydict({"doc_id": [wanted[key]] * len(found), "ids": [x.astype(np.int64).tolist() for x in found]}, schema=kind)

    files = _manifest(spark, folder).select("file", "first_key", "last_key")
    near = files.where((F.col("last_key") >= F.lit(keys[0])) & (F.col("first_key") <= F.lit(keys[-1]))) if keys else files.limit(0)
    # A task opens few files, however the manifest is stored.
    return near.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(work, "doc_id long, ids array<long>")


def _files(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").load(folder)
