"""Token shards as sorted string tables.

A shard file holds documents in ascending order of their identifier:

    blocks   each: u32 length of the entry list, the entries, the ids of all its documents (compressed)
             entry: varints shared, unshared, ids; then the unshared bytes of the key (prefix compression)
    index    for each block: varints length of its first key, offset, length; the key (sparse: one key a block)
    bloom    bits of a Bloom filter over the keys
    footer   of fixed length: magic, bytes an id, counts of documents and ids, offsets and lengths, CRC-32

A key is a byte (0 for a null identifier, else 1) and the identifier as eight bytes whose order is the number's order, so a
lookup asks the filter, searches the index by halving and reads one block (more only where an identifier repeats).

Writing: documents are dealt by ranges of (identifier, text hash), sorted and encoded in one task per shard; a task writes
to a name of its own and renames at the end, so a lost or repeated task leaves the same file. Only a row per shard comes to
the driver; the sums of those give each shard's first position. Reading streams blocks.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagatlas.llm.common import new_folder

MAGIC = b"TATLSST1"
_FOOTER = struct.Struct("<8sIQQQQQQQI")
BLOCK_IDS, BLOCK_DOCS = 32768, 256
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Encoded pieces that a task keeps; then it starts anew.
PIECES = 500_000
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20
#: A blank that doesn't begin a piece of its own: one before other white space or at the end; and separators that libraries disagree on.
_GLUED = r" (?:[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)|[\x1c-\x1f]"


# --- encoding


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is a file of the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes of `width` each.

    With byte-level pre-tokenization and no normalizer, a blank before a character that isn't white space always begins a
    new piece, so a text's ids are those of its parts between such blanks. Parts repeat, so their ids are kept. A text
    with a blank before other white space or at its end, or with an added token, is encoded as it is.
    """

    def __init__(self, name: str, end_id: int | None) -> None:
        import json

        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        before = how.get("pre_tokenizer") or {}
        self.by_part = how.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.marks = [t["content"] for t in how.get("added_tokens", [])]
        top = max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        self.width = 2 if top <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """For parts that begin with their only blank: many at a time, since each one's first token begins with it."""
        out = []
        for at in range(0, len(parts), 1 << 15):
            some = parts[at : at + (1 << 15)]
            texts = ["".join(some[k : k + 256]) for k in range(0, len(some), 256)]
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(e.ids)
                first = np.flatnonzero(self.blank[ids]) * self.width
                data = ids.astype(self.kind).tobytes()
                out += [data[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(data)], strict=True)]
        if len(out) != len(parts):
            raise ValueError("the vocabulary doesn't split at blanks")
        return out

    def batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """For each text its ids and the end id; a null text is an empty one."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _GLUED) if self.by_part else pa.array(np.ones(len(texts), bool))
        for m in self.marks:
            whole = pc.or_(whole, pc.match_substring(texts, m))
        whole = whole.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(np.flatnonzero(whole).tolist(), self._encode(texts.filter(pa.array(whole)).to_pylist()), strict=True):
            out[i] = ids + self.end
        for i, ids in zip(np.flatnonzero(~whole).tolist(), self._by_part(texts.filter(pa.array(~whole))), strict=True):
            out[i] = ids + self.end
        return out

    def _by_part(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts that split at blanks: each different part is looked up once, and its ids are put in place of its number."""
        split = pc.split_pattern(texts, " ")
        begin = np.asarray(split.offsets)
        parts = split.values.dictionary_encode()
        numbers, names = np.asarray(parts.indices), parts.dictionary
        # the first part of a text has no blank before it, and is not one of those kept
        first = np.zeros(len(numbers), bool)
        first[begin[:-1]] = True
        heads = self._encode(split.values.take(pa.array(begin[:-1])).to_numpy(zero_copy_only=False).tolist())
        numbers = numbers[~first]
        used = np.zeros(len(names), bool)
        used[numbers] = True
        ids = self._kept(names.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        place = np.cumsum(used) - 1
        joined = pa.array(ids, pa.large_binary()).take(pa.array(place[numbers]))
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1].tolist() if len(joined) else [0]
        data = memoryview(joined.buffers()[2] or b"") if len(joined) else b""
        ends = (begin - np.arange(len(begin))).tolist()
        for head, a, b in zip(heads, ends[:-1], ends[1:], strict=True):
            yield head + bytes(data[at[a] : at[b]])

    def _kept(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, each with a blank before it."""
        known = self.known
        new = [p for p in parts if p not in known]
        if len(known) + len(new) > PIECES:
            known.clear()
            new = parts
        known.update(zip(new, self._encode_parts([" " + p for p in new]), strict=True))
        out = [known[p] for p in parts]
        for p in [p for p in new if len(p) > 64]:
            del known[p]
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(name: str, end_id: int | None) -> Encoder:
    if (name, end_id) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[name, end_id] = Encoder(name, end_id)
    return _ENCODERS[name, end_id]


# --- the file


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % size for k in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.docs = self.ids = 0
        self.index, self.keys, self.last = bytearray(), [], b""
        self.first, self.entries, self.body, self.size, self.before = None, bytearray(), [], 0, b""
        self.packer = zstandard.ZstdCompressor(level=1)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if self.first is None:
            self.first, self.before = key, b""
        shared = len(os.path.commonprefix([self.before, key]))
        n = len(ids) // self.width
        self.entries += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:]
        self.body.append(ids)
        self.size += n
        self.docs, self.ids = self.docs + 1, self.ids + n
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.before = self.last = key
        if self.size >= BLOCK_IDS or len(self.body) >= BLOCK_DOCS:
            self._end_block()

    def _end_block(self) -> None:
        if self.first is not None:
            at = self.at
            self._put(struct.pack("<I", len(self.entries)) + bytes(self.entries) + self.packer.compress(b"".join(self.body)))
            self.index += _varint(len(self.first)) + _varint(at) + _varint(self.at - at) + self.first
            self.first, self.entries, self.body, self.size = None, bytearray(), [], 0

    def close(self) -> None:
        self._end_block()
        bits = np.zeros(max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8), np.uint8)
        for k in self.keys:
            bits[_bits(k, len(bits))] = 1
        index, bloom = bytes(self.index), np.packbits(bits).tobytes()
        at = self.at
        self._put(index + bloom)
        head = struct.pack("<8sIQQQQQQQ", MAGIC, self.width, self.docs, self.ids, at, len(index), at + len(index), len(bloom), len(bits))
        self._put(head + struct.pack("<I", zlib.crc32(head + index + bloom)))


class Table:
    """Reads one shard from a file object that can seek."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, io.SEEK_END)
        if size < _FOOTER.size:
            raise ValueError("not a token shard")
        foot = self._read(size - _FOOTER.size, _FOOTER.size)
        magic, self.width, self.docs, self.ids, at, n, bloom_at, bloom_n, self.bits, crc = _FOOTER.unpack(foot)
        index, self.bloom = self._read(at, n), self._read(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(foot[:-4] + index + self.bloom) != crc:
            raise ValueError("not a token shard, or a damaged one")
        self.kind, self.first, self.blocks, p = np.dtype("<u2" if self.width == 2 else "<u4"), [], [], 0
        while p < len(index):
            k, p = _read_varint(index, p)
            offset, p = _read_varint(index, p)
            length, p = _read_varint(index, p)
            self.first.append(index[p : p + k])
            self.blocks.append((offset, length))
            p += k

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._read(*self.blocks[k])
        (n,) = struct.unpack_from("<I", data)
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + n :]), self.kind)
        p, key, at = 4, b"", 0
        while p < 4 + n:
            shared, p = _read_varint(data, p)
            own, p = _read_varint(data, p)
            many, p = _read_varint(data, p)
            key, p = key[:shared] + data[p : p + own], p + own
            yield key, ids[at : at + many]
            at += many

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in _bits(key, self.bits))

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this identifier."""
        key, out = key_of(doc_id), []
        if not self.first or not self.may_have(key):
            return out
        k = max(0, bisect_right(self.first, key) - 1)
        while k > 0 and self.first[k] == key:
            k -= 1
        while k < len(self.blocks) and self.first[k] <= key:
            out += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return out


# --- Spark


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows to encode at once: many, since parts repeat among them, but not more than SLICE_BYTES of text or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        limit = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
        end = max(at + 1, min(limit, at + SLICE_ROWS))
        yield batch.slice(at, end - at)
        at = end


def _store(folder: str):
    """The file system of a folder and the folder's path there."""
    if "://" in folder or folder.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return pyarrow.fs.LocalFileSystem(), folder


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int, int]]:
    """Writes docs as shards into folder; (file, first position, documents, ids) of each shard, in order of identifiers.

    folder is an address that the executors reach (a shared path, or a store that pyarrow.fs knows). Null texts are empty,
    null identifiers come first, documents with one identifier are ordered by a hash of their text; repeated rows are kept.
    """

    def shard_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, (fs, path), part = encoder(tokenizer, end_id), _store(folder), TaskContext.get().partitionId()
        name, own = f"shard-{part:06d}.sst", f"_{uuid.uuid4().hex}.part"
        writer = out = None
        for batch in batches:
            for rows in _slices(batch):
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{own}")
                    writer = Writer(out, enc.width)
                for i, ids in zip(rows["doc_id"].to_pylist(), enc.batch(rows["text"]), strict=True):
                    writer.add(key_of(i), ids)
        # workers live on and serve other stages
        enc.known.clear()
        pa.default_memory_pool().release_unused()
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{path}/{own}", f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    order = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    made = sorted(tuple(r) for r in order.drop("_h").mapInArrow(shard_files, "part int, file string, docs long, ids long").collect())
    out, start = [], 0
    for _, file, n, ids in made:
        out.append((file, start, n, ids))
        start += ids
    return out


def read(spark: SparkSession, folder: str, shards: list[tuple[str, int, int, int]], ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, and its ids where asked for.

    start: ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{file}") as f:
                    table = Table(f)
                    for k in range(len(table.blocks)):
                        rows = [[], [], [], [], []]
                        for key, own in table.block(k):
                            for column, x in zip(rows, (id_of(key), start, len(own), zlib.crc32(own.astype("<u4").tobytes()), own.tolist() if ids else None), strict=True):
                                column.append(x)
                            start += len(own)
                        arrays = [pa.array(x, pa.int64()) for x in rows[:4]] + [pa.array(rows[4], pa.list_(pa.int64()))] * ids
                        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    rows = spark.createDataFrame([(f, s) for f, s, _, _ in shards], "file string, start long")
    return (rows.repartition(len(shards)) if len(shards) > 1 else rows).mapInArrow(documents, schema)


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Writes docs as token shards and reads them back: (doc_id, start, n_tokens, ids_crc32). An empty table has no shards and no rows."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read(docs.sparkSession, folder, write(docs, folder, tokenizer, end_id))
