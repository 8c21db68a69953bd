"""Token ids as fixed-width bit-packed files.

A folder holds shards in ascending document order.  A shard is

    magic "SWTB" | version u32 | bits u32 | ids per block u32
    blocks: each ``block`` ids in ``bits`` bits, most significant bit first,
            padded to a byte; the last block may be shorter
    block offsets u64 (n_blocks + 1), document ids i64, document ends u64
    footer: n_docs u64, n_tokens u64, n_blocks u64, magic

so numpy unpacks whole blocks at once, and any token range needs only its own
blocks.  Shards are written under a temporary name and renamed, so a task that
runs again leaves the same file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import scratch_dir
from .tokens import encoder, tokenizer_path
from .words import slices

MAGIC = b"SWTB"
BLOCK = 4096
_HEAD, _FOOT = struct.Struct("<4sIII"), struct.Struct("<QQQ4s")


def min_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, most significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f">u{bits // 8}").astype(np.uint32)
    planes = np.unpackbits(raw, count=n * bits).reshape(n, bits).astype(np.uint32)
    return planes @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class ShardWriter:
    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest = np.zeros(0, np.uint32)
        self.offsets, self.docs, self.ends, self.n = [_HEAD.size], [], [], 0
        stream.write(_HEAD.pack(MAGIC, 1, bits, block))

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.append(np.asarray(doc_ids, np.int64))
        self.ends.append(offsets[1:] + self.n)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(ids) // self.block * self.block
        size = (self.block * self.bits + 7) // 8
        if whole:
            blocks = ids[:whole].reshape(-1, self.block)
            if self.block * self.bits % 8 == 0:
                self.stream.write(pack_bits(ids[:whole], self.bits))
            else:
                for b in blocks:
                    self.stream.write(pack_bits(b, self.bits))
            self.offsets += [self.offsets[-1] + size * (i + 1) for i in range(len(blocks))]
        self.rest = np.array(ids[whole:], np.uint32)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            last = pack_bits(self.rest, self.bits)
            self.stream.write(last)
            self.offsets.append(self.offsets[-1] + len(last))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        for a, kind in ((self.offsets, "<u8"), (docs, "<i8"), (ends, "<u8")):
            self.stream.write(np.asarray(a).astype(kind).tobytes())
        self.stream.write(_FOOT.pack(len(docs), self.n, len(self.offsets) - 1, MAGIC))
        return len(docs), self.n


class ShardReader:
    """Reads the index at once and blocks on demand."""

    def __init__(self, file):
        self.file = file
        total = file.size()
        magic, _, self.bits, self.block = _HEAD.unpack(file.read_at(_HEAD.size, 0))
        n_docs, self.n_tokens, n_blocks, tail = _FOOT.unpack(file.read_at(_FOOT.size, total - _FOOT.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token shard, or one that was cut short")
        size = 8 * (n_blocks + 1 + 2 * n_docs)
        index = file.read_at(size, total - _FOOT.size - size)
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * (n_blocks + 1))
        self.ends = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + 1 + n_docs)).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if n_docs else self.ends

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        n = min(b * self.block, self.n_tokens) - a * self.block
        if self.block * self.bits % 8 == 0:
            ids = unpack_bits(data, n, self.bits)
        else:
            cut = self.offsets[a : b + 1] - self.offsets[a]
            ids = np.concatenate([unpack_bits(data[cut[i] : cut[i + 1]], min(self.block, n - i * self.block), self.bits) for i in range(b - a)])
        return ids[start - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.ends[i]))


def open_shard(uri: str) -> ShardReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return ShardReader(fs.open_input_file(path))


def write_token_files(df: DataFrame, uri: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2) -> dict:
    """Write every text (null: empty) in ascending ``doc_id`` order; returns and stores the manifest.

    Range partitioning by document id gives each task one shard, whatever the
    input's order.  Rows that share an id follow each other, ordered by text; a
    null id goes first and is stored as the smallest 64-bit integer.  The
    manifest has one entry a shard.  An empty table gives no shard.
    """
    path = tokenizer or tokenizer_path()
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        name = f"shard-{part:06d}.swtb"
        held = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(held) as stream:
            out = ShardWriter(stream, min_bits(enc.vocab_size))
            for batch in batches:
                for p in slices(batch, "text"):
                    ids, offsets = enc.encode(p.column("text"), end_id)
                    out.add(p.column("doc_id").fill_null(-(1 << 63)).to_numpy(), ids, offsets)
            docs, tokens = out.close()
        fs.move(held, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [docs], "n_tokens": [tokens]})

    found = sorted(r for r in rows.mapInArrow(write, "part long, name string, n_docs long, n_tokens long").collect() if r.n_docs)
    start, shards = 0, []
    for r in found:
        shards.append({"name": r.name, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start})
        start += r.n_tokens
    manifest = {"uri": uri, "end_id": end_id, "n_tokens": start, "shards": shards}
    fs, folder = pafs.FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """Per document of the folder: doc_id, start (ids before it), n_tokens, ids_crc32; one task a shard."""
    fs, folder = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    names = [s["name"] for s in manifest["shards"]]
    starts = [s["start"] for s in manifest["shards"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard = open_shard(f"{uri}/{names[k]}")
                n, i = len(shard.doc_ids), 0
                while i < n:  # runs of documents of about a million ids
                    j = max(i + 1, int(np.searchsorted(shard.ends, shard.starts[i] + (1 << 20), "right")))
                    ids = memoryview(np.ascontiguousarray(shard.tokens(int(shard.starts[i]), int(shard.ends[j - 1])), "<u4")).cast("B")
                    at = (shard.starts[i:j] - shard.starts[i]) * 4
                    to = (shard.ends[i:j] - shard.starts[i]) * 4
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)]
                    doc = shard.doc_ids[i:j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == -(1 << 63)), pa.array(shard.starts[i:j] + starts[k]), pa.array(shard.ends[i:j] - shard.starts[i:j]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    i = j

    shards = spark.range(0, len(names), 1, max(1, len(names)))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(df: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read the files back."""
    uri = scratch_dir(df.sparkSession, "tokens")
    write_token_files(df, uri, tokenizer=tokenizer, end_id=end_id)
    return read_token_files(df.sparkSession, uri)
