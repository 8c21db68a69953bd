"""Media columns: payloads stored as baseline JPEG, and features read from JPEG bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import decode_batch, encode_payloads, thumbnail, thumbnail_hash
from .words import buffers, slices

_UNIT = 64
#: What reading a broken or foreign file may raise.
_BROKEN = (ValueError, IndexError, KeyError, ZeroDivisionError, struct.error)


def encode_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, media (a JPEG that holds the text's UTF-8 bytes and
    zeros up to a positive multiple of 64)."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = buffers(part.column("text"))
                n = np.diff(offsets)
                sizes = np.maximum(1, -(-n // _UNIT)) * _UNIT
                payload = np.zeros(int(sizes.sum()), np.uint8)
                payload[np.repeat(np.cumsum(sizes) - sizes - offsets[:-1], n) + np.arange(len(data))] = data
                media = encode_payloads(payload, sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def payload_of(frame, coef: np.ndarray) -> bytes:
    """The payload of a file that ``encode_media`` wrote; its size is in the comment."""
    return (coef.ravel()[: struct.unpack(">Q", frame.comment)[0]] + 128).astype(np.uint8).tobytes()


def _by_bytes(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    yield from slices(batch, "media", limit)


def read_media(df: DataFrame) -> DataFrame:
    """Decode ``media`` of the rows of ``encode_media``: payload digests, the stored form's
    digest, and ``feature``: width x height : thumbnail hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch, 1 << 20):
                media = part.column("media").to_pylist()
                payloads, features = [], []
                for frame, coef in decode_batch(media):
                    payloads.append(payload_of(frame, coef))
                    features.append(f"{frame.width}x{frame.height}:{thumbnail_hash(thumbnail(frame, coef))}")
                columns = [
                    part.column("doc_id"), part.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-_UNIT:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(features, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media", columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` of every row, and width, height and thumbnail_hash of any baseline JPEG in
    ``media``; all three are null where it is null or can't be decoded."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(media).alias("media"))
    schema = rows.drop("media").withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "thumbnail_hash": F.lit(None).cast("string")}).schema

    def one(data: bytes | None) -> tuple[int | None, int | None, str | None]:
        try:
            (frame, coef), = decode_batch([data]) if data else [(None, None)]
            return (frame.width, frame.height, thumbnail_hash(thumbnail(frame, coef))) if frame else (None, None, None)
        except _BROKEN:
            return None, None, None

    def several(files: list[bytes | None]) -> list[tuple[int | None, int | None, str | None]]:
        """All at once; one by one if a file among them is broken."""
        try:
            if all(files):
                return [(f.width, f.height, thumbnail_hash(thumbnail(f, c))) for f, c in decode_batch(files)]
        except _BROKEN:
            pass
        return [one(x) for x in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                found = several(part.column("media").to_pylist())
                extra = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *extra], names=[*names, "width", "height", "thumbnail_hash"])

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, columns, strict=True)))  # names c0.. clash with none


def media_round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text (null: empty) as JPEG and read the stored bytes back.

    One row per row of ``df``; equal texts give equal values; a null doc_id
    stays null; other columns are ignored; an empty table gives no row.
    """
    return read_media(encode_media(df, doc_id, text))
