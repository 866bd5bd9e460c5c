"""Media columns: texts stored losslessly as progressive JPEGs, and progressive JPEGs decoded to RGB tensors.

Defined cases: a null or empty text is stored as 64 zero bytes; equal texts give equal files, tensors and features;
repeated rows are stored row by row; a null media value decodes to nulls; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import slices

#: Bytes of files decoded together (their coefficients take about three times as much memory).
TOGETHER = 4 << 20


def payload_of(content: bytes) -> bytes:
    return content + b"\0" * (-len(content) % jpeg.BLOCK) if content else b"\0" * jpeg.BLOCK


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as a progressive JPEG."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            contents = [x.as_py() or b"" for x in batch.column(1)]
            media = [jpeg.encode_payload(payload_of(x)) for x in contents]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, contents), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def groups(files: list[bytes | None]) -> Iterator[list[int]]:
    """Indices of files decoded together."""
    own, size = [], 0
    for i, x in enumerate(files):
        if x is None:
            continue
        if own and size + len(x) > TOGETHER:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(x)
    if own:
        yield own


def decoded(files: list[bytes]) -> Iterator[tuple[jpeg.Image, np.ndarray, np.ndarray]]:
    """Image, all coefficients, and RGB tensor of each file; samples of like-quantised images are transformed together."""
    images, coefficients = jpeg.decode_coefficients(files)
    tables = {q.tobytes(): q for image in images for q in image.quantisers.values()}
    ready = jpeg.samples(coefficients, next(iter(tables.values()))) if len(tables) == 1 else None
    for image in images:
        yield image, coefficients, jpeg.rgb(image, coefficients, ready)


def decode_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """``key, height, width, tensor``: full-resolution RGB, three bytes a pixel in row order."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(1).to_pylist()
            for own in groups(files):
                found = [t for _, _, t in decoded([files[i] for i in own])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array([t.shape[0] for t in found], pa.int32()), pa.array([t.shape[1] for t in found], pa.int32()), pa.array([t.tobytes() for t in found], pa.binary())], names=[key, "height", "width", "tensor"])
            if lost := [i for i, x in enumerate(files) if x is None]:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lost)), pa.nulls(len(lost), pa.int32()), pa.nulls(len(lost), pa.int32()), pa.nulls(len(lost), pa.binary())], names=[key, "height", "width", "tensor"])

    kind = dict(media.dtypes)[key]
    return media.select(key, column).mapInArrow(decode, f"{key} {kind}, height int, width int, tensor binary")


def digest_media(stored: DataFrame) -> DataFrame:
    """Digests of what the stored files hold, read back scan by scan, and features of their tensors."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files = (c.to_pylist() for c in batch.columns)
            for own in groups(files):
                rows = []
                for i, (image, coefficients, tensor) in zip(own, decoded([files[i] for i in own])):
                    payload = jpeg.read_payload(image, coefficients)
                    rows.append((ids[i], sizes[i], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(files[i]), hashlib.sha256(files[i]).hexdigest(), jpeg.describe(tensor)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
