"""Media columns: documents as lossless WebP images, and features of the decoded pixels.

A text's UTF-8 bytes, filled with spaces to a positive multiple of `align`,
are the grey samples of images `align` pixels wide; a text beyond one image's
16,384 rows goes on in further images, back to back. An image is stored with
prefix codes, back-references, the subtract-green transform and, where they
take less, a palette or a predictor. The bytes are stored as a
column, decoded from it again by quintet.llm.webp, and everything else is taken
from the decoded pixels. Row by row, so nothing is shuffled and memory is
bounded by one text.

Defined results: a null or empty text is one row of spaces; equal texts give
equal values; extra columns are kept, save those named like a result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintet.llm import common, webp

ALIGN, TAIL = 192, 16
STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
READ = T.StructType([
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
])


def images(payload: bytes, align: int) -> bytes:
    """The payload as grey images, back to back."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, align)
    return b"".join(webp.encode_grey(grey[at : at + webp.MOST]) for at in range(0, len(grey), webp.MOST))


def samples(media: bytes) -> np.ndarray:
    """Grey samples of images back to back, as rows."""
    rows, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        rows.append(np.ascontiguousarray(webp.decode(media[at : at + size]), "<u4").view(np.uint8)[:, 1::4])
        at += size
    return np.concatenate(rows)


def feature(grey: np.ndarray) -> str:
    """Size, mean, distinct samples and entropy in bits of the decoded pixels."""
    counts = np.bincount(grey.ravel(), minlength=256)
    share = counts[counts > 0] / grey.size
    return f"{grey.shape[1]}x{grey.shape[0]};mean={grey.mean(dtype=np.float64):.4f};distinct={len(share)};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def added(batch: pa.RecordBatch, rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    more = [pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, *arrow]))


def store(docs: DataFrame, *, text_col: str = "text", align: int = ALIGN) -> DataFrame:
    """docs with n_bytes and media, in place of the text."""
    docs = docs.drop(*[f.name for f in STORED if f.name != text_col])
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *STORED.fields])

    def put(batches):
        for b in common.by_bytes(batches, text_col):
            rows = []
            for text in common.utf8(b.column(text_col)):
                text = text or b""
                rows.append((len(text), images(text + b" " * (-len(text) % align or (0 if text else align)), align)))
            yield added(b.drop_columns([text_col]), rows, STORED)

    return docs.mapInArrow(put, schema)


def read(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """stored with what its media decode to: payload size and digests, and the feature."""
    stored = stored.drop(*[f.name for f in READ if f.name != media_col])
    schema = T.StructType([*(f for f in stored.schema.fields if f.name != media_col), *READ.fields])

    def get(batches):
        for b in common.by_bytes(batches, media_col):
            rows = []
            for media in b.column(media_col).to_pylist():
                grey = samples(media)
                payload = grey.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(grey)))
            yield added(b.drop_columns([media_col]), rows, READ)

    return stored.mapInArrow(get, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `documents`."""
    found = read(store(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_bytes", *[F.col(f.name) for f in READ])
