"""Line dedup over the whole corpus.

Lines are exploded as normalised keys, hashed, and the distinct documents of
each hash counted; a line whose key has at least `min_chars` code points and
is found in at least `min_docs` documents is dropped everywhere but in the
largest document id that holds it. Kept lines are joined by position.

Scale: only (document id, 128-bit hash) pairs of long lines are exploded, one
a document and key; counts are combined on the map side, so a line that a
third of all documents hold is one row a task at the counting shuffle. Hashes
over the threshold are joined back as an ordinary join, which splits hot keys
when it is shuffled (adaptive skew join); each document then gathers no more
than its own hashes. Texts move once, by document id.

Defined results: a null or empty text is one empty line; rows that share a
document id count as one document; a null id counts as one document, smaller
than all others; extra columns are kept, save those named like a result, which
the result replaces.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintet.llm import common

SPACE = b" \t\n\x0b\x0c\r"
RESULT = T.StructType([
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_dropped", T.LongType()),
    T.StructField("kept", T.StringType()),
    T.StructField("kept_sha256", T.StringType()),
])


def long_key(line: bytes, least: int) -> bytes | None:
    """The line's key, or None if it has under `least` code points."""
    key = line.strip(SPACE)
    if len(key) < least:
        return None
    key = key.translate(common.LOWER)
    if len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def key_hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def long_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, h): each document's distinct hashes of long lines."""

    def explode(batches):
        for b in common.by_bytes(batches, text_col):
            rows, hashes = [], []
            for i, text in enumerate(common.utf8(b.column(text_col))):
                if text and len(text) >= least:
                    own = {key_hash(k) for line in text.split(b"\n") if (k := long_key(line, least)) is not None}
                    rows.extend([i] * len(own))
                    hashes.extend(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [pc.take(b.column(id_col), pa.array(rows, pa.int64())), pa.array(hashes, pa.binary())], names=["id", "h"]
            )

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(explode, T.StructType([T.StructField("id", kind), T.StructField("h", T.BinaryType())]))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with n_lines, n_dropped, kept (the text that stays) and kept_sha256."""
    lines = long_lines(docs, id_col, text_col, min_chars)
    # a document is counted once however many rows share its id; the inner grouping is
    # a no-op for distinct ids and combines on the map side
    once = lines.groupBy("h", "id").agg(F.lit(1).alias("one"))
    frequent = (
        once.groupBy("h")
        .agg(F.count("one").alias("n"), F.max("id").alias("last"))
        .filter(F.col("n") >= min_docs)
        .select("h", "last")
    )
    drops = (
        once.join(frequent, "h")
        .filter(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id")
        .agg(F.collect_list("h").alias("__drop"))
    )
    docs = docs.drop(*[f.name for f in RESULT])
    both = docs.join(drops, docs[id_col].eqNullSafe(drops["id"]), "left").drop(drops["id"])
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    kept_columns = docs.columns

    def reassemble(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RESULT)
        for b in common.by_bytes(batches, text_col):
            rows = []
            for text, drop in zip(common.utf8(b.column(text_col)), b.column("__drop").to_pylist(), strict=True):
                text = text or b""
                if not drop:
                    rows.append((text.count(b"\n") + 1, 0, text.decode("utf-8", "replace"), hashlib.sha256(text).hexdigest()))
                    continue
                gone, lines = set(drop), text.split(b"\n")
                kept = [x for x in lines if (k := long_key(x, min_chars)) is None or key_hash(k) not in gone]
                whole = b"\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), whole.decode("utf-8", "replace"), hashlib.sha256(whole).hexdigest()))
            more = [pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows, strict=True), strict=True)]
            own = [b.column(c) for c in kept_columns]
            yield pa.RecordBatch.from_arrays([*own, *more], names=[*kept_columns, *arrow.names])

    return both.mapInArrow(reassemble, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `documents`."""
    found = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")
