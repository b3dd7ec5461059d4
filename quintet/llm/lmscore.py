"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Words are runs without white space, A-Z lower-cased, hashed to 64 bits; an
n-gram's key hashes its words' hashes and its order. Documents are dealt into
chunks by a hash of id and text. Each chunk explodes its n-grams into blocks,
one a hash bucket, that hold the distinct keys in order and how often the chunk
has them. A bucket adds up its blocks to its part of the count table and
answers each block with the corpus counts of its keys. Chunks join the answers
to their exploded n-grams and sum over each document:

    log S(w | context) = log c(context w) / c(context)     if c(context w) > 0
                         log BACKOFF + log S(w | shorter context)  otherwise
    log S(w)           = log max(c(w), 1/2) / words

Counts are of all documents but the one scored (leave-one-out), so a text is
judged by the rest of the corpus and backing off happens.

Scale: an n-gram leaves a chunk once however often it stands there, as a
delta-coded key of under six bytes; a word that is everywhere is one entry a
chunk. A chunk's work follows its n-grams, however many buckets there are; of
CHUNK_CHARS and BUCKET_CHARS of characters, a block has some 500 keys at 30 GB
of input, and from a few TB on larger chunks and buckets than the default ones,
for executors of more memory, keep blocks from falling to single keys. Buckets follow the number of characters, so a bucket's keys fit in
memory, and hashes deal them evenly. Texts are shuffled once to their chunks,
compressed, and that shuffle is used for both passes. No count is cut off or
sampled.

Defined results: a null or empty text has no words, no score (null) and
log-probability 0; rows that share an id are scored each by itself, leaving out
only their own counts; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.llm import common, shingles

ORDER, BACKOFF = 3, 0.4
CHUNK_CHARS, BUCKET_CHARS = 8_000_000, 12_000_000
PACK_BYTES = 64 << 20  # texts that a task holds before it packs them by chunk
U = np.uint64
PACKS = "chunk int, docs binary"
BLOCKS = "bucket int, chunk int, n long, keys binary, counts binary"
ANSWERS = "chunk int, bucket int, words long, counts binary"
SCORES = "id long, n_words long, log_prob double, n_seen long"


def grams(texts: list[bytes | None], order: int):
    """For each order, (keys, document numbers) of all n-grams in order; and the words' places by document."""
    words, first = shingles.words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    found = []
    for n in range(1, order + 1):
        size = max(0, len(words) - n + 1)
        key = np.full(size, n, U)
        for k in range(n):
            key = shingles.mix(key * U(0x9E3779B97F4A7C15) + words[k : k + size])
        inside = doc[:size] == doc[n - 1 : n - 1 + size]
        found.append((key[inside], doc[:size][inside]))
    return found


def packed_docs(table: pa.Table) -> bytes:
    """(id, text) rows as a compressed Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked_docs(packs: pa.Table) -> tuple[list[int | None], list[bytes | None]]:
    """Ids and texts of a chunk's packs."""
    ids, texts = [], []
    for raw in packs.column("docs").to_pylist():
        table = pa.ipc.open_stream(raw).read_all()
        ids += table.column("id").to_pylist()
        for part in table.column("text").chunks:
            texts += common.utf8(part)
    return ids, texts


def packs(batches):
    """Record batches (id, text, chunk) as one pack a chunk of every PACK_BYTES."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held)
        chunk = table.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
        docs = table.select(["id", "text"])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk[order[a]]], pa.int32()), "docs": pa.array([packed_docs(docs.take(order[a:b]))], pa.binary())})

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= PACK_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of as many bytes as the largest needs, highest bytes compressed."""
    gaps = np.diff(keys, prepend=U(0))
    width = max(1, (int(gaps[1:].max() if len(gaps) > 1 else 0).bit_length() + 7) // 8)
    body = gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    planes = np.ascontiguousarray(body.T)
    top = zlib.compress(planes[-1].tobytes(), 1)  # the lower bytes are random
    return bytes([width]) + int(gaps[0]).to_bytes(8, "little") + planes[:-1].tobytes() + top


def unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    if n > 1:
        low = (width - 1) * (n - 1)
        gaps[1:, : width - 1] = np.frombuffer(raw, np.uint8, low, 9).reshape(width - 1, n - 1).T
        gaps[1:, width - 1] = np.frombuffer(zlib.decompress(raw[9 + low :]), np.uint8)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=U)


def packed_counts(counts: np.ndarray) -> bytes:
    """Non-negative counts in the narrowest width, deflated."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, ascending with it: equal ranges of the hash."""
    return (keys >> U(32)) * U(buckets) >> U(32)


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF,
    chunk_chars: int | None = None, bucket_chars: int | None = None,
) -> DataFrame:
    """(id, n_words, log_prob, n_seen) of each of docs; n_seen words had their full context's n-gram elsewhere."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    chunks, buckets = 1 + chars // (chunk_chars or CHUNK_CHARS), 1 + chars * order // (bucket_chars or BUCKET_CHARS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    dealt = rows.mapInArrow(packs, PACKS).repartition(max(common.partitions(spark), 1), "chunk")

    def explode(table: pa.Table) -> pa.Table:
        all_keys = np.concatenate([k for k, _ in grams(unpacked_docs(table)[1], order)])
        keys, counts = np.unique(all_keys, return_counts=True)
        bucket = bucket_of(keys, buckets).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else np.zeros(0, np.int64)
        chunk = table.column("chunk")[0].as_py()  # only buckets that the chunk has keys of
        return arrays([(int(bucket[a]), chunk, b - a, packed_keys(keys[a:b]), packed_counts(counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)], BLOCKS)

    def count(table: pa.Table) -> pa.Table:
        # a bucket's part of the count table, then each block's answer from it
        sizes = table.column("n").to_pylist()
        blocks = [unpacked_keys(raw, n) for raw, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
        keys, place = np.unique(np.concatenate(blocks), return_inverse=True)
        own = np.concatenate([unpacked_counts(raw) for raw in table.column("counts").to_pylist()])
        total = np.bincount(place, weights=own, minlength=len(keys)).astype(np.int64)
        bucket, at, out = table.column("bucket")[0].as_py(), 0, []
        for chunk, n in zip(table.column("chunk").to_pylist(), sizes, strict=True):
            out.append((chunk, bucket, n, packed_counts(total[place[at : at + n]])))
            at += n
        return arrays(out, ANSWERS)

    blocks = dealt.groupBy("chunk").applyInArrow(explode, BLOCKS)
    answers = blocks.groupBy("bucket").applyInArrow(count, ANSWERS)
    words = docs.select(F.coalesce(F.sum(F.size(F.filter(F.split(text_col, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))), F.lit(0)).alias("n")).first()[0]

    def sum_up(docs: pa.Table, table: pa.Table) -> pa.Table:
        ids, texts = unpacked_docs(docs)
        found = grams(texts, order)
        in_order = np.argsort(table.column("bucket").to_numpy()) if table.num_rows else []
        raw = table.column("counts").to_pylist()
        total = np.concatenate([unpacked_counts(raw[i]) for i in in_order]) if len(in_order) else np.zeros(0, np.int64)
        n_docs = len(ids)
        sizes = np.bincount(found[0][1], minlength=n_docs)
        rest = np.maximum(1, words - sizes)  # words of the other documents
        # of each n-gram among the other documents; documents ascend within an order, so a document's equal n-grams sort side by side
        places = [doc for _, doc in found]
        key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(key, kind="stable")
        key, doc = key[by], doc[by]
        new = np.diff(key, prepend=~key[:1]) != 0
        first = np.flatnonzero(new | (np.diff(doc, prepend=-1) != 0))
        own = np.diff(first, append=len(key))
        other = np.empty(len(key), np.int64)
        other[by] = np.repeat(total[np.cumsum(new)[first] - 1] - own, own)
        counts = np.split(other, np.cumsum([len(x) for x in places])[:-1])
        logs = np.log(np.maximum(counts[0], 0.5) / rest[found[0][1]])
        seen = counts[0] > 0
        start = np.cumsum(sizes) - sizes
        for n in range(2, order + 1):
            # the n-gram at place i of a document ends at its word i + n - 1; its context starts at i
            doc, of = places[n - 1], counts[n - 1]
            size = np.maximum(0, sizes - n + 1)
            inner = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            word = start[doc] + inner + n - 1
            size_c = np.maximum(0, sizes - n + 2)
            context = counts[n - 2][(np.cumsum(size_c) - size_c)[doc] + inner]
            hit = of > 0
            logs[word] = np.where(hit, np.log(np.maximum(of, 1) / np.maximum(context, 1)), np.log(backoff) + logs[word])
            seen[word] = hit
        doc = found[0][1]
        out = (ids, sizes, np.bincount(doc, weights=logs, minlength=n_docs), np.bincount(doc, weights=seen, minlength=n_docs).astype(np.int64))
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(x) for x in out[1:])], names=["id", "n_words", "log_prob", "n_seen"])

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sum_up, SCORES)


def arrays(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def digest(found: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_seen", F.round("log_prob", 6).alias("log_prob"), F.round(mean, 6).alias("score"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores of `documents`, each by the counts of all others."""
    return digest(score(common.table(spark, sf_dir, "documents")))
