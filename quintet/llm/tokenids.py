"""Token-ID output: encode documents and write them as sorted-string-table shards.

Documents are range-partitioned by identifier and sorted, encoded in that
order and written as one shard a partition (quintet.llm.sstable), whole or not
at all, in a folder that driver and executors share. The number of shards
follows that of the scan's splits, and so the bytes of text. A manifest of one row a
shard gives each shard's place in the whole sequence; the shards are then read
back independently. Texts move once; nothing grows on the driver but the
manifest, a row a shard.

Defined results: a null or empty text has only the end id; rows that share an
identifier follow each other, ordered by text; a null identifier comes first;
extra columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.llm import common, sstable, wordbpe

END_ID = 1
MANIFEST = "shard long, path string, docs long, ids long, bytes long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, folder: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write shards below folder; returns the manifest, computed once."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if shards is None:  # the scan's splits follow the bytes
        shards = max(common.partitions(spark), rows.rdd.getNumPartitions())
    dealt = (
        rows.repartitionByRange(shards, F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )

    def shard(batches):
        bpe, number, made = wordbpe.load(tokenizer), TaskContext.get().partitionId(), {}
        end = bpe.pack([end_id])

        def produce(out):
            w = sstable.Writer(out, bpe.width)
            for b in common.by_bytes(batches, "text", 2 << 20):
                for i, ids in zip(b.column("id").to_pylist(), bpe.encode(common.utf8(b.column("text"))), strict=True):
                    w.add(i, ids + end)
            w.finish()
            made.update(docs=w.docs, ids=w.ids)
            bpe.forget()
            common.trimmed()

        import itertools

        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        batches = itertools.chain([first], batches)
        path, size = common.write_whole(folder, f"shard-{number:06d}", ".sst", produce)
        yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path], "docs": [made["docs"]], "ids": [made["ids"]], "bytes": [size]})

    return common.cut(dealt.mapInArrow(shard, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the shards."""
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", before.alias("before")).repartition(common.partitions(spark), "shard")

    def rows(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                fs, name = common.open_fs(path)
                with fs.open_input_file(name) as f:
                    shard = sstable.Reader(f)
                    out, width = [], shard.props["width"]
                    for ident, value in shard.scan():
                        n = len(value) // width
                        out.append((ident, start, n, zlib.crc32(np.frombuffer(value, f"<u{width}").astype("<u4").tobytes())))
                        start += n
                        if len(out) == 10_000:
                            yield packed(out)
                            out = []
                    if out:
                        yield packed(out)

    return placed.mapInArrow(rows, "id long, start long, n_tokens long, ids_crc32 long")


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write docs as shards and return what is read back from them."""
    manifest = write(docs, common.fresh_dir(spark, "sst"), tokenizer=vocabulary())
    return read(manifest).withColumnRenamed("id", "doc_id")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `documents`."""
    return stage(spark, common.table(spark, sf_dir, "documents"), sf_dir)
