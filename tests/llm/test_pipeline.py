"""The pipeline's stages one after another, each against brute force on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import DOCS, contamination, groups, ids_of, toxic_rows, BENCH, R, VOCABULARY


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i, text, bad in toxic_rows(400, 8):
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, 1, bad))
    for i in range(400, 460):
        text = " ".join(R.choice(VOCABULARY, 50))
        if i % 3 == 0:
            text += " " + BENCH[i % 6][1]
        rows.append((i, text if i % 5 else rows[i - 399][1], "en", None, 0))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "token_ids":
            got = sorted((tuple(r) for r in after.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str)
            assert got == sorted(ids_of(before), key=str)
            break
        assert after.columns == columns
        kept = sorted(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "toxicity":
            gone = {i for i, _ in before} - set(kept)
            assert 60 <= len(gone) <= 160 and np.mean([i % 4 == 0 or i >= 400 for i in gone]) > 0.9
        elif name == "near_dedup":
            assert kept == sorted(i for i, _, _, k in groups(before) if k)
        elif name == "decontamination":
            assert kept == sorted(i for i, t in before if not contamination(t)[3])
        else:
            sizes = docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
            assert len(kept) > 0 and after.select("doc_id", "text").distinct().exceptAll(docs.select("doc_id", "text").distinct()).isEmpty()
            assert abs(after.select(F.sum(F.size(F.split("text", " ")))).first()[0] - sum(r["n"] for r in sizes)) < 200
        docs = after


def test_odd_rows_and_empty_tables(spark, tmp_path):
    kinds = DOCS + ", __c0 string, score double, kept boolean, copies long, id long"
    rows = [(i, text, "en", f"s{i % 3}", 1, "x", 0.5, True, 7, -i) for i, text, _ in toxic_rows(120, 4)]
    more = [(None, None), (None, "one two three four five six"), (500, None), (501, ""), (502, " \n\t "), (503, "same text here again and again"), (503, "same text here again and again"), (503, "another text under that same id"), (504, "long " * 300_000)]
    rows += [(i, t, None, None, None, None, None, None, None, None) for i, t in more]
    labels = [(i, 1, bad) for i, _, bad in toxic_rows(120, 4)] + [(None, 0, 1), (500, None, None), (3, 1, 0)]
    for name, some, marked in (("odd", rows, labels), ("none", [], []), ("unlabelled", rows[-9:], [])):
        at = str(tmp_path / name)
        spark.createDataFrame(some, kinds).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(BENCH if some else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, work in corpus_pipeline.STAGES[:-1]:
            after = work(spark, docs, at)
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], (name, stage)
            kept = Counter(r["doc_id"] for r in after.select("doc_id").collect())
            assert all(kept[i] == (1 if some else 0) for i in (500, 501, 502)), (name, stage)  # nothing in them to reject; a copy of nothing is taken once
            if stage in ("near_dedup", "decontamination") and some:
                assert kept[503] == 3 and kept[None] == 2  # one id's rows stay together if equal, else each has its own text
        assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == len(some)
        assert corpus_pipeline.run(spark, at).count() >= (5 if some else 0)


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 100
